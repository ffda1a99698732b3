"""Token counts by rank-synchronous merging of ragged arrays, for sentencepiece BPE models with byte fallback.

A batch's texts become one array of bytes. Spaces (and U+2581, their sign) end words, and no piece of the
vocabulary crosses from another character to a space, so a text's tokens are those of its words, each with
the space before it, and of the spaces left over. Distinct words of the batch are held as one ragged array of symbols,
cut also between characters that no piece has side by side. In each step every sequence applies its lowest-rank
pair: at all its places, left to right, where what the merge makes never stands in a pair of a rank as low (then
nothing can come between), and at the leftmost place otherwise. Sequences without a pair leave the array; the few
that are left after STEPS steps are finished through a queue of their pairs, by the same rule. What survives is counted: one for a piece
of the vocabulary, one for each UTF-8 byte of any other character.

Pieces of spaces alone come after all others and tie with each other, so what is left of a run of spaces depends on its length
alone: a table, made by the same leftmost rule, has the tokens of a run.

Cases: null text is empty and has no tokens; a text of spaces alone has those of the run with the prefix
that the model adds; very long texts and words take time in proportion to their length (a word that a queue finishes, times its
logarithm); repeated rows give repeated rows; an empty table gives an empty one; only the named columns are read, so other
columns may have any name; a column of `keep` named like one of the result is an error. A model with other rules of normalising, or with
pieces that hold a space after another character, is refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lectern.llm._shared import body, freeing, small_batches

SIGN, NONE, STEPS, LIMIT = "▁", np.int32(2**31 - 1), 48, 4096
RESULT = ("n_bytes", "n_tokens", "over_limit")


class MergeTable:
    """Symbols, pairs and ranks of a model.

    Symbols 0 to 3 stand for characters that no piece has, by the bytes of their UTF-8 less one; then come
    the pieces' characters, then the pieces of two characters or more.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        score = {}
        for i in range(model.get_piece_size()):
            if model.is_unused(i):
                raise ValueError("models with unused pieces aren't supported")
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                score[model.id_to_piece(i)] = model.get_score(i)
        probe = " ﬁ　１  é "
        if model.decode(model.encode(probe)) != probe or model.encode("a", out_type=str)[0][0] != SIGN or any(SIGN in p.lstrip(SIGN) for p in score):
            raise ValueError("only models that keep texts as they are, put a space first and have spaces first in their pieces are supported")
        self.runs = self._runs({len(p) for p in score if p.strip(SIGN) == ""}, {score[p] for p in score if len(p) > 1 and p.strip(SIGN) == ""}, score)
        score = {p: s for p, s in score.items() if len(p) == 1 or p.strip(SIGN)}
        chars = sorted({c for p in score for c in p} | {SIGN})
        # The library takes a character that is no piece for an unknown one, which falls back to bytes.
        self.weight = np.array([1, 2, 3, 4, *(1 if c in score else len(c.encode()) for c in chars), *[1] * len(score)], np.int64)
        number = {c: 4 + i for i, c in enumerate(chars)}
        for p in score:
            number.setdefault(p, len(number) + 4)
        self.of_char = np.zeros(0x110000, np.int32)
        codes = np.arange(0x110000)
        self.of_char[:] = (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
        for c in chars:
            self.of_char[ord(c)] = number[c]
        self.sign, self.n_chars, self.n = number[SIGN], 4 + len(chars), 4 + len(number)
        ranked = {p: i for i, p in enumerate(sorted((p for p in score if len(p) > 1), key=lambda p: -score[p]))}
        if len({score[p] for p in ranked}) != len(ranked):
            raise ValueError("pieces must have ranks of their own")
        self.beside = np.zeros((self.n_chars, self.n_chars), bool)
        pairs, least = {}, {}
        for p, r in ranked.items():
            for k in range(1, len(p)):
                self.beside[number[p[k - 1]], number[p[k]]] = True
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = r
                    for x in (a, b):
                        least[x] = min(r, least.get(x, r))
        self.made = np.array([number[p] for p in ranked], np.int32)
        self.safe = np.array([least.get(number[p], int(NONE)) > r for p, r in ranked.items()], bool)
        self.pairs = pairs
        self._fill(pairs)

    @staticmethod
    def _runs(lengths: set[int], scores: set[float], score: dict[str, float]) -> np.ndarray:
        """Tokens of runs of less than the longest piece of spaces; such a piece starts the run again."""
        if len(scores) > 1 or scores and min(score.values()) != min(scores):
            raise ValueError("pieces of spaces must share the last rank")
        top = max(lengths)
        if any(top + x in lengths for x in lengths):
            raise ValueError("pieces of spaces must not grow beyond the longest")
        out = []
        for m in range(2 * top):
            run = [1] * m
            while (k := next((i for i in range(len(run) - 1) if run[i] + run[i + 1] in lengths), None)) is not None:
                run[k : k + 2] = [run[k] + run[k + 1]]
            out.append(len(run))
        if any(out[top + m] != out[m] + 1 for m in range(top)):
            raise ValueError("pieces of spaces must not grow beyond the longest")
        return np.array(out[:top], np.int64)

    def _fill(self, pairs: dict[int, int]) -> None:
        """An open table of the pairs, four times as large as they are many."""
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys, ranks = np.fromiter(pairs, np.int64), np.fromiter(pairs.values(), np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several, one stays
            done = self.keys[at] == keys
            self.ranks[at[done]] = ranks[done]
            keys, ranks, at = keys[~done], ranks[~done], (at[~done] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where two symbols make no piece."""
        keys = a.astype(np.int64) * self.n + b
        out, at, todo = np.full(len(keys), NONE, np.int32), self._slot(keys), np.arange(len(keys))
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            more = ~hit & (held != -1)
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def run_tokens(self, lengths: np.ndarray) -> np.ndarray:
        """Tokens of runs of spaces."""
        top = len(self.runs)
        return lengths // top + self.runs[lengths % top]

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights of what survives in each sequence, the first symbol that survives there); no sequence is empty."""
        total, first = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int32)
        which = np.arange(len(starts))
        sizes = np.diff(np.append(starts, len(symbols)))
        rank = np.full(len(symbols), NONE, np.int32)
        if len(symbols) > 1:
            rank[:-1] = self.rank_of(symbols[:-1], symbols[1:])
        rank[starts + sizes - 1] = NONE
        step = 0
        while len(which):
            low = np.minimum.reduceat(rank, starts)
            live = low != NONE
            if not live.all():
                total[which[~live]] = np.add.reduceat(self.weight[symbols], starts)[~live]
                first[which[~live]] = symbols[starts[~live]]
                stays = np.repeat(live, sizes)
                symbols, rank = symbols[stays], rank[stays]
                which, low, sizes = which[live], low[live], sizes[live]
                starts = np.cumsum(sizes) - sizes
            if not len(which):
                break
            if step == STEPS:
                for k, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
                    total[which[k]], first[which[k]] = self.finish(symbols[s : s + n].tolist())
                break
            step += 1
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            # Of overlapping pairs, those at an even distance from the first of their row.
            opens = np.empty(len(at), bool)
            opens[:1], opens[1:] = True, at[1:] != at[:-1] + 1
            row = np.maximum.accumulate(np.where(opens, at, 0))
            owner = np.searchsorted(starts, at, "right") - 1
            leads = np.empty(len(at), bool)
            leads[:1], leads[1:] = True, owner[1:] != owner[:-1]
            taken = ((at - row) % 2 == 0) & (self.safe[low[owner]] | leads)
            at, owner = at[taken], owner[taken]
            symbols[at] = self.made[low[owner]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            rank[at] = NONE  # a merged pair at a sequence's end has none after it
            place = np.cumsum(stays) - 1
            symbols, rank = symbols[stays], rank[stays]
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
            starts = np.cumsum(sizes) - sizes
            new = place[at]
            touched = np.zeros(len(symbols), bool)
            touched[new[new < starts[owner] + sizes[owner] - 1]] = True
            touched[new[new > starts[owner]] - 1] = True
            fresh = np.flatnonzero(touched)
            rank[fresh] = self.rank_of(symbols[fresh], symbols[fresh + 1])
        return total, first

    def finish(self, symbols: list[int]) -> tuple[int, int]:
        """merge() of one sequence, pair by pair through a queue."""
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        queue = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (r := self.pairs.get(symbols[i] * self.n + symbols[after[i]])) is not None:
                heapq.heappush(queue, (r, i))

        for i in range(len(symbols)):
            offer(i)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j < 0 or self.pairs.get(symbols[i] * self.n + symbols[j]) != r:
                continue
            symbols[i], symbols[j], after[i] = int(self.made[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return sum(int(self.weight[s]) for s in symbols if s >= 0), symbols[0]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; none is null."""
        texts = pc.replace_substring(texts.cast(pa.large_string()), SIGN, " ")
        full = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        # A space before each text; none ends a word at the text's end but the one before the next.
        texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        blank = raw == 0x20
        # Words: from a character after a space up to the next space. Each text begins with a space.
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        opens = np.flatnonzero(~blank[edge])
        begins, stops = edge[opens], np.append(edge, len(raw))[opens + 1]
        lows, highs = np.searchsorted(begins, ends[:-1]), np.searchsorted(begins, ends[1:])
        tokens = np.zeros(len(texts), np.int64)
        if len(begins):
            letters = raw[~blank]
            offsets = np.concatenate([[0], np.cumsum(stops - begins)])
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
            n, bare = self.words(words.dictionary)
            at = words.indices.to_numpy()
            before = np.maximum(np.concatenate([[0], stops[:-1]]), np.repeat(ends[:-1], highs - lows))  # spaces are the word's own from its text's start on
            more = np.flatnonzero((begins - before > 1) | (bare[at] > 0))
            each = n[at]
            each[more] += self.run_tokens(begins[more] - before[more] - 1 + bare[at[more]]) - bare[at[more]]
            sums = np.concatenate([[0], np.cumsum(each)])
            tokens = sums[highs] - sums[lows]
        last = np.where(highs > lows, np.append(stops, 0)[highs - 1], ends[:-1])
        return np.where(full, tokens + self.run_tokens(ends[1:] - last), 0)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of a space and each distinct word, 1 where that space is a token by itself)."""
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = bytes(words.buffers()[2])[ends[0] : ends[-1]]
        raw = np.frombuffer(data, np.uint8)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends - ends[0]]
        codes = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        starts = chars[:-1] + np.arange(len(words))
        symbols = np.empty(len(codes) + len(words), np.int32)
        spot = np.ones(len(symbols), bool)
        spot[starts] = False
        symbols[starts], symbols[spot] = self.sign, self.of_char[codes]
        cut = np.zeros(len(symbols), bool)
        cut[starts] = True
        cut[1:] |= ~self.beside[symbols[:-1], symbols[1:]]
        heads = np.flatnonzero(cut)
        total, first = self.merge(symbols, heads)
        lead = np.searchsorted(heads, starts)
        return np.add.reduceat(total, lead), (first[lead] == self.sign).astype(np.int64)


_tables: dict[str, MergeTable] = {}


def table_of(path: str) -> MergeTable:
    if path not in _tables:
        _tables[path] = MergeTable(path)
    return _tables[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """The columns named in keep, the text's bytes in UTF-8, its tokens by the model at path, and whether these are over the limit."""
    clash = {*keep} & {*RESULT}
    if clash:
        raise ValueError(f"keep names columns of the result: {', '.join(sorted(clash))}")
    small_batches(docs.sparkSession, 8192)
    rows = docs.select(*keep, body(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = table.count(texts)
            sizes = pc.binary_length(texts.cast(pa.large_binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes, pa.array(n), pa.array(n > limit)], names=[*keep, *RESULT])

    return rows.mapInArrow(freeing(run), schema)


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_model())
