"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 code points cuts each text where its low bits
are zero (chunks have an eighth to eight times the average length), so a passage that many documents hold gives the same chunks wherever
it stands. A first pass counts the chunks of all documents by their hashes; those that
spare most code points, up to DICTIONARY_CHARS in all, are encoded once and sent to all
workers. A worker keeps the other chunks that it meets in a bounded table, which lives
on over batches and tasks.

A chunk is encoded on its own between borders: places where every text has a
pre-token's end, whatever stands further away (one space between characters that aren't
white space, or a CJK letter before CJK punctuation). A join of two chunks is repaired by encoding anew
what lies around it, from the last but one border of the left chunk to the second of the right. If that
begins and ends with the very ids that the chunks have there, the ids between are spliced in; if not, both chunks are
taken up into the window, which grows until it agrees. So the joined ids are those of the whole text.

Cases: null text is empty; empty text has no ids and hashes of nothing; a very
long text is worked through chunk by chunk, and a stretch without a border in one piece, whatever its length; repeated rows give repeated rows;
an empty table gives an empty one; only the named columns are read, so other
columns may have any name; a column of `keep` named like one of the result is an error.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm._shared import body, freeing, small_batches

SPECIAL = "<|endoftext|>"
BORDER = re.compile(r"(?<=\S) (?=\S)|(?<=[ぁ-ゖァ-ヺ一-龥가-힣])(?=[，。、！？；：「」（）])")
#: The pattern's white space; runs beyond LONG_RUN are too deep for its matcher.
LONG_RUN = 4096
BLANKS = re.compile(f"[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{{{LONG_RUN},}}")
WINDOW, AVERAGE, REUSE_CHARS = 16, 1024, 6 << 20
DICTIONARY_CHARS, DICTIONARY_CHUNKS, FLUSH = 4 << 20, 1 << 16, 200_000


def cuts(text: str, average: int = AVERAGE) -> list[int]:
    """Ends of the chunks; each depends on the 16 code points before it, and on the cut before it alone."""
    if len(text) <= WINDOW:
        return [len(text)] if text else []
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    step, base = 1, 0x01000193
    while step < WINDOW:
        h = h[:-step] * np.uint32(base) + h[step:]
        step, base = step * 2, base * base % 2**32
    ends, last = [], 0
    for end in [*(np.flatnonzero((h >> np.uint32(8)) & np.uint32(average - 1) == 0) + WINDOW).tolist(), len(text)]:
        while end - last > 8 * average:
            last += 8 * average
            ends.append(last)
        if end - last >= average // 8 or end == len(text) and end > last:
            ends.append(end)
            last = end
    return ends


class Chunk:
    """A chunk's text before its first border, ids from there to its last border, text after that; the stretches next to either border serve as checks."""

    __slots__ = ("core", "first", "head", "last", "tail", "text")

    def __init__(self, text: str, encode):
        self.text, self.core = text, None
        front = [m.start() for _, m in zip(range(4), BORDER.finditer(text))]
        if len(front) < 4:
            return
        back = max(0, len(text) - 96)
        ends = [m.start() for m in BORDER.finditer(text, back)]
        while len(ends) < 2:
            back = max(0, back - 512)
            ends = [m.start() for m in BORDER.finditer(text, back)]
        a, b, c, d = front[0], front[1], ends[-2], ends[-1]
        if not a < b <= c < d:
            return
        self.head, self.tail = text[:a], text[d:]
        self.first, self.last = (text[a:b], encode(text[a:b])), (text[c:d], encode(text[c:d]))
        self.core = encode(text[b:c])


class ChunkCoder:
    """Encodes and decodes as the vocabulary's own library does; keeps the ids of chunks that it has seen."""

    def __init__(self, path: str, average: int = AVERAGE, reuse_chars: int = REUSE_CHARS):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        letters = printable()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.coder = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special, self.average, self.limit = special[SPECIAL], average, reuse_chars
        self.shared: dict[str, Chunk] = {}
        self.young: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}
        self.held = self.chunks = self.reused = self.fresh = self.from_shared = self.grown = 0

    def piece(self, text: str) -> array:
        """Ids of a text. A long run of white space is one pre-token, but for its last character where another one follows, which goes with what follows."""
        if len(text) < LONG_RUN:
            return array("I", self.coder.encode_ordinary(text))
        ids, at = array("I"), 0
        for m in BLANKS.finditer(text):
            end = m.end() - (m.end() < len(text))
            ids.extend(self.coder.encode_ordinary(text[at : m.start()]))
            ids.extend(self.coder._encode_single_piece(text[m.start() : end]))
            at = end
        ids.extend(self.coder.encode_ordinary(text[at:]))
        return ids

    def inside(self, text: str) -> Chunk:
        self.chunks += 1
        kept = self.shared.get(text)
        if kept is not None:
            self.from_shared += 1
            return kept
        kept = self.young.get(text)
        if kept is not None:
            self.reused += 1
            return kept
        kept = self.old.get(text)
        if kept is None:
            self.fresh += 1
            kept = Chunk(text, self.piece)
        else:
            self.reused += 1
        if self.held > self.limit // 2:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[text] = kept
        self.held += len(text)
        return kept

    def join(self, before: tuple[str, array], window: str, after: tuple[str, array]) -> array | None:
        """Ids of the window if its encoding, with the stretches before and after, agrees with theirs."""
        ids = self.piece(before[0] + window + after[0])
        m, n = len(before[1]), len(ids) - len(after[1])
        return ids[m:n] if m <= n and ids[:m] == before[1] and ids[n:] == after[1] else None

    def encode(self, text: str) -> array:
        ids, nothing = array("I"), ("", array("I"))
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                ids.append(self.special)
            before, window, start = nothing, "", 0
            mark, left, since = len(ids), nothing, ""  # to where ids stand without the last chunk; what stood before it; the text since
            for end in cuts(part, self.average):
                chunk = self.inside(part[start:end])
                start = end
                if chunk.core is None:
                    window += chunk.text
                    since += chunk.text
                    continue
                between = self.join(before, window + chunk.head, chunk.first)
                if between is None:
                    self.grown += 1
                    del ids[mark:]
                    since += chunk.text
                    before, window = left, since
                    continue
                mark, left, since = len(ids), before, window + chunk.text
                for x in (between, chunk.first[1], chunk.core, chunk.last[1]):
                    ids.extend(x)
                before, window = chunk.last, chunk.tail
            rest = self.join(before, window, nothing)
            if rest is None:
                del ids[mark:]
                # What stood before the last chunk agreed with it at a border, so the rest can be encoded from there.
                rest = self.piece(since)
            ids.extend(rest)
        return ids

    def decode(self, ids: array) -> bytes:
        return self.coder.decode_bytes(ids.tolist())


def printable() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_coders: dict[str, ChunkCoder] = {}


def coder_of(path: str) -> ChunkCoder:
    if path not in _coders:
        _coders[path] = ChunkCoder(path)
    return _coders[path]


def chunk_hash(text: str) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(text.encode())
    return (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63


def shared_chunks(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", chars: int = DICTIONARY_CHARS, average: int = AVERAGE) -> list[tuple]:
    """Chunks (text, ids by stretch) that occur twice or more over all documents and spare most, up to chars code points and DICTIONARY_CHUNKS chunks; each encoded once.

    A chunk is found again through the least id of its documents; rows without an id name none.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        where: dict[tuple, tuple[int, int]] = {}

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([k[0] for k in keys], [k[1] for k in keys], [seen[k] for k in keys], [where[k][0] for k in keys], [where[k][1] for k in keys])], names=["a", "b", "n", "chars", "doc"])
            seen.clear(), where.clear()
            return out

        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in value.split(SPECIAL):
                    start = 0
                    for end in cuts(part, average):
                        key = chunk_hash(part[start:end])
                        seen[key] += 1
                        if key not in where or i < where[key][1]:
                            where[key] = end - start, i
                        start = end
            if len(seen) > FLUSH:
                yield flush()
        yield flush()

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("i"), body(text).alias("t"))
    counted = rows.mapInArrow(freeing(count), "a bigint, b bigint, n bigint, chars bigint, doc bigint").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("chars").alias("chars"), F.min("doc").alias("doc"))
    top = counted.where("n > 1").orderBy(F.desc(F.expr("(n - 1) * chars")), "a", "b").limit(DICTIONARY_CHUNKS).collect()
    wanted, ids, room = set(), set(), chars
    for r in top:
        room -= r.chars
        if room < 0:
            break
        wanted.add((r.a, r.b))
        ids.add(r.doc)
    if not wanted:
        return []
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    few = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "i bigint").coalesce(1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, done = coder_of(path), set()
        for batch in batches:
            out = []
            for value in batch.column(0).to_pylist():
                for part in value.split(SPECIAL):
                    start = 0
                    for end in cuts(part, average):
                        piece, start = part[start:end], end
                        key = chunk_hash(piece)
                        if key in sent.value and key not in done:
                            done.add(key)
                            c = Chunk(piece, coder.piece)
                            if c.core is not None:
                                out.append((*key, piece, *(x.tolist() for x in (c.first[1], c.core, c.last[1]))))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3), strict=True)], names=["a", "b", "t", "x", "y", "z"])

    found = rows.join(few, "i", "left_semi").select("t").mapInArrow(freeing(encode), "a bigint, b bigint, t string, x array<bigint>, y array<bigint>, z array<bigint>")
    return [(r.t, r.x, r.y, r.z) for r in found.dropDuplicates(["a", "b"]).collect()]  # at most `chars` code points


def known_chunks(coder: ChunkCoder, rows: list[tuple]) -> None:
    """Gives the coder the chunks of shared_chunks()."""
    coder.shared = {}
    for text, *ids in rows:
        ready = iter([array("I", ids[0]), array("I", ids[2]), array("I", ids[1])])  # in the order in which a chunk asks for them
        coder.shared[text] = Chunk(text, lambda _, ready=ready: next(ready))


RESULT = ("n_tokens", "ids", "ids_sha256", "decoded_sha256", "exact", "n_chunks", "n_shared")


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, shared: list[tuple] | None = None) -> DataFrame:
    """The columns named in keep, n_tokens, ids (if asked for), the hashes of ids and of the decoded text, whether decoding gave the text back, the text's chunks and how many of them came from the shared ones."""
    clash = {*keep} & {*RESULT}
    if clash:
        raise ValueError(f"keep names columns of the result: {', '.join(sorted(clash))}")
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, body(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n_tokens bigint" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string, exact boolean, n_chunks bigint, n_shared bigint"
    sent = docs.sparkSession.sparkContext.broadcast(shared or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        known_chunks(coder, sent.value)
        for batch in batches:
            n, all_ids, digest, decoded, exact, chunks, met = [], [], [], [], [], [], []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                coder.chunks = coder.from_shared = 0
                out = coder.encode(value)
                back = coder.decode(out)
                n.append(len(out))
                digest.append(hashlib.sha256(out.tobytes() if out.itemsize == 4 else np.array(out, "<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                exact.append(back == value.encode())
                chunks.append(coder.chunks)
                met.append(coder.from_shared)
                if ids:
                    all_ids.append(np.frombuffer(out, np.int32) if len(out) else np.empty(0, np.int32))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(n, pa.int64())]
            if ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            columns += [pa.array(digest, pa.string()), pa.array(decoded, pa.string()), pa.array(exact, pa.bool_()), pa.array(chunks, pa.int64()), pa.array(met, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(x for x in RESULT if ids or x != "ids")])
        coder.shared = {}

    return rows.mapInArrow(freeing(run), schema)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """rows with the text of their ids; null ids give null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` string"
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in batches:
            texts = [None if x is None else coder.decode(array("I", x)).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return rows.mapInArrow(freeing(run), schema)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary()
    out = encode_documents(docs, path, ids=False, shared=shared_chunks(docs, path))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("exact").alias("round_trip"), "n_chunks", "n_shared")
