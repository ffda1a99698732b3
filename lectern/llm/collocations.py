"""Phrase collocations by hierarchical pair naming.

Texts become blocks of one language: a ragged array of word numbers, with a zero wherever a piece ends. Words of `least`
occurrences or more get ids. A phrase of k words is a pair of ids: its first k-1 words and its last k-1 words, which
stand next to each other in the array of phrases of k-1 words. Pairs are counted over all blocks, those of `least` occurrences get ids by a join on the pair, and
the ids replace the pairs in the blocks; so only phrases both of whose parts are frequent are ever counted.

An id's two parts are its parents. Along them each name inherits the counts of all its prefixes and suffixes, which
every cut of the phrase needs, and a phrase that stands inside a longer one as often as alone is found by one lookup: if a phrase has a longer one with its count,
then so has it one that is longer by a word, and that one's parents are ids.

Each block is counted before anything is shuffled, so a pair is sent once a block, however often it occurs. Up to NAMES_MOST names of a level
(NAMES_CHARS code points of words) are sent to the tasks, which then join in place. Beyond that bound the blocks' distinct pairs meet the names in a shuffled join
and come back by block; a table of 2^23 bits keeps pairs that can't be frequent from it, and lets all through where it is full. Both give the same rows.

Cases: null text is empty; null language is `und`; empty texts and texts of delimiters alone have no words; repeated rows count each;
very long texts are cut at the ends of pieces, which no phrase crosses; equal scores are ordered by count, then by the phrase's bytes; an empty
table gives an empty one; only lang and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm._shared import as_bytes, body, freeing, materialize, mix, remove_table, small_batches

LEAST, LONGEST, TOP = 100, 5, 2000
BLOCK_BYTES, FILTER_BITS, PIECE_ROWS = 4 << 20, 1 << 23, 1 << 18
NAMES_MOST, NAMES_CHARS, NARROW = 1 << 20, 1 << 24, 1 << 31
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ENDS, BLANKS = b".,;:!?\n\v\f\r", b" \t"
KIND = np.array([2 if b in ENDS else 1 if b in BLANKS else 0 for b in range(256)], np.uint8)
BLOCK = "block bigint, lang string, n_words bigint, words array<string>, counts array<bigint>, seq binary"


def pack(seq: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(seq.astype("<i4").tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")


def sliced(text: bytes, most: int = BLOCK_BYTES) -> list[bytes]:
    """The text in slices that end where a piece ends, of about `most` bytes."""
    out, start = [], 0
    while len(text) - start > most:
        ends = np.flatnonzero(KIND[np.frombuffer(text, np.uint8, len(text) - start - most, start + most)] == 2)[:1]
        if not len(ends):
            break
        end = start + most + int(ends[0])
        out.append(text[start:end])
        start = end
    return [*out, text[start:]]


def words_of(text: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(distinct words, their counts, the words' numbers from 1 on with zeros between pieces)."""
    raw = np.frombuffer(text.translate(LOWER), np.uint8)
    kind = KIND[raw]
    inside = np.concatenate([[False], kind == 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begins, stops = edge[::2], edge[1::2]
    if not len(begins):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(stops - begins)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw[kind == 0])]).dictionary_encode()
    at = words.indices.to_numpy()
    piece = np.cumsum(kind == 2, dtype=np.int32)[begins]
    opens = np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    seq = np.zeros(len(at) + int(opens[-1]), np.int32)
    seq[np.arange(len(at)) + opens] = at + 1
    return words.dictionary.cast(pa.binary()).to_pylist(), np.bincount(at), seq


def blocks_of(docs: DataFrame, text: str = "text", lang: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of about block_bytes of one language; a block's number is that of its task and its place there."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 24

        def block(tongue: str) -> pa.RecordBatch:
            nonlocal number
            words, counts, seq = words_of(b"\n".join(held.pop(tongue)))
            size.pop(tongue)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([tongue]), pa.array([int(counts.sum())]), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([pack(seq)], pa.binary())], names=["block", "lang", "n_words", "words", "counts", "seq"])

        for batch in batches:
            for tongue, value in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                for part in [value] if len(value) <= block_bytes else sliced(value, block_bytes):
                    held.setdefault(tongue, []).append(part)
                    size[tongue] = size.get(tongue, 0) + len(part) + 1
                    if size[tongue] >= block_bytes:
                        yield block(tongue)
            while sum(size.values()) > 4 * block_bytes:
                yield block(max(size, key=size.get))
        for tongue in list(held):
            yield block(tongue)

    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("l"), body(text).alias("t")).mapInArrow(freeing(build), BLOCK)


def neighbours(seq: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of neighbours that are both named: (first, second, count, places in seq, number of the pair at each place); names from 1 to m."""
    at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
    keys, which, counts = np.unique(seq[at].astype(np.int64) * (m + 1) + seq[at + 1], return_inverse=True, return_counts=True)
    return keys // (m + 1), keys % (m + 1), counts, at, which


def bit_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix(mix(a.astype(np.uint64)) ^ b.astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def bit_table(names: DataFrame) -> np.ndarray:
    """Bits of the pairs that have names; of a fixed size."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            table[bit_of(batch.column(0).to_numpy(), batch.column(1).to_numpy())] = True
        # Words of 63 bits, so that Spark's bit_or joins them; words without a bit aren't sent.
        words = np.packbits(table.reshape(-1, 32), axis=1).view(">u4").astype(np.int64).ravel()
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["w", "bits"])

    found = names.select("a", "b").mapInArrow(bits, "w bigint, bits bigint").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 32, ">u4")
    words[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return np.unpackbits(words.view(np.uint8)).astype(bool)


def dense(names: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """(names with ids from 1 on without gaps, how many): each row's place in its part, after the rows of the parts before; one count a part comes to the driver."""
    held = materialize(names.withColumn("__m", F.monotonically_increasing_id()), tag)
    part = F.shiftright("__m", 33)
    starts, n = [], 0
    for r in held.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r.part, n))
        n += r["count"]
    before = F.broadcast(names.sparkSession.createDataFrame(starts, "__part bigint, __before bigint").coalesce(1))
    rows = held.withColumn("__part", part).join(before, "__part")
    return rows.withColumn("id", F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__m", "__part", "__before"), n


def rebuilt(old: np.ndarray, slots: np.ndarray) -> bytes:
    """The array in which the slots' places have numbers from 1 on, in their order, and others are zero; places without a named neighbour are left out."""
    place = np.zeros(int(max(old.max(initial=0), slots.max(initial=0))) + 1, np.int32)
    place[slots] = np.arange(1, len(slots) + 1)
    new = np.concatenate([[0], place[old], [0]]).astype(np.int32)
    beside = (new[1:-1] > 0) & ((new[:-2] > 0) | (new[2:] > 0))
    new = np.where(beside, new[1:-1], 0)
    return pack(new[(new > 0) | np.concatenate([[False], new[:-1] > 0])])


def states(rows: list[tuple]) -> pa.RecordBatch:
    """Blocks (block, array, ids of its numbers)."""
    columns = list(zip(*((block, seq, ids.astype("<i8").tobytes(), len(ids)) for block, seq, ids in rows), strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["block", "seq", "ids", "m"])


STATE = "block bigint, seq binary, ids binary, m bigint"


def renamed(state: DataFrame, met: DataFrame, parts) -> DataFrame:
    """Blocks in which the parts' slots that met a name (block, slot, id) stand for it."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, seq, m, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                slots, ids = pairs.values.field(0).to_numpy(), pairs.values.field(1).to_numpy()
                out.append((block, rebuilt(parts(unpack(seq), m), slots), ids))
            yield states(out)

    held = met.groupBy("block").agg(F.collect_list(F.struct("slot", "id")).alias("pairs"))  # no more than a block has distinct phrases
    slim = state.select("block", "seq", F.col("m") if "m" in state.columns else F.lit(0).cast("bigint").alias("m"))
    return slim.join(held, "block").select("block", "seq", "m", "pairs").mapInArrow(freeing(build), STATE)


def name_words(blocks: DataFrame, least: int) -> tuple[DataFrame, int, DataFrame]:
    """(names of the frequent words, how many, blocks with ids)."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, counts = batch.column(2)[i].values, batch.column(3)[i].values
                for start in range(0, len(words), PIECE_ROWS):
                    part = words.slice(start, PIECE_ROWS)
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array(np.arange(start + 1, start + n + 1, dtype=np.int32)), pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([batch.column(1)[i].as_py()])).cast(pa.string()), part, counts.slice(start, PIECE_ROWS)], names=["block", "slot", "lang", "phrase", "n"])

    seen = blocks.select("block", "lang", "words", "counts").mapInArrow(freeing(flat), "block bigint, slot int, lang string, phrase string, n bigint")
    none = F.lit(None).cast("bigint")
    names, many = dense(seen.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "names-1")
    names = names.select("id", none.alias("a"), none.alias("b"), "f", "lang", "phrase", F.col("phrase").alias("last"), F.array().cast("array<bigint>").alias("heads"), F.array().cast("array<bigint>").alias("tails"))
    if many <= NAMES_MOST and (names.agg(F.sum(F.length("phrase")).alias("n")).first().n or 0) <= NAMES_CHARS:
        by_lang: dict[str, tuple[list, list]] = {}
        for r in names.select("lang", "phrase", "id").toArrow().to_batches():
            for tongue, word, i in zip(*(c.to_pylist() for c in r.columns), strict=True):
                own = by_lang.setdefault(tongue, ([], []))
                own[0].append(word), own[1].append(i)
        sent = blocks.sparkSession.sparkContext.broadcast({k: (pa.array(w, pa.string()), np.array(i, np.int64)) for k, (w, i) in by_lang.items()})

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for block, tongue, words, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                    known, ids = sent.value.get(tongue, (pa.array([], pa.string()), np.zeros(0, np.int64)))
                    at = pc.fill_null(pc.index_in(words.values, value_set=known), -1).to_numpy()
                    slots = np.flatnonzero(at >= 0)
                    out.append((block, rebuilt(unpack(seq), slots + 1), ids[at[slots]]))
                yield states(out)

        return names, many, blocks.select("block", "lang", "words", "seq").mapInArrow(freeing(put), STATE)
    met = seen.join(names.select("lang", "phrase", "id"), ["lang", "phrase"]).select("block", "slot", "id")
    return names, many, renamed(blocks, met, lambda seq, m: seq)


def pair_slots(seq: np.ndarray, m: int) -> np.ndarray:
    """The number from 1 on of the pair that begins at each place, zero where none does."""
    out = np.zeros(len(seq), np.int32)
    _, _, _, at, which = neighbours(seq, m)
    out[at] = which + 1
    return out


def name_pairs(state: DataFrame, before: DataFrame, many: int, least: int, last: bool) -> tuple[DataFrame, int, DataFrame | None]:
    """(names of the frequent pairs of ids, of which there are `many`; how many; blocks with their ids, none after the last level)."""
    narrow = many < NARROW  # two ids fit one number

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for block, seq, ids, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, seq = np.concatenate([[0], np.frombuffer(ids, "<i8")]), unpack(seq)
                first, second, counts, _, _ = neighbours(seq, m)
                yield block, seq, m, names[first], names[second], counts

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, a, b, counts in distinct(batches):
            order = np.lexsort((b, a))
            for start in range(0, len(a), PIECE_ROWS):
                at = order[start : start + PIECE_ROWS]
                keys = [pa.array(a[at] << 32 | b[at])] if narrow else [pa.array(a[at]), pa.array(b[at])]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(counts[at])], names=["k", "n"] if narrow else ["a", "b", "n"])

    rows = state.select("block", "seq", "ids", "m")
    keys = ["k"] if narrow else ["a", "b"]
    seen = rows.mapInArrow(freeing(pairs), "k bigint, n bigint" if narrow else "a bigint, b bigint, n bigint").groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    if narrow:
        seen = seen.select(F.shiftright("k", 32).alias("a"), F.col("k").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "f")
    numbered, found = dense(seen, "pairs")
    left = before.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("__first"), F.concat("heads", F.array("f")).alias("heads"))
    right = before.select(F.col("id").alias("b"), "last", F.concat("tails", F.array("f")).alias("tails"))
    names = numbered.join(left, "a").join(right, "b").select("id", "a", "b", "f", "lang", F.concat("__first", F.lit(" "), "last").alias("phrase"), "last", "heads", "tails")
    names = materialize(names, "names")
    if last:
        return names, found, None
    if narrow and found <= NAMES_MOST:
        known = numbered.select("a", "b", "id").toArrow()
        key = known.column("a").to_numpy() << 32 | known.column("b").to_numpy()
        order = np.argsort(key)
        sent = state.sparkSession.sparkContext.broadcast((key[order], known.column("id").to_numpy()[order]))

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, ids = sent.value
            for block, seq, m, a, b, _ in distinct(batches):
                asked = a << 32 | b
                at = np.minimum(np.searchsorted(key, asked), max(0, len(key) - 1))
                slots = np.flatnonzero(key[at] == asked) if len(key) else np.zeros(0, np.int64)
                yield states([(block, rebuilt(pair_slots(seq, m), slots + 1), ids[at[slots]])])

        return names, found, rows.mapInArrow(freeing(put), STATE)
    bits = state.sparkSession.sparkContext.broadcast(np.packbits(bit_table(numbered)))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits.value).astype(bool)
        for block, _, _, a, b, _ in distinct(batches):
            some = np.flatnonzero(table[bit_of(a, b)])
            for start in range(0, len(some), PIECE_ROWS):
                at = some[start : start + PIECE_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block, np.int64)), pa.array((at + 1).astype(np.int32)), pa.array(a[at]), pa.array(b[at])], names=["block", "slot", "a", "b"])

    met = rows.mapInArrow(freeing(asked), "block bigint, slot int, a bigint, b bigint").join(numbered.select("a", "b", "id"), ["a", "b"]).select("block", "slot", "id")
    return names, found, renamed(state, met, pair_slots)


def phrase_names(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """(words by language, names of phrases by their number of words, from one word on)."""
    small_batches(docs.sparkSession)
    blocks = materialize(blocks_of(docs, text, lang, block_bytes), "blocks")
    totals = materialize(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    names, many, state = name_words(blocks, least)
    levels = [names]
    held, state = blocks, materialize(state, "state")
    remove_table(held)
    for k in range(2, longest + 1):
        names, many, new = name_pairs(state, levels[-1], many, least, k == longest)
        levels.append(names)
        if new is not None:
            held, state = state, materialize(new, "state")
            remove_table(held)
    remove_table(state)
    return totals, levels


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Phrases of 2 to `longest` words that no longer one of the same count holds: lang, phrase, k, a, l, r, n and score, by the cut of the lowest score (of equals the smallest)."""
    totals, levels = phrase_names(docs, least, longest, text, lang, block_bytes)
    kept = []
    for k in range(2, longest + 1):
        names = levels[k - 1]
        if k < longest:
            longer = levels[k]
            inside = longer.where(F.col("f") == F.element_at("heads", -1)).select(F.col("a").alias("id")).union(longer.where(F.col("f") == F.element_at("tails", -1)).select(F.col("b").alias("id")))
            names = names.join(inside, "id", "left_anti")
        kept.append(names.withColumn("k", F.lit(k)))
    rows = reduce(DataFrame.unionByName, kept).join(totals, "lang")
    score = "(cast(1000 as decimal(4,0)) * cast(f as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(heads[c - 1] as decimal(19,0)) * cast(tails[k - c - 1] as decimal(19,0)))"
    cut = F.expr(f"array_min(transform(sequence(1, k - 1), c -> struct({score} as score, c as c, heads[c - 1] as l, tails[k - c - 1] as r)))")
    return rows.withColumn("cut", cut).select("lang", "phrase", "k", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def top_collocations(docs: DataFrame, top: int = TOP, **how) -> DataFrame:
    """The first `top` collocations of each language, with their rank from 1 on."""
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return collocations(docs, **how).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
inside AS (SELECT DISTINCT x.lang, array_to_string(x.w[i : i + j - 1], ' ') AS phrase, x.f FROM c x, range(2, 5) t(j), range(1, 5) u(i) WHERE j < x.k AND i + j - 1 <= x.k),
cuts AS (SELECT c.lang, c.k, c.phrase, c.f, s AS s, array_to_string(c.w[1:s], ' ') AS head, array_to_string(c.w[s + 1:], ' ') AS tail FROM c, range(1, 5) t(s) WHERE s < c.k AND NOT EXISTS (FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.f)),
scored AS (SELECT u.lang, u.phrase, u.f AS a, h.f AS l, t.f AS r, n.n, u.s, CAST((1000::HUGEINT * u.f * n.n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score FROM cuts u JOIN f h ON h.lang = u.lang AND h.phrase = u.head JOIN f t ON t.lang = u.lang AND t.phrase = u.tail JOIN n ON n.lang = u.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, s) = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000"""
