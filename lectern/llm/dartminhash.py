"""Near-duplicate detection with DartMinHash signatures and banded joining.

A text is the weighted set of its five-word shingles, the weight being the count.
Each shingle owns a region of ranks and weights, cut at the powers of two; a hashed Poisson
process throws darts into each part, in the order of their rank, until the text's
rank limit, which shrinks as its weight grows, so about k ln k darts are made
whatever the length. A dart counts if it falls below the shingle's weight. Its hash names one of K coordinates; the earliest dart
of each coordinate is kept. Two texts agree on a coordinate with the probability
of their weighted Jaccard similarity. A text with an empty coordinate doubles
its limit and throws on.

Exactly equal texts are one node from the start. ROWS coordinates make a band;
nodes that share a band's key meet in a bucket, where each is paired with the
bucket's least and greatest node, and one that agrees with neither with the
node of most links there. Pairs are checked exactly (weighted Jaccard of at least
THRESHOLD, over 64-bit shingles). Where a bucket's nodes are still of several components, all of them
go to an exact join: two sets that reach THRESHOLD share one of their rarest
strips, the smaller among 1/9 of its own and the larger among 1/5. So each pair
that shares a bucket is of one component or was found unlike. Classes are the
connected components of the links, found by hooking nodes to their least neighbours, following
the hooks and contracting the links, over written tables. Texts travel only if they share a bucket: a bounded bit
table of their digests, a filter that lets some others through, is broadcast first.

Result: a row for each document with class_id (the least doc_id of its class),
n_copies (rows with its text) and n_links (checked links of its text).

Cases: null text is empty; texts of one to four words are one shingle; texts
without a word are near only to equal texts; a class is named by the least id that
any of its rows has, null if none has one; different texts that
share a doc_id are nodes of their own; repeated rows repeat; an
empty table gives an empty one; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm._shared import as_bytes, body, freeing, materialize, mix, small_batches, unit

SHINGLE, THRESHOLD, K, ROWS = 5, 0.8, 64, 4
#: Cells of the counts that tell rare strips from frequent ones.
CELLS = 2**18
#: Bits of the table that says which texts share a bucket: rows of 64 bits, so at most 131,072 rows are broadcast.
FILTER_BITS = 2**23


def digest() -> Column:
    return F.md5(F.encode(body(), "utf-8"))


class WordHashes(dict):
    """64-bit hashes of words; emptied when it holds many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(texts: list[bytes], words: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' places, the hashes of their distinct shingles, in order, and their counts."""
    hashed = [np.fromiter(map(words.__getitem__, t.lower().split()), np.uint64) for t in texts]
    n = np.array([len(h) for h in hashed])
    flat = np.concatenate([*hashed, np.zeros(SHINGLE, np.uint64)])
    doc = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    sh = np.zeros(len(doc), np.uint64)
    inside = np.minimum(n, SHINGLE)[doc]
    for j in range(SHINGLE):
        step = mix(flat[j : len(doc) + j] + np.uint64(j + 1))
        sh = np.where(j < inside, mix(sh * np.uint64(31) + step), sh)
    whole = place <= np.maximum(n - SHINGLE, 0)[doc]
    doc, sh = doc[whole], sh[whole]
    order = np.lexsort((sh, doc))
    doc, sh = doc[order], sh[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (sh[1:] != sh[:-1])
    at = np.flatnonzero(fresh)
    return doc[at], sh[at], np.diff(at, append=len(doc))


def strips(doc: np.ndarray, sh: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles as sets: one strip for each unit of weight."""
    row = np.repeat(np.arange(len(sh)), count)
    nth = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
    return doc[row], np.where(nth == 0, sh[row], mix(sh[row] + nth * np.uint64(0x9E3779B97F4A7C15)))


def signatures(doc: np.ndarray, sh: np.ndarray, count: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """(n_docs, k): the earliest dart of each coordinate, rank in the high and name in the low bits; 0 rows for documents without a shingle."""
    weight = np.bincount(doc, count, n_docs)
    limit = np.divide(k * (np.log(k) + 2), weight, out=np.zeros(n_docs), where=weight > 0)
    # Parts of a shingle's region by weight: [0, 1), [1, 2), [2, 4), [4, 8), ... below its count.
    levels = 1 + np.ceil(np.log2(count)).astype(np.int64)
    row = np.repeat(np.arange(len(sh)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width, most = np.maximum(low, 1.0), count[row]
    part = np.where(level == 0, sh[row], mix(sh[row] + level.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    doc = doc[row]
    none = np.uint64(2**64 - 1)
    out = np.full((n_docs, k), none)
    left = weight > 0
    while left.any():
        cells = np.full(n_docs * k, none)
        pick = np.flatnonzero(left[doc])
        rank, d = np.zeros(len(pick)), 0
        while len(pick):
            d += 1
            h = mix(part[pick] + np.uint64(d * 0xC2B2AE3D27D4EB4F % 2**64))
            rank = rank - np.log(unit(h)) / width[pick]  # gaps of a Poisson process whose rate is the part's width
            keep = rank < limit[doc[pick]]
            pick, rank, h = pick[keep], rank[keep], h[keep]
            name = mix(h ^ np.uint64(0x5851F42D4C957F2D))
            hit = (level[pick] == 0) | (low[pick] + width[pick] * unit(mix(name + np.uint64(1))) <= most[pick])
            at, name, own = doc[pick[hit]], name[hit], rank[hit]
            packed = (own.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF))
            np.minimum.at(cells, at * k + ((name >> np.uint64(32)) % np.uint64(k)).astype(np.int64), packed)
        cells = cells.reshape(n_docs, k)
        full = left & (cells != none).all(axis=1)
        out[full] = cells[full]
        left &= ~full
        limit *= 2
    out[weight == 0] = 0
    return out


def banded(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n, k / rows): keys of the bands."""
    parts = sig.reshape(len(sig), -1, rows)
    key = np.zeros(parts.shape[:2], np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(31) + parts[:, :, j])
    return key.view(np.int64)


def band_keys(docs: DataFrame) -> DataFrame:
    """id, h (the text's digest), bands (array; null for a text without words)."""
    small_batches(docs.sparkSession, 1024)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), digest().alias("h"), body().alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            texts = as_bytes(batch.column(2))
            doc, sh, count = shingles(texts, words)
            keys = banded(signatures(doc, sh, count, len(texts)))
            some = np.bincount(doc, minlength=len(texts)) > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x if s else None for x, s in zip(keys, some, strict=True)], pa.list_(pa.int64()))], names=["id", "h", "bands"])

    return rows.mapInArrow(freeing(run), "id bigint, h string, bands array<bigint>")


def strip_sets(texts: DataFrame) -> DataFrame:
    """id and its sorted strips (64 bits each, as bytes), from id and t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            doc, e = strips(*shingles(as_bytes(batch.column(1)), words))
            cut = np.searchsorted(doc, np.arange(1, batch.num_rows))
            sets = [np.sort(x).tobytes() for x in np.split(e, cut)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "s"])

    return texts.select("id", "t").mapInArrow(freeing(run), "id bigint, s binary")


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, near of pairs (a, b): whether the weighted Jaccard similarity reaches the threshold."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                lo, hi = sorted((len(x), len(y)))
                if lo < threshold * hi:
                    near.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                near.append(shared >= threshold * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    return two.mapInArrow(freeing(run), "a bigint, b bigint, near boolean")


def ends_of_buckets(entries: DataFrame) -> DataFrame:
    """Entries (band, key, id) whose bucket has others, with the bucket's least and greatest node."""
    buckets = entries.groupBy("band", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    return entries.join(buckets, ["band", "key"])


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def most_linked(met: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs of members that agree with neither end of their bucket, and its member of most links."""
    links = both_ways(near)
    alone = met.where("id > lo and id < hi")
    for end in ("lo", "hi"):
        alone = alone.join(links.select(F.col("a").alias("id"), F.col("b").alias(end)), ["id", end], "left_anti")
    degree = links.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    hubs = met.join(degree, "id").groupBy("band", "key").agg(F.max(F.struct("n", "id"))["id"].alias("hub"))
    pairs = alone.join(hubs, ["band", "key"]).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    return pairs.where("a < b").distinct()


def mixed(met: DataFrame, label: DataFrame) -> DataFrame:
    """id and label of all members of buckets in which several components meet."""
    at = met.select("band", "key", "id").join(label, "id", "left").select("band", "key", "id", F.coalesce("label", "id").alias("label"))
    several = at.groupBy("band", "key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    return at.join(several, ["band", "key"], "left_semi").select("id", "label").distinct()


def cell_counts(sets: DataFrame) -> np.ndarray:
    """How many strips of the sets fall in each cell, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8") % CELLS, minlength=CELLS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["cell", "n"])

    got = sets.select("s").mapInArrow(freeing(run), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    return counts


def rare_strips(sets: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """strip, id, label, size, place: the strips of each set, in one order for all and rare ones first, that a set as small as the threshold allows must meet; first: whether a larger set must meet it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare, size = [], np.zeros(batch.num_rows, np.int64)
            for k, s in enumerate(batch.column(2).to_pylist()):
                x = np.frombuffer(s, "<u8")
                size[k] = len(x)
                rare.append(x[np.lexsort((x, counts[x % CELLS]))][: len(x) - int(np.ceil(threshold * len(x) - 1e-9)) + 1])
            n = np.fromiter(map(len, rare), np.int64, len(rare))
            row = np.repeat(np.arange(len(rare)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = place <= size[row] - np.ceil(2 * threshold / (1 + threshold) * size[row] - 1e-9)
            strip = np.concatenate([*rare, np.zeros(0, "<u8")]).view(np.int64)
            columns = [pa.array(strip), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(size[row]), pa.array(place), pa.array(first)]
            yield pa.RecordBatch.from_arrays(columns, names=["strip", "id", "label", "size", "place", "first"])

    schema = "strip bigint, id bigint, label bigint, size bigint, place bigint, first boolean"
    return sets.select("id", "label", "s").mapInArrow(freeing(run), schema)


def rare_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of sets (id, label, s) of different labels that may reach the threshold; none that reaches it is left out."""
    strips = materialize(rare_strips(sets, cell_counts(sets), threshold), "rare")
    several = strips.groupBy("strip").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    strips = strips.join(several, "strip", "left_semi")
    x, y = strips.where("first").alias("x"), strips.alias("y")
    ordered = "(x.size < y.size or x.size = y.size and x.id < y.id) and x.label <> y.label"
    # From the first strip that two sets share, in the order, there are enough left in both.
    enough = f"x.size >= {threshold} * y.size - 1e-6 and least(x.size - x.place, y.size - y.place) * {1 + threshold} >= {threshold} * (x.size + y.size) - 1e-6"
    pairs = x.join(y, F.expr(f"x.strip = y.strip and {ordered} and {enough}"))
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def bit_table(keys: DataFrame, key: str) -> DataFrame:
    """The bits that the keys set, 64 in a row (__at, __bits): a filter without false negatives of at most FILTER_BITS bits, whatever the number of keys."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    rows = keys.select(F.floor(bit / 64).cast("bigint").alias("__at"), (bit % 64).cast("int").alias("b"))
    return rows.groupBy("__at").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("__bits"))


def flagged(rows: DataFrame, key: str, bits: DataFrame, out: str) -> DataFrame:
    """rows with out: whether the key's bit is set."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    rows = rows.withColumn("__at", F.floor(bit / 64).cast("bigint")).withColumn("__b", (bit % 64).cast("int"))
    met = rows.join(F.broadcast(bits), "__at", "left")
    return met.withColumn(out, F.coalesce(F.expr("shiftrightunsigned(__bits, __b) & 1L = 1L"), F.lit(False))).drop("__at", "__b", "__bits")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and strips of the texts of nodes (id, h). The filter keeps other texts from the exchange; each text is taken once."""
    rows = docs.select(digest().alias("h"), body().alias("t"))
    some = flagged(rows, "h", bit_table(wanted, "h"), "__hit").where("__hit").groupBy("h").agg(F.any_value("t").alias("t"))
    return strip_sets(some.join(wanted, "h"))


def links(nodes: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Checked links (a, b), a < b, between nodes (id, h, bands), and id and label of all ids in them."""
    entries = nodes.where("bands is not null").select("id", F.posexplode("bands").alias("band", "key"))
    met = materialize(ends_of_buckets(entries), "buckets")
    pair = lambda c: F.struct(F.least("id", c).alias("a"), F.greatest("id", c).alias("b"))
    pairs = met.select(F.explode(F.array(pair("lo"), pair("hi"))).alias("p")).select("p.a", "p.b").where("a < b").distinct()
    wanted = materialize(met.select("id").distinct().join(nodes.select("id", "h"), "id"), "wanted")
    sets = materialize(sets_of(docs, wanted), "strips")
    ends = materialize(similar(pairs, sets, threshold), "links")
    more = most_linked(met, ends.where("near")).join(ends, ["a", "b"], "left_anti")
    known = materialize(ends.unionByName(similar(more, sets, threshold)), "links")
    near = known.where("near").select("a", "b")
    label = components(near)
    left = materialize(mixed(met, label), "mixed")
    rest = rare_pairs(sets.join(left, "id"), threshold).join(known, ["a", "b"], "left_anti")
    late = materialize(similar(rest, sets, threshold).where("near").select("a", "b"), "links")
    # What is known of the components stays: only links between them are left to follow.
    fresh = late.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(label, "id", "left_anti").select("id", F.col("id").alias("label"))
    label = relabelled(label.unionByName(fresh), components(contracted(late, label)))
    return near.unionByName(late), label


def ended(hooks: DataFrame) -> DataFrame:
    """id and label, the end of the hooks (id, label) that lead on from id; every label is an id, too."""
    while True:
        on = hooks.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = materialize(hooks.join(on, "label").select("id", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")), "hooks")
        moved = step.where("moved").limit(1).count()
        hooks = step.select("id", "label")
        if not moved:
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """id and label (the least id of its component), of all ids in edges.

    Each round hooks every node to its least neighbour and puts the ends of the hooks in place of the nodes. A node that
    is left has taken in another at least, and edges within one are gone: so an edge is joined in a few rounds, however long a component's paths are.
    """
    label = None
    while True:
        hooks = ended(materialize(both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "hooks"))
        label = hooks if label is None else relabelled(label, hooks)
        edges = materialize(contracted(edges, hooks), "edges")
        if not edges.limit(1).count():
            return label


def relabelled(label: DataFrame, by: DataFrame) -> DataFrame:
    """label (id, label) after its labels have got labels of their own; those that have none stay."""
    new = by.select(F.col("id").alias("label"), F.col("label").alias("new"))
    return materialize(label.join(new, "label", "left").select("id", F.coalesce("new", "label").alias("label")), "labels")


def contracted(edges: DataFrame, label: DataFrame) -> DataFrame:
    """The edges between labels; an id without one stands for itself."""
    for end in ("a", "b"):
        own = label.select(F.col("id").alias(end), F.col("label").alias("new"))
        edges = edges.join(own, end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def told(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of docs: its id, its text's digest h, the class's number and name, n_copies and n_links."""
    keys = materialize(band_keys(docs), "bands")
    nodes = keys.groupBy("h").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands"))
    # Numbers in the order of the least ids, as an original mostly comes before its copies and then is the end of most of
    # their buckets; written once, so they stay.
    nodes = materialize(nodes.orderBy(F.col("least").asc_nulls_last(), "h").withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges, label = links(nodes.select("h", F.col("node").alias("id"), "bands"), docs, threshold)
    degree = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    linked = materialize(label.join(degree, "id").join(nodes.select(F.col("node").alias("id"), "least"), "id"), "linked")
    named = linked.groupBy("label").agg(F.min("least").alias("name"))
    linked = linked.join(named, "label").select(F.col("id").alias("node"), "label", "name", "n_links")
    texts = nodes.select("h", "node", "least", "n_copies").join(linked, "node", "left")
    texts = texts.select("h", F.coalesce("label", "node").alias("class"), F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("name")).alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    return keys.select("id", "h").join(texts, "h")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_copies, n_links for each row of docs."""
    return told(docs, threshold).select(F.col("id").alias("doc_id"), "class_id", "n_copies", "n_links")


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs for each class: of its least doc_id (rows without an id last), then least digest.

    Of rows that share an id and a text, the one with the least hash of all columns stays. Only rows that may go, or have
    equals, are shuffled with their texts: a filter lets all others pass where they lie.
    """
    key = lambda i, h: F.concat(F.coalesce(i.cast("bigint").cast("string"), F.lit("-")), F.lit(":"), h)
    rows = told(docs).withColumn("key", key(F.col("id"), F.col("h")))
    rows = materialize(rows.groupBy("key", "id", "h", "class").agg(F.count(F.lit(1)).alias("n")), "rows")
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("id").isNull(), "id", "h", "key"))["key"].alias("first"))
    checked = materialize(rows.join(first, "class").withColumn("stays", F.col("key") == F.col("first")).where("not stays or n > 1").select("key", "stays"), "checked")
    own = docs.select(F.struct(*docs.columns).alias("__row"), key(F.col("doc_id"), digest()).alias("__key"))
    own = flagged(own, "__key", bit_table(checked, "key"), "__hit")
    passed = own.where("not __hit").select("__row")
    met = own.where("__hit").join(checked.withColumnRenamed("key", "__key"), "__key", "left")
    alone = met.where("stays is null").select("__row")
    one = met.where("stays").groupBy("__key").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row")).select("__row")
    return passed.unionAll(alone).unionAll(one).select("__row.*")
