"""V3, V4: an exact index that leaves rows unread.

Each vector belongs to its nearest pivot, and its distance to it is stored. A pivot's vectors are cut into rings by that distance, so a
block is a ring around a pivot with a known least and greatest distance. For a query at distance t from the pivot, no
vector of the ring can be nearer than the gap between t and the ring (triangle inequality). A first
pass reads each query's nearest block or blocks, which bounds its k-th distance; a second one reads the blocks whose gap is within
the bound. So the answer is that of the flat search, ties included.

Blocks are partitions of a Parquet table: those that no query needs aren't opened. Pivots are chosen
on a bounded sample (SAMPLE rows, by the hash of the id), which affects what is skipped, never what is found; every vector is indexed. There are at most
MOST_BLOCKS blocks: they grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.operators.vectors import CELLS, Distances, Nearest, blocks_of, matrix, ranked, squared

SAMPLE, BLOCK_ROWS, MOST_BLOCKS, BINS = 20_000, 4_096, 4_096, 256
#: Squared distances are rounded; a bound is widened by so much, so that no tie is lost.
SLACK = 1e-9


@dataclass
class PivotIndex:
    """Where the blocks are, the pivots, and each block's pivot, least and greatest distance and rows."""

    path: str
    pivots: np.ndarray
    of: np.ndarray
    least: np.ndarray
    most: np.ndarray
    rows: np.ndarray

    def gaps(self, m: np.ndarray) -> np.ndarray:
        """For each query and block, what every vector of the block is away at least."""
        t = np.sqrt(squared(m, self.pivots))[:, self.of]
        return np.maximum(0.0, np.maximum(self.least[None] - t, t - self.most[None]) - SLACK * (1.0 + t))


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each the farthest from those before it; the first is the one farthest from the mean."""
    if not len(sample):
        return sample
    far = squared(sample.mean(axis=0, keepdims=True), sample)[0]
    chosen = [int(far.argmax())]
    far = squared(sample[chosen], sample)[0]
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(sample[chosen[-1:]], sample)[0])
    return sample[chosen]


def centred(sample: np.ndarray, pivots: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Pivots moved to the means of the sample's rows that are nearest to them, a few times."""
    for _ in range(rounds if len(sample) else 0):
        own = np.concatenate([squared(sample[i : i + 4096], pivots).argmin(axis=1) for i in range(0, len(sample), 4096)])
        n = np.bincount(own, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, sample)
        pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], pivots)
    return pivots


def build(vectors: DataFrame, path: str, n_pivots: int = 64, id_: str = "id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, sample: int = SAMPLE) -> PivotIndex:
    """Indexes all rows with a vector; other columns go along. What comes to the driver: the sample, BINS counts a pivot, and the blocks."""
    vectors = vectors.where(F.col(vector).isNotNull())
    some = matrix(vectors.orderBy(F.xxhash64(id_), id_).limit(sample).select(vector).toArrow()[vector].combine_chunks())
    pivots = centred(some, spread_pivots(some, n_pivots))
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    at = vectors.columns.index(vector)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = squared(matrix(batch.column(at)), sent.value)
            own = d.argmin(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(d)), own]))], names=[*batch.schema.names, "__pivot", "__far"])

    placed = vectors.mapInArrow(place, f"{schema}, __pivot int, __far double")
    ends = {r["__pivot"]: (r.lo, r.hi) for r in placed.groupBy("__pivot").agg(F.min("__far").alias("lo"), F.max("__far").alias("hi")).collect()}
    width = {p: max((hi - lo) / BINS, 1e-12) for p, (lo, hi) in ends.items()}
    edges = vectors.sparkSession.createDataFrame([(p, ends[p][0], width[p]) for p in ends], "__pivot int, __lo double, __width double").coalesce(1)
    binned = placed.join(F.broadcast(edges), "__pivot").withColumn("__bin", F.least(F.floor((F.col("__far") - F.col("__lo")) / F.col("__width")), F.lit(BINS - 1)).cast("int"))
    counts = binned.groupBy("__pivot", "__bin").agg(F.count(F.lit(1)).alias("n")).orderBy("__pivot", "__bin").collect()
    most = max(block_rows, -(-2 * sum(r.n for r in counts) // MOST_BLOCKS))
    number, held, last, dealt = -1, 0, None, []
    for r in counts:
        if r["__pivot"] != last or held + r.n > most:
            number, held, last = number + 1, 0, r["__pivot"]
        held += r.n
        dealt.append((r["__pivot"], r["__bin"], number))
    table = F.broadcast(vectors.sparkSession.createDataFrame(dealt, "__pivot int, __bin int, block int").coalesce(1))
    rows = binned.join(table, ["__pivot", "__bin"]).select(*vectors.columns, "__pivot", "__far", "block")
    # A block of one bin may be large: its rows are dealt over several files by their hash.
    parts = F.pmod(F.xxhash64(id_), F.lit(8))
    rows.repartition("block", parts).write.mode("overwrite").partitionBy("block").parquet(path)
    info = vectors.sparkSession.read.parquet(path).groupBy("block", "__pivot").agg(F.min("__far").alias("lo"), F.max("__far").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("block").collect() if dealt else []
    return PivotIndex(path, pivots, *(np.array([r[c] for r in info], t) for c, t in (("__pivot", np.int64), ("lo", float), ("hi", float), ("n", np.int64))))


def read_blocks(spark: SparkSession, index: PivotIndex, m: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int, id_: str, vector: str) -> DataFrame:
    """qid, id, score: each task's k nearest of each query among the blocks that it wants."""
    some = np.flatnonzero(wanted.any(axis=0)).tolist()
    sent = spark.sparkContext.broadcast((q, m, {b: np.flatnonzero(wanted[:, b]) for b in some}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, m, of = sent.value
        best, to = Nearest(len(q), k), Distances(m, "l2")
        step = max(1, CELLS // len(q))
        for tile in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
            ids, x, blocks = np.asarray(tile.column(0)), matrix(tile.column(1)), np.asarray(tile.column(2))
            for b in np.unique(blocks):
                own = blocks == b
                to.offer(ids[own], x[own], (best, None), of=of[int(b)])
        yield best.rows(q)

    # The list filters partitions, so that other blocks' files aren't opened.
    return spark.read.parquet(index.path).where(F.col("block").isin(some)).select(F.col(id_).cast("bigint"), vector, "block").mapInArrow(run, "qid bigint, id bigint, score double")


def search(queries: DataFrame, index: PivotIndex, k: int = 3, qid: str = "qid", id_: str = "id", vector: str = "embedding", seen: list | None = None) -> DataFrame:
    """qid, id, score, rank: as knn() on all vectors. seen takes (queries, blocks wanted by them in all, blocks) of each block of queries."""
    spark, out = queries.sparkSession, None
    for table in () if not len(index.rows) else blocks_of(queries.where(F.col(vector).isNotNull()).select(F.col(qid).cast("bigint").alias("__q"), vector), ["__q", vector]):
        q, m = table["__q"].to_numpy(), matrix(table[vector].combine_chunks())
        gap = index.gaps(m)
        # The nearest blocks that hold k rows together.
        order = np.argsort(gap, axis=1, kind="stable")
        before = np.cumsum(index.rows[order], axis=1) - index.rows[order]
        near = np.zeros(gap.shape, bool)
        np.put_along_axis(near, order, before < k, 1)
        first = ranked(read_blocks(spark, index, m, q, near, k, id_, vector), k).groupBy("qid").agg(F.max("score").alias("far"), F.count(F.lit(1)).alias("n")).toArrow()
        bound = np.full(len(q), np.inf)
        place = {x: i for i, x in enumerate(q.tolist())}
        for x, far, n in zip(*(first.column(c).to_pylist() for c in ("qid", "far", "n")), strict=True):
            bound[place[x]] = np.sqrt(far) * (1 + SLACK) + SLACK if n >= k else np.inf
        wanted = near | (gap <= bound[:, None])
        if seen is not None:
            seen.append((len(q), int(wanted.sum()), gap.shape[1]))
        part = read_blocks(spark, index, m, q, wanted, k, id_, vector)
        out = part if out is None else out.unionAll(part)
    return ranked(out if out is not None else spark.createDataFrame([], "qid bigint, id bigint, score double"), k)
