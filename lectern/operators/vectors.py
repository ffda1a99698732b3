"""V1 to V9: embedding and exact search, in Arrow batches with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

DIM, BLOCK = 64, 4096
#: Pairs of a query and a row, or numbers of vectors, that a task works on at once; texts that a model gets at once; words that the stand-in keeps.
CELLS, TEXTS, WORDS = 1 << 19, 512, 100_000
#: What a distance by a matrix product may be off by, as a part of the vectors' squared lengths.
OFF = 1e-11


class HashingEmbedder:
    """A deterministic stand-in for a model: words hashed into buckets, to unit length. Any object with the same call may replace it."""

    def __init__(self, dim: int = DIM):
        self.dim, self.seen = dim, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts = [(text or "").lower().split(" ") for text in texts]
        if len(self.seen) > WORDS:
            self.seen.clear()
        for word in set().union(*parts) - self.seen.keys():
            self.seen[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim if word else -1
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter((self.seen[w] for p in parts for w in p), np.int64, int(n.sum()))
        row = np.repeat(np.arange(len(texts)), n)
        out = np.bincount((row * self.dim + at)[at >= 0], minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(float)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most TEXTS rows."""
    return (b.slice(a, TEXTS) for b in batches for a in range(0, b.num_rows, TEXTS))


def embed(df: DataFrame, text: str, out: str = "embedding", make=HashingEmbedder) -> DataFrame:
    """V1, V2: df with an array of doubles; the model is made once a task, and gets at most TEXTS texts at once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` array<double>"
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in few(batches):
            vectors = np.ascontiguousarray(model(batch.column(at).to_pylist()), float)
            width = vectors.shape[1] if vectors.ndim == 2 else 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * width + 1, width or 1, dtype=np.int32)[: batch.num_rows + 1]), pa.array(vectors.reshape(-1))) if width else pa.array([[]] * batch.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; all must have one length."""
    flat = np.asarray(column.flatten(), float)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def blocks_of(queries: DataFrame, columns: list[str]) -> Iterator[pa.Table]:
    """The query set, collected by one job, in Arrow tables of at most BLOCK rows."""
    table = queries.select(*columns).toArrow()
    for start in range(0, table.num_rows, BLOCK):
        yield table.slice(start, BLOCK).combine_chunks()


def scan(queries: DataFrame, vectors: DataFrame, qid: str, id_: str, make, schema: str, carry: tuple[str, ...] = (), qcarry: tuple[str, ...] = (), vector: str = "embedding", text: str | None = None, model=None) -> DataFrame:
    """For each block of queries, make(query ids, query matrix, query columns) in every task of vectors: an object that takes the ids, matrix and columns of all its rows with add(), in tiles of at most CELLS pairs, and gives one batch of rows at the end with result(). So a task's memory doesn't grow with the queries, rows or batches.

    With text, the rows have no vectors yet: a model, made once a task, embeds that column's texts tile by tile, at most TEXTS at once, where they are searched.
    """
    out = []
    # A row without a vector is near to nothing: it isn't searched, nor found.
    queries, vectors = queries.where(F.col(vector).isNotNull()), vectors if text else vectors.where(F.col(vector).isNotNull())
    for table in blocks_of(queries.withColumnRenamed(qid, "__q") if qid != "__q" else queries, ["__q", vector, *qcarry]):
        sent = vectors.sparkSession.sparkContext.broadcast((table["__q"].to_numpy(), matrix(table[vector].combine_chunks()), [table[c].to_pylist() for c in qcarry]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held, embedder = None, model() if text else None
            step = min(max(1, CELLS // len(sent.value[0])), TEXTS if text else CELLS)
            for tile in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
                held = held or make(*sent.value)
                x = np.ascontiguousarray(embedder(tile.column(1).to_pylist()), float) if text else matrix(tile.column(1))
                held.add(np.asarray(tile.column(0)), x, [c.to_pylist() for c in tile.columns[2:]])
            if held:
                yield held.result()

        out.append(vectors.select(id_, text or vector, *carry).mapInArrow(run, schema))
    return reduce(DataFrame.unionAll, out) if out else vectors.sparkSession.createDataFrame([], schema)


def squared(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances, by slices that bound the temporary."""
    out = np.empty((len(m), len(x)))
    step = max(1, CELLS // max(1, x.size))
    for a in range(0, len(m), step):
        out[a : a + step] = ((m[a : a + step, None, :] - x[None]) ** 2).sum(axis=2)
    return out


def cosines(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """V7: dot products over both norms; a vector of zeros has cosine 0 with all."""
    return (m @ x.T) / np.maximum(np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(x, axis=1)), 1e-300)


class Labels:
    """Which rows have a query's label: a null is equal to nothing, nor different from anything."""

    def __init__(self, asked: list):
        self.codes = {v: i for i, v in enumerate(dict.fromkeys(v for v in asked if v is not None))}
        self.asked = self.of(asked)[:, None]

    def of(self, values: list) -> np.ndarray:
        return np.array([-1 if v is None else self.codes.get(v, -2) for v in values], np.int64)

    def __call__(self, own: list) -> tuple[np.ndarray, np.ndarray]:
        """(equal, both known) for each query and row."""
        rows = self.of(own)[None]
        known = (self.asked != -1) & (rows != -1)
        return known & (self.asked == rows), known


class Nearest:
    """The k least distances of each query over all that was added, ties by id."""

    def __init__(self, n: int, k: int):
        self.k, self.d, self.ids = k, np.full((n, k), np.inf), np.zeros((n, k), np.int64)

    def add(self, d: np.ndarray, ids: np.ndarray) -> None:
        """d: distances of all queries to the ids; infinite ones don't count."""
        at, c = np.nonzero(d <= self.d[:, -1:])
        self.put(at, d[at, c], ids[c])

    def put(self, at: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """Pairs: the query at a place, and an id at a distance from it."""
        far = self.d[at, -1]
        some = np.flatnonzero((d < far) | (d == far) & (d < np.inf) & (ids < self.ids[at, -1]))
        own, of = np.unique(at[some], return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(own)), self.k), of])
        d, ids = np.concatenate([self.d[own].ravel(), d[some]]), np.concatenate([self.ids[own].ravel(), ids[some]])
        order = np.lexsort((ids, d, of))
        keep = order[np.searchsorted(of[order], np.arange(len(own)))[:, None] + np.arange(self.k)]
        self.d[own], self.ids[own] = d[keep], ids[keep]

    def rows(self, q: np.ndarray, sign: float = 1.0) -> pa.RecordBatch:
        some = np.isfinite(self.d)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q[:, None], self.d.shape)[some]), pa.array(self.ids[some]), pa.array(sign * self.d[some])], names=["qid", "id", "score"])


class Distances:
    """Of queries to rows: squared, or cosines with their sign turned. A matrix product tells which pairs may be among the nearest; only theirs are computed exactly, and in the same way wherever a row stands, so equal vectors tie."""

    def __init__(self, m: np.ndarray, metric: str):
        self.m, self.metric, self.norm = m, metric, np.linalg.norm(m, axis=1)
        self.side = m if metric == "l2" else self.unit(m)

    def unit(self, x: np.ndarray) -> np.ndarray:
        """Vectors over their norms, NaN where those are too small to divide by."""
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n >= 1e-140, n, np.where(n == 0, 1.0, np.nan))

    def exact(self, at: np.ndarray, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.metric == "l2":
            return ((self.m[at] - x[c]) ** 2).sum(axis=1)
        return -(self.m[at] * x[c]).sum(axis=1) / np.maximum(self.norm[at] * np.linalg.norm(x, axis=1)[c], 1e-300)

    def offer(self, ids: np.ndarray, x: np.ndarray, *takers: tuple[Nearest, np.ndarray | None], of: np.ndarray | slice = slice(None)) -> None:
        """Gives the rows to each taker that keeps the nearest of all queries; its mask, if any, tells which pairs of the queries at `of` count."""
        size = lambda n: np.where(np.isfinite(n * n), n * n * (1 - OFF), np.nan)
        step, places = max(1, CELLS // max(1, x.shape[1])), np.arange(len(self.m))[of]
        with np.errstate(all="ignore"):
            close = self.side[of] @ (x if self.metric == "l2" else self.unit(x)).T
            if self.metric == "l2":
                close -= size(np.linalg.norm(x, axis=1)) / 2
        for best, some in takers:
            far = best.d[of][:, -1:]
            # Where numbers are too large or small to tell, NaN keeps the pair.
            may = ~(close < ((size(self.norm[of])[:, None] - far) / 2 if self.metric == "l2" else -far - OFF))
            r, c = np.divmod(np.flatnonzero(may if some is None else may & some), len(ids))
            for a in range(0, len(r), step):
                at, own = places[r[a : a + step]], c[a : a + step]
                best.put(at, self.exact(at, x, own), ids[own])


def knn(queries: DataFrame, vectors: DataFrame, k: int = 3, qid: str = "qid", id_: str = "id", metric: str = "l2", same: str | None = None, exclude_self: bool = False, text: str | None = None, model=HashingEmbedder) -> DataFrame:
    """V3, V5, V6, V7: qid, id, score, rank of the k nearest (least squared distance, or greatest cosine); same restricts to rows with the query's value of that column. A task sends k rows for each query, however many it read. With text, the model embeds that column of the rows where they are searched, so neither their texts nor their vectors come back."""

    class Kernel:
        def __init__(self, q, m, extra):
            self.q, self.to, self.best = q, Distances(m, metric), Nearest(len(q), k)
            self.labels = Labels(extra[0]) if same else None

        def add(self, ids, x, cols):
            some = self.labels(cols[0])[0] if same else None
            if exclude_self:
                other = self.q[:, None] != ids[None]
                some = other if some is None else some & other
            self.to.offer(ids, x, (self.best, some))

        def result(self):
            return self.best.rows(self.q, 1.0 if metric == "l2" else -1.0)

    part = scan(queries, vectors, qid, id_, Kernel, "qid bigint, id bigint, score double", (same,) if same else (), (same,) if same else (), text=text, model=model)
    return ranked(part, k, metric)


def ranked(part: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The first k of each query among the rows (qid, id, score) of all tasks, with their rank."""
    order = Window.partitionBy("qid").orderBy(F.col("score") if metric == "l2" else F.desc("score"), "id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def extremes(queries: DataFrame, vectors: DataFrame, qid: str, id_: str, label: str) -> DataFrame:
    """Per query the best cosine of another row with its label (correct) and of one with another label (incorrect), with their ids; ties to the least id. A null label is neither."""

    class Kernel:
        def __init__(self, q, m, extra):
            self.q, self.to, self.labels, self.best = q, Distances(m, "cosine"), Labels(extra[0]), [Nearest(len(q), 1) for _ in range(2)]

        def add(self, ids, x, cols):
            equal, known = self.labels(cols[0])
            other = self.q[:, None] != ids[None]
            self.to.offer(ids, x, *zip(self.best, (equal & other, known & ~equal & other), strict=True))

        def result(self):
            arrays = [pa.array(self.q)]
            for held in self.best:
                none = ~np.isfinite(held.d[:, 0])
                arrays += [pa.array(-held.d[:, 0], mask=none), pa.array(held.ids[:, 0], mask=none)]
            return pa.RecordBatch.from_arrays(arrays, names=["qid", "correct", "correct_id", "incorrect", "incorrect_id"])

    part = scan(queries, vectors, qid, id_, Kernel, "qid bigint, correct double, correct_id bigint, incorrect double, incorrect_id bigint", (label,), (label,))
    best = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c), (-F.col(f"{c}_id")).alias("i"))))
    return part.groupBy("qid").agg(best("correct").alias("g"), best("incorrect").alias("b")).select("qid", F.col("g.correct").alias("correct"), (-F.col("g.i")).alias("correct_id"), F.col("b.incorrect").alias("incorrect"), (-F.col("b.i")).alias("incorrect_id"))


def count_above(queries: DataFrame, vectors: DataFrame, qid: str, id_: str, threshold: str) -> DataFrame:
    """Per query how many other rows have a cosine above its threshold; none where it is null."""

    class Kernel:
        def __init__(self, q, m, extra):
            self.q, self.m, self.n = q, m, np.zeros(len(q), np.int64)
            self.least = np.array([np.inf if v is None else v for v in extra[0]])[:, None]

        def add(self, ids, x, cols):
            self.n += ((cosines(self.m, x) > self.least + 1e-12) & (self.q[:, None] != ids[None])).sum(axis=1)

        def result(self):
            return pa.RecordBatch.from_arrays([pa.array(self.q), pa.array(self.n)], names=["qid", "n"])

    return scan(queries, vectors, qid, id_, Kernel, "qid bigint, n bigint", (), (threshold,)).groupBy("qid").agg(F.sum("n").alias("n_above"))


def per_sample(questions: DataFrame, chunks: DataFrame, sample: str, k: int = 3, least: int = 1, embedder=None) -> DataFrame:
    """V6: each question's k nearest chunks within its own sample: qid, id, rank. A sample whose text is shorter than `least` code points finds nothing, so its answer is empty."""
    embedder = embedder or embed
    long = chunks.groupBy(sample).agg(F.sum(F.length("chunk")).alias("__n")).where(F.col("__n") >= least).select(sample)
    index = embedder(chunks.join(long, sample, "left_semi").select("id", sample, "chunk"), "chunk")
    return knn(embedder(questions.select("qid", sample, "question"), "question"), index, k, "qid", "id", same=sample)


def norm(v: Column) -> Column:
    """V8."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
