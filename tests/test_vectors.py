"""The pivot index against the flat search, and the flat search's labels, norms and rows per task."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lectern import queries
from lectern.operators import generation, groundtruth, pivots, vectors


def table(spark, rows, extra="label int"):
    return spark.createDataFrame(rows, f"id bigint, embedding array<double>, {extra}")


def clustered(n=1500, dim=8, clusters=12, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim)) * 8
    own = np.where(r.random(n) < 0.34, 0, r.integers(0, clusters, n))  # one cluster holds over a third
    return [(i, (centres[own[i]] + r.normal(size=dim)).tolist(), int(own[i])) for i in range(n)]


def plain(df):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 3, 40])
def test_pivot_search_is_the_flat_search(spark, tmp_path, k):
    rows = clustered()
    rows += [(10_000 + i, rows[5][1], 0) for i in range(30)] + [(20_000, None, 1)]  # ties, and a row without a vector
    v = table(spark, rows).repartition(5)
    q = v.where("id % 37 = 0 or id = 5").withColumn("qid", F.col("id"))
    index = pivots.build(v, str(tmp_path / "index"), 24, block_rows=64, sample=400)
    seen = []
    got = plain(pivots.search(q, index, k, seen=seen))
    assert got == plain(vectors.knn(q, v, k))
    assert int(index.rows.sum()) == 1530
    wanted, blocks = sum(s[1] for s in seen), sum(s[0] * s[2] for s in seen)
    assert wanted < 0.5 * blocks, (wanted, blocks)


def test_pivot_search_of_few_rows(spark, tmp_path):
    v = table(spark, [(1, [0.0, 0.0], 1), (2, [3.0, 4.0], 1), (3, [0.0, 0.0], 1)])
    q = v.withColumn("qid", F.col("id"))
    index = pivots.build(v, str(tmp_path / "a"), 8)
    assert plain(pivots.search(q, index, 10)) == plain(vectors.knn(q, v, 10))
    empty = v.limit(0)
    assert pivots.search(q, pivots.build(empty, str(tmp_path / "b"), 8), 3).count() == 0
    assert pivots.search(q.limit(0), index, 3).count() == 0


def test_other_blocks_are_not_opened(spark, tmp_path):
    v = table(spark, clustered())
    index = pivots.build(v, str(tmp_path / "index"), 24, block_rows=64)
    plan = pivots.read_blocks(spark, index, np.zeros((1, 8)), np.array([1]), np.eye(1, len(index.rows), dtype=bool), 3, "id", "embedding")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "block" in plan.split("PartitionFilters")[1][:80]


def test_pivots_keep_other_columns(spark, tmp_path):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    index = pivots.build(v, str(tmp_path / "index"), 16, block_rows=32)
    back = spark.read.parquet(index.path).select("id", "embedding", "label")
    assert sorted(map(tuple, back.select("id", "label").collect())) == sorted(map(tuple, v.select("id", "label").collect()))


def test_null_labels_are_no_labels(spark):
    v = table(spark, [(1, [1.0, 0.0], None), (2, [0.9, 0.1], None), (3, [0.5, 0.5], 7), (4, [0.0, 1.0], 7), (5, [0.1, 0.9], 8)])
    out = {r.qid: tuple(r)[1:] for r in vectors.extremes(v.withColumn("qid", F.col("id")), v, "qid", "id", "label").collect()}
    assert out[1] == (None, None, None, None) and out[2] == (None, None, None, None)
    assert out[3][1] == 4 and out[3][3] == 5 and out[5][0] is None and out[5][3] == 4
    assert {r.qid for r in vectors.knn(v.withColumn("qid", F.col("id")), v, 3, same="label").collect()} == {3, 4, 5}


def test_cosines_over_norms(spark):
    v = table(spark, [(1, [10.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [100.0, 100.0], 1), (4, [0.0, 0.0], 2)])
    q = v.where("id = 1").withColumn("qid", F.col("id"))
    r = vectors.extremes(q, v, "qid", "id", "label").first()
    assert (r.correct, r.correct_id, r.incorrect) == (1.0, 2, 0.0)
    assert vectors.count_above(q.withColumn("least", F.lit(0.5)), v, "qid", "id", "least").first().n_above == 2


def test_a_task_sends_k_rows_for_a_query(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        v = table(spark, clustered(400)).repartition(2).cache()
        q = v.where("id % 50 = 0").withColumn("qid", F.col("id"))


        class Kernel:
            def __init__(self, q, m, extra):
                self.q, self.m, self.best = q, m, vectors.Nearest(len(q), 3)

            def add(self, ids, x, cols):
                self.best.add(vectors.squared(self.m, x), ids)

            def result(self):
                return self.best.rows(self.q)

        rows = vectors.scan(q, v, "qid", "id", Kernel, "qid bigint, id bigint, score double").count()
        assert rows == 2 * 3 * q.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_task_works_in_tiles(spark):
    """A kernel gets at most CELLS pairs at once, whatever the batches (it got whole ones: 4,096 queries by 10,000 rows)."""
    v = table(spark, [(i, [float(i % 7), float(i % 11)], i % 3) for i in range(3000)]).coalesce(1)
    q = v.withColumn("qid", F.col("id"))

    class Kernel:
        def __init__(self, q, m, extra):
            self.n, self.most = len(q), 0

        def add(self, ids, x, cols):
            self.most = max(self.most, self.n * len(ids))

        def result(self):
            return pa.RecordBatch.from_arrays([pa.array([self.most])], names=["most"])

    most = [r.most for r in vectors.scan(q, v, "qid", "id", Kernel, "most bigint").collect()]
    assert most and max(most) <= vectors.CELLS


def test_a_model_gets_few_texts(spark):
    class Counting(vectors.HashingEmbedder):
        def __call__(self, texts):
            assert len(texts) <= vectors.TEXTS
            return super().__call__(texts)

    rows = vectors.embed(spark.range(3000).coalesce(1).selectExpr("id", "concat('w', id) as t"), "t", make=Counting)
    model = vectors.HashingEmbedder()
    assert all(np.array_equal(r.embedding, model([r.t])[0]) for r in rows.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_search_is_brute_force_with_ties(spark, metric):
    """Copies of a vector tie wherever they stand; also of vectors too large or too small to square."""
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 13)) * 10.0 ** r.choice([-170, -3, 0, 0, 0, 3], size=(40, 1))
    if metric == "l2":
        base[3] = base[4] = 1e160
    base[0] = 0
    rows = [(int(i), base[j].tolist(), int(j % 4)) for i, j in enumerate(r.permutation(np.repeat(np.arange(40), 31)))]
    v = table(spark, rows).repartition(3)
    q = v.where("id % 9 = 0").withColumn("qid", F.col("id"))
    x = np.array([row[1] for row in rows])
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(x, axis=1)
        far = lambda i: ((x[i] - x) ** 2).sum(axis=1) if metric == "l2" else -(x[i] * x).sum(axis=1) / np.maximum(norm[i] * norm, 1e-300)
        want = {i: [int(j) for j in np.lexsort((np.arange(len(x)), far(i))) if np.isfinite(far(i)[j])][:7] for i in range(0, len(x), 9)}
    got = {}
    for row in vectors.knn(q, v, 7, metric=metric).orderBy("qid", "rank").collect():
        got.setdefault(row.qid, []).append(row.id)
    assert got == {i: w for i, w in want.items() if w}


def batches_of(step, n, **columns):
    """Rows of each batch that a step gives for one batch of n rows, called as a task calls it."""

    class Rows:
        schema, columns = (), ()

        def mapInArrow(self, run, schema):
            return [b.num_rows for b in run(iter([self.batch]))]

    rows = Rows()
    rows.batch, rows.columns = pa.RecordBatch.from_pydict({c: [v] * n for c, v in columns.items()}), list(columns)
    return step(rows)


def test_a_generator_holds_few_rows():
    """Contexts and answers of at most TEXTS rows at once (a whole batch's were held)."""
    n = 3 * vectors.TEXTS + 1
    for step in (generation.generate, lambda df: generation.token_context(df, "question", "context", lambda: Chars())):
        sizes = batches_of(step, n, question="a b", context=["a b. c d."] if step is not generation.generate else "a b. c d.")
        assert sum(sizes) == n and max(sizes) <= vectors.TEXTS, sizes


def test_texts_are_embedded_where_they_are_searched(spark):
    """Texts and vectors came back from one worker a task and went to a second."""

    class Counting(vectors.HashingEmbedder):
        def __call__(self, texts):
            assert len(texts) <= vectors.TEXTS
            return super().__call__(texts)

    texts = [None if i % 50 == 0 else " ".join(f"w{(i * 7 + k * k) % 31}" for k in range(i % 9)) for i in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, t string").coalesce(1)
    q = vectors.embed(df.where("id % 97 = 0").withColumnRenamed("id", "qid"), "t")
    for metric in ("l2", "cosine"):
        want = sorted(vectors.knn(q, vectors.embed(df, "t"), 4, metric=metric).collect())
        assert sorted(vectors.knn(q, df, 4, metric=metric, text="t", model=Counting).collect()) == want and len(want) == 4 * q.count()
    assert queries.top_chunks(spark, DATA)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_chunks_of_hits_are_those_of_all(spark):
    """Only the documents that were hit are cleaned; ids without a chunk find nothing, as in a join with all chunks."""
    every = queries.chunks(spark, DATA)
    ids = [r.position for r in every.select("position").collect()]
    some = [*ids[::17], ids[0], ids[-1] + 1, (max(ids) // queries.PLACES + 1) * queries.PLACES, -queries.PLACES, None]
    top = spark.createDataFrame([(n, i, n % 5) for n, i in enumerate(some)], "qid bigint, id bigint, rank int")
    want = top.join(every.select(F.col("position").alias("id"), "source_file", "page", "chunk_no", "chunk"), "id").select("qid", "id", "rank", "source_file", "page", "chunk_no", "chunk")
    got = queries.with_chunks(spark, DATA, top)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == len(ids[::17]) + 1


def test_occurrences_hold_few_texts(spark):
    """Texts of at most TEXTS rows at once (a whole batch's, up to 10,000 documents, were held)."""
    n = 3 * vectors.TEXTS + 1

    class Rows:
        sparkSession = spark  # noqa: N815

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return [b.num_rows for b in run(iter([pa.RecordBatch.from_pydict({"id": list(range(n)), "t": ["a needle here"] * n})]))]

    sizes = groundtruth.occurrences(Rows(), spark.createDataFrame([(1, "needle")], "anchor_id bigint, anchor string"), "id", "t", "anchor_id", "anchor")
    assert sum(sizes) == n and max(sizes) <= vectors.TEXTS, sizes


class Chars:
    """A tokenizer of characters."""

    encode, decode = staticmethod(list), staticmethod("".join)


def test_nulls_reach_a_model_as_empty_texts(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "q", None), (3, "q", "x")], "qid int, question string, context string")
    out = generation.generate(rows, make=lambda: lambda q, c: f"<{q}|{c}>")
    assert {r.qid: r.answer for r in out.collect()} == {1: "<|x>", 2: "<q|>", 3: "<q|x>"}
    assert out.columns == ["qid", "question", "context", "answer"]


def test_searches_by_label_work_in_tiles(spark, monkeypatch):
    """The kernels of extremes and of knn within a label get at most 2^19 pairs at once."""
    scan = vectors.scan

    def checked(queries, rows, qid, id_, make, *rest, **named):
        class Checked:
            def __init__(self, q, *more):
                self.n, self.of = len(q), make(q, *more)

            def add(self, ids, *more):
                assert self.n * len(ids) <= 1 << 19
                self.of.add(ids, *more)

            def result(self):
                return self.of.result()

        return scan(queries, rows, qid, id_, Checked, *rest, **named)

    monkeypatch.setattr(vectors, "scan", checked)
    v = table(spark, [(i, [float(i % 7 + 1), float(i % 11)], i % 3) for i in range(3000)]).coalesce(1)
    q = v.withColumn("qid", F.col("id"))
    assert vectors.extremes(q, v, "qid", "id", "label").count() == 3000
    assert vectors.knn(q, v, 2, same="label", exclude_self=True).count() == 6000


@pytest.mark.parametrize("search", ["extremes", "knn_l2", "knn_cosine", "knn_same"])
def test_a_search_holds_few_mb(spark, search):
    """What a task of a search allocates, for 2,000 queries and one batch, called as a task calls it; before tiles it was 82 to 162 MB for 3,000 rows and 177 to 486 for 9,000."""
    import tracemalloc

    r = np.random.default_rng(1)
    queries_, peaks = table(spark, [(i, r.normal(size=16).tolist(), i % 3) for i in range(2000)]).withColumn("qid", F.col("id")).cache(), []

    def run_of(n):
        class Rows:
            sparkSession, columns = spark, ("id", "embedding", "label")  # noqa: N815

            def where(self, condition):
                return self

            def select(self, *columns):
                self.batch = pa.RecordBatch.from_pydict({c: self.all[c] for c in columns})
                return self

            def mapInArrow(self, run, schema):
                tracemalloc.start()
                sizes = [b.num_rows for b in run(iter([self.batch]))]
                peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
                tracemalloc.stop()
                return spark.createDataFrame([], schema) if sizes else None

        rows = Rows()
        rows.all = {"id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(r.normal(size=n * 16)), 16), "label": np.arange(n) % 3}
        return rows

    for n in (3000, 9000):
        if search == "extremes":
            vectors.extremes(queries_, run_of(n), "qid", "id", "label")
        else:
            vectors.knn(queries_, run_of(n), 5, metric="cosine" if search == "knn_cosine" else "l2", same="label" if search == "knn_same" else None, exclude_self=search == "knn_same")
    assert len(peaks) == 2 and peaks[1] < 60 and peaks[1] < 1.3 * peaks[0], peaks
