"""A project's index, questions to it, and its chat."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.functions.text import fix_number_spacing, safe_name, source_label
from lectern.operators.chunking import preprocess
from lectern.operators.generation import answered, budget_context, generate
from lectern.operators.vectors import HashingEmbedder, embed, knn
from lectern.sources import store
from lectern.sources.ledger import Ledger


def build(pages: DataFrame, path: str, make=HashingEmbedder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored index, per-file counts, and failures (name, error). Files that failed don't end the rest."""
    failures = pages.where("error is not null").select(F.col("source_file").alias("name"), "error")
    chunks = preprocess(pages.where("error is null").select("source_file", F.col("page").cast("bigint").alias("page"), "text"))
    # A number of its own for each row, written with it: a page that is given twice has two.
    store.save(embed(chunks.select(F.monotonically_increasing_id().alias("chunk_id"), "*"), "chunk", make=make), path)
    index = store.load(pages.sparkSession, path)
    return index, store.stats(index), failures


def create(spark: SparkSession, root: str, name: str) -> str:
    """The folder of a project, made if it isn't there; names are those of N13."""
    safe = spark.range(1).select(safe_name(F.lit(name)).alias("x")).first().x
    if safe is None:
        raise ValueError("the project's name has no character that a folder's name may have")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{safe}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return f"{root}/{safe}"


class IndexCache:
    """At most `most` built indexes, one for each project, by the signature of its files; the one unused longest goes first. What there is stands in a Ledger, so other sessions find it, and writers at once lose nothing."""

    def __init__(self, spark: SparkSession, root: str, most: int = 8):
        self.spark, self.root, self.most = spark, root, most
        self.held = Ledger(spark, f"{root}/catalog", "project string, signature string, folder string, used bigint", "project")

    def get(self, project: str, signature: str, make: Callable[[str], object]) -> str:
        """The folder of the project's index; make(folder) builds it if none has this signature."""
        rows = {r.project: r for r in self.held.read().orderBy("used").collect()}  # `most` rows, and those of writers at once
        own, clock = rows.get(project), self.held.latest().number + 1
        if own is None or own.signature != signature:
            folder = f"{self.root}/indexes/{uuid.uuid4().hex}"
            make(folder)
        else:
            folder = own.folder
        others = [r for p, r in rows.items() if p != project]
        out = others[: max(0, len(others) + 1 - self.most)]
        entry = self.spark.createDataFrame([(project, signature, folder, clock)], self.held.schema)
        self.held.upsert(entry, self.spark.createDataFrame([(r.project,) for r in out], "project string"))
        for r in [*out, *([own] if own is not None and own.folder != folder else [])]:
            self._drop(r.folder)
        return folder

    def _drop(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ask(questions: DataFrame, index: DataFrame, k: int = 3, make=HashingEmbedder, model=None) -> DataFrame:
    """Qid, question, answer and sources of (qid, question) rows."""
    q = embed(questions, "question", make=make)
    top = knn(q, index, k, "qid", "chunk_id").join(index.select(F.col("chunk_id").alias("id"), "source_file", "page", "chunk"), "id")
    told = top.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk", source_label(F.col("source_file"), F.col("page")).alias("label")))).alias("x"))
    rows = questions.join(told, "qid", "left").withColumn("chunks", F.coalesce(F.col("x.chunk"), F.array().cast("array<string>"))).withColumn("sources", F.array_distinct(F.coalesce(F.col("x.label"), F.array().cast("array<string>"))))
    rows = budget_context(rows.select("qid", "question", "chunks", "sources"), "question", "chunks").drop("chunks")
    out = generate(rows, **({"make": model} if model else {}))
    return out.withColumn("answer", answered(fix_number_spacing(F.col("answer")))).drop("context")


def append_turn(spark: SparkSession, path: str, project: str, turn: int, role: str, content: str, sources: list[tuple[str, str]] = ()) -> None:
    """X4."""
    spark.createDataFrame([(project, turn, role, content, list(sources))], "project string, turn long, role string, content string, sources array<struct<label:string,text:string>>").write.mode("append").parquet(path)


def replay(spark: SparkSession, path: str, project: str) -> DataFrame:
    """A project's turns in order; of a turn that was sent again, the first row in the order of its content."""
    rows = spark.read.parquet(path).where(F.col("project") == project)
    return rows.groupBy("project", "turn").agg(F.min(F.struct("role", "content", "sources")).alias("x")).select("project", "turn", "x.*").orderBy("turn")


@contextlib.contextmanager
def timed(steps: dict[str, float], name: str):
    """X6."""
    began = time.perf_counter()
    try:
        yield
    finally:
        steps[name] = steps.get(name, 0.0) + time.perf_counter() - began
