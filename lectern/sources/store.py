"""The store of chunks and vectors, and reports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which the driver and all executors see; on this machine alone, in a temporary folder where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
    return f"{root}/lectern-store/{tag}-{uuid.uuid4().hex}"


def save(chunks: DataFrame, path: str, by: str | None = None) -> None:
    """K1, K6: one Parquet table, in place of what was there."""
    w = chunks.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """S10."""
    return spark.read.parquet(path)


def load_legacy(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records or of bare strings, which have no provenance."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "x"))
    r = F.from_json("x", "text string, source_file string, page int")
    record = F.col("x").startswith("{") & r["text"].isNotNull()
    return rows.select("position", F.when(record, r["text"]).otherwise(F.col("x")).alias("text"), F.when(record, r["source_file"]).alias("source_file"), F.when(record, r["page"]).alias("page"))


def write_report(df: DataFrame, path: str) -> None:
    """K2, K4: JSON lines of a small result, in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K3, A13."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def append_absent(new: DataFrame, path: str, key: str) -> None:
    """K7: rows whose key the table hasn't yet; nothing is replaced. For one writer at a time: two may both find a key absent."""
    try:
        new = new.join(new.sparkSession.read.parquet(path).select(key), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new.write.mode("append").parquet(path)


def signature(files: DataFrame) -> DataFrame:
    """Per project a hash of its files' names, times and sizes as a multiset, whatever their order; it changes when any of them does. Files are summed, so no row holds a project's files."""
    h = F.sha2(F.concat_ws("|", "name", F.col("modified").cast("string"), F.col("length").cast("string")), 256)
    lane = lambda k: F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")
    sums = files.withColumn("h", h).groupBy("project").agg(F.count(F.lit(1)).alias("n"), *(F.sum(lane(k)).alias(f"s{k}") for k in range(4)))
    return sums.select("project", F.sha2(F.concat_ws("-", F.col("n").cast("string"), *(F.col(f"s{k}").cast("string") for k in range(4))), 256).alias("signature"))


def stats(chunks: DataFrame) -> DataFrame:
    """Per file its chunks, and its pages if it has any."""
    return chunks.groupBy("source_file").agg(F.count(F.lit(1)).alias("chunks"), F.max("page").alias("pages"))
