"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH_BYTES = 8 << 20
SPACE = "[\\x20\\x09-\\x0D]+"
_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see; one of our own only where it is unset and all run in one process on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/lectern/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and a lost executor costs no more than a read."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def remove_table(df: DataFrame) -> None:
    """Removes a table of materialize() that no later step reads."""
    remove(df.sparkSession, df._lectern_path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone
            return


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of at most so many rows and BATCH_BYTES, so that a run of very long texts stays within a Python worker's memory.

    Plans read the session's settings when they run, so these stay set; smaller ones are kept.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        held = int(spark._jsparkSession.sessionState().conf().getConfString(f"spark.sql.execution.arrow.{key}", str(2**31 - 1)))
        if not 0 < held <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which waits for further tasks, gives the memory it no longer uses back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def body(name: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8."""
    return column.cast(pa.large_binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA5CB9243F1D2E9B7)
    return x ^ (x >> np.uint64(32))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def ranges(df: DataFrame, keys: list[str], weight, most: int, nulls_first: bool = False, out: str = "range", bins: int = 4096, most_ranges: int = 65_536) -> tuple[DataFrame, int]:
    """df with out, numbers of ranges of the integer keys in their order, and how many there are; the same for the same rows, however they are dealt.

    Cells of equal width are counted; a cell that weighs over `most` is cut again between its own least and greatest
    key, then by the next key, until it is light or its rows have equal keys. So outliers and frequent values of the
    first key cost a pass, not balance. Nulls of the first key are a cell of their own, which later keys cut. Neighbours are joined up to `most`, which grows where there would be over
    most_ranges ranges; the cells that come to the driver are then bounded, too.
    """
    spark = df.sparkSession
    slim = df.select(*keys, weight.cast("double").alias("__weight"))
    null = F.col(keys[0]).isNull()
    spans = [x for k in keys for x in (F.min(k).alias(f"__lo_{k}"), F.max(k).alias(f"__hi_{k}"))]

    def counted(rows: DataFrame) -> list:
        return rows.groupBy("__cell").agg(F.sum("__weight").alias("__n"), *spans).collect()

    def cell_expr(plan: DataFrame | None):
        """(rows with __cell) from the table of cuts; a row of it for each cell that is cut."""

        def place(rows: DataFrame) -> DataFrame:
            if plan is None:
                return rows.withColumn("__cell", F.when(null, F.lit(0 if nulls_first else 1)).otherwise(F.lit(1 if nulls_first else 0)).cast("bigint"))
            met = rows.join(F.broadcast(plan), "__cell", "left")
            value = F.coalesce(*(F.when(F.col("__by") == k, F.col(name)) for k, name in enumerate(keys)))
            # Decimals, as the span of two 64-bit keys may be wider than 64 bits.
            step = F.expr("(cast(__value as decimal(20,0)) - cast(__from as decimal(20,0))) div cast(__width as decimal(20,0))").cast("bigint")
            return met.withColumn("__value", value).withColumn("__cell", F.when(F.col("__by").isNull(), F.col("__cell")).otherwise(F.col("__base") + step)).drop("__value", "__by", "__from", "__width", "__base")

        return place

    places = [cell_expr(None)]
    slim = places[0](slim)
    stats = {r["__cell"]: r for r in counted(slim)}
    order, fresh, final = sorted(stats), 2, set()
    limit = max(float(most), 2.0 * sum(r["__n"] or 0.0 for r in stats.values()) / most_ranges)
    while True:
        cuts = []
        for c in order:
            r = stats[c]
            by = next((k for k, name in enumerate(keys) if r[f"__lo_{name}"] is not None and r[f"__hi_{name}"] > r[f"__lo_{name}"]), None)
            if c in final or (r["__n"] or 0.0) <= limit or by is None:
                final.add(c)
                continue
            lo, hi = r[f"__lo_{keys[by]}"], r[f"__hi_{keys[by]}"]
            cuts.append((c, by, lo, -(-(hi - lo + 1) // bins), fresh))
            fresh += bins
        if not cuts:
            break
        plan = spark.createDataFrame([(c, by, str(lo), str(width), base) for c, by, lo, width, base in cuts], "__cell bigint, __by int, __from string, __width string, __base bigint").coalesce(1)
        places.append(cell_expr(plan))
        slim = places[-1](slim)
        cut = {c: base for c, _, _, _, base in cuts}
        new = {r["__cell"]: r for r in counted(slim.where(F.col("__cell") >= min(cut.values())))}
        stats |= new
        children = sorted(new)
        order = [x for c in order for x in ([n for n in children if cut[c] <= n < cut[c] + bins] if c in cut else [c])]
    numbers, held, n = [], 0.0, 0
    for c in order:
        own = stats[c]["__n"] or 0.0
        if held and held + own > limit:
            held, n = 0.0, n + 1
        held += own
        numbers.append((c, n))
    table = F.broadcast(spark.createDataFrame(numbers, "__cell bigint, __range bigint").coalesce(1))
    for place in places:
        df = place(df)
    return df.join(table, "__cell").drop("__cell").withColumnRenamed("__range", out), n + 1 if order else 0
