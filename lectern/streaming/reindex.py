"""§2.13, X1, X2: an index that follows its files: changed ones are indexed anew, deleted ones leave it.

A change is a page of a file's new state, or a mark that the file is gone, with a number that grows with each state of
the file. Of a file's states in one batch only the last counts, and its chunks take the place of all that the index had of it. A
batch is published as one version of the store, once, even if it is run again after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.chunking import preprocess
from lectern.operators.vectors import HashingEmbedder, embed
from lectern.sources import loaders
from lectern.sources.ledger import Ledger, Version

CHANGE = "source_file string, state bigint, page bigint, text string, deleted boolean"
INDEX = "source_file string, state bigint, page bigint, chunk_no int, chunk string, n_tokens int, embedding array<double>"
FILES_MOST = 10_000
FILES = "path string, source_file string, modified timestamp, length bigint, error string"


def index_of(spark: SparkSession, path: str) -> Ledger:
    """The store of an index's chunks, by file."""
    return Ledger(spark, path, INDEX, "source_file")


def last_states(changes: DataFrame) -> DataFrame:
    """Rows of each file's last state; the same page given twice in it counts once."""
    last = changes.groupBy(F.col("source_file").alias("__file")).agg(F.max("state").alias("__last"))
    rows = changes.join(last, F.col("source_file").eqNullSafe(F.col("__file")) & (F.col("state") == F.col("__last")), "left_semi")
    return rows.dropDuplicates(["source_file", "page", "text", "deleted"])


def chunked(pages: DataFrame, make: Callable = HashingEmbedder, strip_page1: bool = True) -> DataFrame:
    """Chunks with vectors of pages (source_file, state, page, text)."""
    states = pages.groupBy(F.col("source_file").alias("__file")).agg(F.max("state").alias("state"))
    rows = embed(preprocess(pages.select("source_file", "page", "text"), strip_page1=strip_page1), "chunk", make=make)
    return rows.join(states, F.col("source_file").eqNullSafe(F.col("__file"))).drop("__file")


def apply_changes(index: Ledger, changes: DataFrame, batch: tuple[str, int] | None = None, make: Callable = HashingEmbedder, strip_page1: bool = True) -> Version:
    """One version with the changes' files as they are now. A state older than the index's own is left out."""
    known = index.read().groupBy(F.col("source_file").alias("__known")).agg(F.max("state").alias("__state"))
    rows = last_states(changes).join(known, F.col("source_file").eqNullSafe(F.col("__known")), "left").where("__state is null or state >= __state").drop("__known", "__state")
    return index.commit(chunked(rows.where("not deleted"), make, strip_page1), rows.select("source_file"), batch)


def follow(changes: DataFrame, index: Ledger, checkpoint: str, name: str = "changes", make: Callable = HashingEmbedder) -> StreamingQuery:
    """A stream of changes into the index; all that is there now, from where the checkpoint is."""

    def one(rows: DataFrame, number: int) -> None:
        apply_changes(index, rows, (name, number), make)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync(spark: SparkSession, folder: str, files: Ledger, index: Ledger, parsers: dict[str, Callable], make: Callable = HashingEmbedder) -> dict[str, int]:
    """Brings an index up to a folder by its listing: only files whose time or length changed are read, those that are gone leave, those that fail are noted and leave.

    files: a Ledger of FILES by path, what was indexed. Both stores are published apart, files last, so that a run that was cut short is done again.
    Files are read in rounds of FILES_MOST, whose paths the driver holds.
    """
    out = {"changed": 0, "gone": 0, "failed": 0}
    while True:
        listed = loaders.list_files(spark, folder).select("path", F.col("name").alias("source_file"), "modified", "length")
        both = listed.alias("n").join(files.read().alias("o"), F.col("n.path") == F.col("o.path"), "full")
        same = F.col("n.modified").eqNullSafe(F.col("o.modified")) & F.col("n.length").eqNullSafe(F.col("o.length"))
        new = both.where(F.col("n.path").isNotNull() & (F.col("o.path").isNull() | ~same)).select("n.*").orderBy("path").limit(FILES_MOST).collect()
        gone = both.where(F.col("n.path").isNull()).select("o.path", "o.source_file")
        n_gone = gone.count()
        if not new and not n_gone:
            return out
        entries = spark.createDataFrame(new, "path string, source_file string, modified timestamp, length bigint")
        state, chunks, bad = index.latest().number + 1, None, spark.createDataFrame([], "__name string, error string")
        if new:
            pages = loaders.load_folder(spark, [r.path for r in new], parsers)
            chunks = chunked(pages.where("error is null").select("source_file", F.lit(state).cast("bigint").alias("state"), F.col("page").cast("bigint").alias("page"), "text"), make)
            bad = pages.where("error is not null").groupBy(F.col("source_file").alias("__name")).agg(F.min("error").alias("error"))
        done = entries.join(bad, F.col("source_file") == F.col("__name"), "left").select("path", "source_file", "modified", "length", "error")
        index.commit(chunks, entries.select("source_file").union(gone.select("source_file")))
        version = files.commit(done, entries.select("path").union(gone.select("path")))
        out = {"changed": out["changed"] + len(new), "gone": out["gone"] + n_gone, "failed": files.read(version.number).where("error is not null").count()}
        if len(new) < FILES_MOST:
            return out
