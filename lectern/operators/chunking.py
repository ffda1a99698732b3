"""Pages to overlapping token windows with their provenance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.text import WHITE, collapse
from lectern.operators.boilerplate import strip_pages

SIZE, OVERLAP, LEAST_CHARS, NO_FILE = 220, 40, 20, "\x00"


def as_pages(rows: DataFrame, default_source: str | None = None) -> DataFrame:
    """source_file, page, text; source_file falls back to the default, page to null."""
    have = rows.columns
    source = F.col("source_file") if "source_file" in have else F.lit(None)
    page = F.col("page") if "page" in have else F.lit(None)
    return rows.select(F.coalesce(source.cast("string"), F.lit(default_source).cast("string")).alias("source_file"), page.cast("bigint").alias("page"), "text")


def document_lengths(pages: DataFrame) -> DataFrame:
    """The length of a document's joined pages without white space at its ends, from sums: no page's text travels.

    Blank pages at either end vanish; a page's own white space counts unless it is at the joined text's end.
    """
    t = F.coalesce("text", F.lit(""))
    n = F.length(t)
    ws = F.lit(WHITE)
    left, right = n - F.length(F.ltrim(t, ws)), n - F.length(F.rtrim(t, ws))
    filled = left < n
    first, last = F.min(F.when(filled, F.col("page"))), F.max(F.when(filled, F.col("page")))
    own = {"source_file": F.coalesce("source_file", F.lit(NO_FILE)), "page": F.coalesce("page", F.lit(0))}  # unpaged text is one page; rows without a file are one document
    pages = pages.withColumns(own)
    ends = pages.withColumns({"n": n, "left": left, "right": right, "filled": filled}).groupBy("source_file").agg(
        first.alias("first"), last.alias("last"),
        F.min(F.when(F.col("filled"), F.struct("page", "left"))).alias("head"),
        F.max(F.when(F.col("filled"), F.struct("page", "right"))).alias("tail"),
    )
    inside = pages.withColumn("n", n).join(ends, "source_file").where(F.col("page").between(F.col("first"), F.col("last")))
    sums = inside.groupBy("source_file").agg((F.sum("n") + F.count(F.lit(1)) - 1 - F.first("head.left") - F.first("tail.right")).alias("n_chars"))
    return ends.select("source_file").join(sums, "source_file", "left").select(F.nullif("source_file", F.lit(NO_FILE)).alias("source_file"), F.coalesce("n_chars", F.lit(0)).cast("bigint").alias("n_chars"))


def guard(pages: DataFrame, least: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """Pages of documents that are long enough, and the rejected documents."""
    short = document_lengths(pages).where(F.col("n_chars") < least)
    return pages.join(short.withColumnRenamed("source_file", "__short"), F.col("source_file").eqNullSafe(F.col("__short")), "left_anti"), short


def window_count(n: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """C4: how many windows n tokens have."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the window's size")  # C7
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - overlap) / (size - overlap)).cast("int")))


def windows(df: DataFrame, clean: str = "clean", size: int = SIZE, overlap: int = OVERLAP, only: str | None = None) -> DataFrame:
    """C4: df without `clean` and with chunk_no, chunk, n_tokens: a row for each window of the clean text's tokens.

    only: a column of numbers, which goes; then a row for that window alone, if the text has it.
    Empty and null texts give null for their numbers, which explode drops: a filter would be pushed down and clean each text twice.
    """
    keep = [c for c in df.columns if c not in (clean, only)]
    df = df.withColumn("__t", F.split(F.nullif(clean, F.lit("")), " "))
    n = window_count(F.size("__t"), size, overlap)
    numbers = F.sequence(F.lit(0), n - 1) if only is None else F.when(F.col(only).between(0, n - 1), F.array(F.col(only)))
    df = df.select(*keep, "__t", F.explode(F.when(F.col("__t").isNotNull(), numbers)).alias("chunk_no"))
    piece = F.slice("__t", F.col("chunk_no") * (size - overlap) + 1, size)
    return df.withColumn("__p", piece).select(*keep, "chunk_no", F.array_join("__p", " ").alias("chunk"), F.size("__p").alias("n_tokens"))


class Whitespace:
    """C4's tokenizer interface: encode gives a text's tokens, decode a text; this stand-in's tokens are words parted by white space."""

    def encode(self, text: str) -> list:
        return text.split()

    def decode(self, tokens: list) -> str:
        return " ".join(tokens)


class LibraryTokenizer:
    """A tokenizer file of the tokenizers library (wordpiece, byte pairs), without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def encode(self, text: str) -> list:
        return self.model.encode(text, add_special_tokens=False).ids

    def decode(self, tokens: list) -> str:
        return self.model.decode(tokens, skip_special_tokens=True)


def token_windows(df: DataFrame, make=Whitespace, clean: str = "clean", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """C4 by a tokenizer, made once a task: df without `clean` and with chunk_no, chunk (decoded) and n_tokens, by the rule of windows()."""
    window_count(F.lit(0), size, overlap)  # checks the sizes
    keep = [c for c in df.columns if c != clean]
    rows = df.select(*keep, clean)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", chunk_no int, chunk string, n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make()
        for batch in batches:
            row, number, text, count = [], [], [], []
            for k, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                tokens = tokenizer.encode(value or "")
                for at, start in enumerate(range(0, max(len(tokens) - overlap, min(len(tokens), 1)), size - overlap)):
                    part = tokens[start : start + size]
                    row.append(k), number.append(at), text.append(tokenizer.decode(part)), count.append(len(part))
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns[:-1]), pa.array(number, pa.int32()), pa.array(text, pa.string()), pa.array(count, pa.int32())], names=[*keep, "chunk_no", "chunk", "n_tokens"])

    return rows.mapInArrow(run, schema)


def preprocess(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, strip_page1: bool = True) -> DataFrame:
    """Guard, boilerplate filter of first pages, collapse, windows."""
    kept, _ = guard(pages)
    if strip_page1:
        kept = strip_pages(kept, "text", F.coalesce(F.col("page") == 1, F.lit(False)))
    rows = kept.withColumn("clean", collapse(F.col("text"))).drop("text")
    return windows(rows, "clean", size, overlap)
