"""Files to page records."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.functions.text import blank, modality

PAGES = "source_file string, page int, text string, error string"
TYPES = ("pdf", "image", "audio", "text")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Name, path, time, length and modality of the files that some loader knows, by lower-cased name; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    return df.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).withColumn("modality", modality(F.col("path"))).where("modality is not null").orderBy(F.lower("name"))


def parse_files(spark: SparkSession, folder: str | list[str], kind: str, parser: Callable[[bytes], str | list[str]]) -> DataFrame:
    """Page records of all files of one kind; the parser gives a text or a list of pages. A file that fails gives a row with its error (X1). Blank pages go, numbers stay."""
    if kind not in TYPES:
        raise ValueError(f"type must be one of {', '.join(TYPES)}")  # S2
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(modality(F.col("path")) == kind).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    out = parser(content)
                    rows += [(name, None, out, None)] if isinstance(out, str) else [(name, i + 1, t, None) for i, t in enumerate(out)]
                except Exception as e:  # noqa: BLE001  a bad file mustn't end the others
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_file", "page", "text", "error"])

    return files.mapInPandas(run, PAGES).where(F.col("error").isNotNull() | ~blank(F.col("text")))


def read_text(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """One record for each text file, its contents whole; blank ones go."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").text(folder, wholetext=True)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("source_file"), F.lit(None).cast("int").alias("page"), F.col("value").alias("text"), F.lit(None).cast("string").alias("error")).where(~blank(F.col("text")))


def raw_text(spark: SparkSession, text: str) -> DataFrame:
    """S7 for a string given as such."""
    if not isinstance(text, str):
        raise TypeError("text must be a string")
    if not text.strip():
        raise ValueError("text is blank")
    return spark.createDataFrame([(None, None, text, None)], PAGES)


def load_folder(spark: SparkSession, folder: str | list[str], parsers: dict[str, Callable[[bytes], str | list[str]]]) -> DataFrame:
    """All files of a folder, or of a list of paths, whose kind has a parser, and text files, as one table of page records."""
    parts = [parse_files(spark, folder, kind, p) for kind, p in parsers.items()] + [read_text(spark, folder)]
    return reduce(DataFrame.unionByName, parts)


def in_order(pages: DataFrame, names: list[str]) -> DataFrame:
    """Pages of the named files with their document's place in the list; a file without pages is an error."""
    places = pages.sparkSession.createDataFrame(list(enumerate(names)), "doc_order int, source_file string")
    missing = [r.source_file for r in places.join(pages, "source_file", "left_anti").orderBy("doc_order").collect()]  # of the list's files
    if missing:
        raise FileNotFoundError(f"no pages of {', '.join(missing)}")
    return pages.join(F.broadcast(places), "source_file")


def import_samples(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Copies all files that some loader knows into a folder, through Spark's file systems; returns their names."""
    files = list_files(spark, folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(conf)
    fs.mkdirs(path(target))
    for r in files.select("path", "name").collect():  # a folder of samples
        source = path(r.path)
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, fs, path(f"{target}/{r.name}"), False, True, conf)
    return files.select("name", "modality")


def by_suffix(reader: Callable[[str], str], suffix: str) -> Callable[[bytes], str]:
    """A parser from a reader that wants a path: the bytes go to a file of the worker's own for as long as it reads."""

    def parse(content: bytes) -> str:
        with tempfile.NamedTemporaryFile(suffix=suffix, delete=False) as f:
            f.write(content)
        try:
            return reader(f.name)
        finally:
            os.unlink(f.name)

    return parse


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An array of objects, or, with lines, one object a line."""
    return spark.read.json(path, multiLine=not lines)


def read_csv(spark: SparkSession, path: str, arrays: tuple[str, ...] = ()) -> DataFrame:
    """With a header; columns named in arrays hold JSON arrays of strings."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.withColumns({c: F.from_json(c, "array<string>") for c in arrays}) if arrays else df


def take(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by an order."""
    return df.orderBy(order).limit(n)
