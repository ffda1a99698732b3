"""The page source against the loaders; what a query doesn't ask for isn't opened."""

import os

import pytest

from lectern.functions.text import modality
from lectern.sources import loaders, pagesource
from pyspark.sql import functions as F


def pages(content):
    if content.startswith(b"bad"):
        raise ValueError("no pages")
    return content.decode().split("|")


def caption(content):
    return f"a picture of {len(content)} bytes"


def broken(content):
    raise AssertionError("this kind mustn't be opened")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "deep").mkdir()
    for name, text in {"a.pdf": "one||three", "B.PDF": "bad file", "deep/c.txt": "some text\nof two lines", "blank.txt": "  \n", "d.TXT": "upper", "e.png": "12345", "f.docx": "unknown", "g.mp3": "sound", "none": "x"}.items():
        (root / name).write_text(text)
    return str(root)


def source(spark, folder, **options):
    pagesource.register(spark)
    return spark.read.format("lectern_pages").option("path", folder).options(**options).load()


def rows(df):
    return sorted(map(str, df.select("source_file", "page", "text", "error").collect()))


@pytest.mark.parametrize("size", ["1", "1000000"])
def test_pages_are_the_loaders(spark, folder, size):
    got = source(spark, folder, pdf=f"{__name__}:pages", image=f"{__name__}:caption", bytes=size)
    want = loaders.load_folder(spark, folder, {"pdf": pages, "image": caption})
    assert rows(got) == rows(want) and len(rows(got)) == 6
    assert {r.modality for r in got.collect()} == {"pdf", "image", "text"}  # sounds have no parser here
    assert got.rdd.getNumPartitions() == (6 if size == "1" else 1)


def test_other_kinds_are_not_opened(spark, folder):
    df = source(spark, folder, pdf=f"{__name__}:broken", image=f"{__name__}:broken")
    assert df.where("error is not null").count() == 3
    assert rows(df.where("modality = 'text'")) == rows(loaders.read_text(spark, folder))
    assert df.where("modality in ('text', 'audio') and error is not null").count() == 0
    assert df.where("source_file = 'd.TXT'").select("text").collect() == [("upper",)]
    names = source(spark, folder, pdf=f"{__name__}:broken", image=f"{__name__}:broken", columns="source_file, length")
    assert {(r.source_file, r.length, r.error) for r in names.collect()} == {("a.pdf", 10, None), ("B.PDF", 8, None), ("c.txt", 22, None), ("blank.txt", 3, None), ("d.TXT", 5, None), ("e.png", 5, None)}


def test_kinds_are_those_of_the_dispatch(spark):
    paths = [f"/x/y.{e}" for e in [*pagesource.KINDS, "PDF", "docx", ""]] + ["none", "/a.b/c", "x.tar.TXT"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.m for r in df.select("p", modality(F.col("p")).alias("m")).collect()} == {p: pagesource.kind_of(p) for p in paths}


def test_options_are_checked(spark, folder):
    with pytest.raises(Exception, match="path"):
        pagesource.register(spark)
        spark.read.format("lectern_pages").load().collect()
    assert source(spark, os.path.join(folder, "deep"), text=f"{__name__}:broken").first().error.startswith("AssertionError")
