"""SQL functions against the same functions of the DataFrame API, and the table function against the windows operator."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import sql, text as fn
from lectern.operators import chunking, generation


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    return spark


def test_answers(session):
    r = random.Random(2)
    texts = [None, "", "A 1,234.50 b", "1 , 2. 3", "x.y", *("".join(r.choice(["a", "B ", "1", "2,", ". ", " ", "é", "|"]) for _ in range(r.randrange(30))) for _ in range(300))]
    df = session.createDataFrame([(i, t, r.choice(texts)) for i, t in enumerate(texts)], "i int, e string, g string")
    df.createOrReplaceTempView("answers")
    e, g = (fn.tokens(fn.normalise_answer(F.col(c))) for c in "eg")
    want = df.select("i", fn.normalise_answer(F.col("e")).alias("n"), fn.token_f1(e, g).alias("f1"), fn.degenerate(F.col("e")).alias("d"))
    got = session.sql("SELECT i, normalise_answer(e) AS n, token_f1(e, g) AS f1, is_degenerate(e) AS d FROM answers")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Python" not in got._jdf.queryExecution().toString()


def test_budgets(session):
    r = random.Random(5)
    rows = [(i, [r.randrange(0, 60) for _ in range(r.randrange(6))], r.randrange(-3, 150)) for i in range(200)] + [(900, None, 5), (901, [5, 5], None)]
    df = session.createDataFrame(rows, "i int, n array<int>, b int")
    df.createOrReplaceTempView("budgets")
    want = df.select("i", generation.allocate_budget(F.col("n"), F.coalesce("b", F.lit(0))).alias("a"))
    assert sorted(map(tuple, session.sql("SELECT i, allocate_budget(n, b) AS a FROM budgets").collect())) == sorted(map(tuple, want.collect()))


def test_windows(session):
    r = random.Random(1)
    rows = [(f"f{i % 3}", i, " ".join(f"w{j}" for j in range(r.choice([0, 1, 4, 5, 9, 30]))), "k") for i in range(40)] + [(None, 99, None, "k")]
    df = session.createDataFrame(rows, "source_file string, page bigint, body string, chunkless string")
    df.createOrReplaceTempView("texts")
    got = session.sql("SELECT * FROM chunk_windows(TABLE(texts) PARTITION BY source_file ORDER BY page, text_column => 'body', size => 5, overlap => 2)")
    want = chunking.windows(df.withColumnRenamed("body", "clean"), size=5, overlap=2)
    cols = ["source_file", "page", "chunkless", "chunk_no", "chunk", "n_tokens"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    for f in ("f0", "f1", "f2"):
        places = [x.position for x in got.where(F.col("source_file") == f).orderBy("page", "chunk_no").collect()]
        assert places == list(range(len(places)))
    for bad in ("text_column => 'nothing'", "text_column => 'body', size => 3, overlap => 3"):
        with pytest.raises(Exception, match="no column|overlap"):
            session.sql(f"SELECT * FROM chunk_windows(TABLE(texts) PARTITION BY source_file, {bad})").collect()
