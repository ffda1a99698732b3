"""Exact quantiles, anchors' other pages, range digests and token budgets against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, cleaning, generation, groundtruth


@pytest.mark.parametrize("most", [3, 50, 10_000])
def test_quantiles(spark, duck, most):
    r = np.random.default_rng(4)
    p = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    columns = {
        "normal": r.normal(size=3000),
        "ties": np.where(r.random(3000) < 0.4, 7.0, r.integers(0, 30, 3000)),
        "steep": np.exp(r.normal(size=3000) * 40),
        "one": np.full(900, 2.5),
        "few": np.array([3.0, -1.0]),
    }
    for name, values in columns.items():
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        got = cleaning.exact_quantiles(df, "v", p, most=most, accuracy=50)
        want = np.quantile(values, p)
        assert np.allclose(got, want, rtol=1e-12, atol=0), name
        assert np.allclose(got, duck.execute("SELECT quantile_cont(x, ?) FROM (SELECT unnest(?) AS x)", [p, values.tolist()]).fetchone()[0], rtol=1e-12, atol=0), name
    assert cleaning.exact_quantiles(df.limit(0), "v", [0.5]) == [None]


def test_other_pages(spark):
    r = random.Random(2)
    pages = [(r.choice(["f", "g", None]), p, " ".join(r.choice(["aa", "bb", "cc", "dd"]) for _ in range(r.randrange(4)))) for p in range(40)]
    anchors = [(i, *r.choice(pages)[:2], r.choice(["aa", "bb cc", "cc", "zz", "", None])) for i in range(60)]
    got = groundtruth.other_pages(spark.createDataFrame(anchors, "anchor_id bigint, source_file string, page bigint, anchor string"), spark.createDataFrame(pages, "source_file string, page bigint, text string"), per_row=7)
    want = {i: sorted(p for g, p, t in pages if a and g == f and p != own and a in t) for i, f, own, a in anchors}
    assert {x.anchor_id: x.other_pages for x in got.collect()} == want


def test_differences(spark):
    r = random.Random(3)
    left = [(r.randrange(300), r.choice("abc"), r.choice([None, 1.5])) for _ in range(500)] + [(None, "n", 0.0)]
    right = [x for x in left if x[0] is None or x[0] % 41] + [(1000 + i, "new", None) for i in range(4)]
    right = [(k, "moved" if k and k % 37 == 0 else v, n) for k, v, n in right] + [right[3]]
    schema = "k bigint, v string, n double"
    a, b = collections.Counter(left), collections.Counter(right)
    want = {}
    for k in {x[0] for x in [*left, *right]}:
        one, two = ({x: n for x, n in c.items() if x[0] == k} for c in (a, b))
        if one != two:
            want[k] = "changed" if one and two else "lost" if one else "added"
    df, other = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).repartition(5)
    got = groundtruth.differing(df, other.select("n", "v", "k"), "k").collect()
    assert len(got) == len(want) and {x.k: x.kind for x in got} == want
    assert groundtruth.differing(df, df.repartition(4), "k").count() == 0
    with pytest.raises(ValueError):
        groundtruth.differing(df, df.drop("v"), "k")


def test_shares_are_the_folds(spark):
    r = random.Random(7)
    rows = [(i, [r.randrange(0, 40) for _ in range(r.randrange(7))], r.randrange(-2, 120)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, n array<int>, b int")
    want = {x.i: x.a for x in df.select("i", generation.allocate_budget(F.col("n"), F.col("b")).alias("a")).collect()}
    assert {i: generation.shares_of(n, b) for i, n, b in rows} == want


def test_contexts_fit_in_tokens(spark):
    import public_tokenizers

    r = random.Random(5)
    words = ["the", "und", "café", "中文", "don't", "x1y2", "a" * 30, "\n", "  ", "🙂", "1,234"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randrange(8)), [text(r.randrange(60)) for _ in range(r.randrange(6))]) for i in range(150)] + [(900, text(300), ["a"]), (901, None, None), (902, "q", [None, "b"])]
    df = spark.createDataFrame(rows, "i int, q string, c array<string>")
    for file in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = chunking.LibraryTokenizer(public_tokenizers.path(file))
        path = public_tokenizers.path(file)
        for limit in (60, 120, 2000):
            out = {x.i: x.context for x in generation.token_context(df, "q", "c", lambda path=path: chunking.LibraryTokenizer(path), limit=limit).collect()}
            for i, q, c in rows:
                q, c = q or "", [x or "" for x in c or []]
                shell = len(t.encode(f"Question: {q}\nContext: \nAnswer:"))
                room, sizes = limit - generation.MARGIN - shell, [len(t.encode(x)) for x in c]
                if room <= 0:
                    assert out[i] == ""
                    continue
                assert len(t.encode(f"Question: {q}\nContext: {out[i]}\nAnswer:")) <= limit
                whole = " ".join(t.decode(t.encode(x)) for x in c)
                if sum(sizes) + max(0, len(c) - 1) <= room and len(t.encode(whole)) <= room:
                    assert out[i] == whole
                elif sum(sizes) + len(c) - 1 > room:
                    cut = [t.decode(t.encode(x)[:n]) for x, n in zip(c, generation.shares_of(sizes, room - len(c) + 1)) if n]
                    assert out[i] == " ".join(cut) or len(t.encode(" ".join(cut))) > room or len(t.encode(f"Question: {q}\nContext: {' '.join(cut)}\nAnswer:")) > limit
                    assert out[i] or room < len(c) + 3
