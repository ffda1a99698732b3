"""Collocations, token counts and the divergence audit against brute force, the library and SQL, and on awkward tables."""

import collections
import random
import re

import pyarrow as pa
import pytest
from conftest import DATA, plain
from pyspark.sql import functions as F

from lectern.llm import collocations, divergence, tokencount

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, " \n\t ", "en", "s", 4), (3, "A b, a B", None, "s", 3), (3, "A b, a B", None, "s", 3), (4, "é ü " * 9000, "fr", None, 36000), (5, "x.y" * 3, "und", "", 1), (6, "Ａ a<b>\x00\x85a b▁c　d", "", "t", 1), (7, "a b a b. a b", "und", "t", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, i, "z", i) for i, r in enumerate(ODD)], DOCS + ", block int, term string, tid int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokencount.public_model())


@pytest.fixture(scope="module")
def merges():
    return tokencount.table_of(tokencount.public_model())


# --- token counts ------------------------------------------------------------------------------


def test_counts_are_the_librarys(spark, docs, odd, model):
    for df in (docs, odd, odd.limit(0)):
        out = collections.Counter(tuple(r) for r in tokencount.count_tokens(df, tokencount.public_model(), limit=300).collect())
        want = collections.Counter()
        for r in df.collect():
            n = len(model.encode(r.text or "", num_threads=1))
            want[(r.doc_id, len((r.text or "").encode()), n, n > 300)] += 1
        assert out == want


def test_counts_of_mixed_texts(model, merges):
    r = random.Random(5)
    bits = ["a", "b", "the", "ing", "ingingi", "th", "e", "he", " ", "  ", "   ", "\n", "\t", "é", "1", "23", "中", "🙂", "▁", "tion", "ions", "==", "====", "--", "</s>", "_", "__", "ер", "при", "вет", "ö", "　", "\x00", "\x85", "return"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(4000)] + ["".join(r.choice("aeinstgh") for _ in range(r.randrange(900))) for _ in range(300)] + [" " * n for n in range(70)] + ["x" + " " * n + "y" for n in range(70)]
    assert merges.count(pa.array(texts)).tolist() == [len(x) for x in model.encode(texts, num_threads=1)]


@pytest.mark.parametrize("unit", ["a", " ", "\n", "ing", "x y", "中文字", "🙂", "\x01", "▁", "q=", "é"])
def test_counts_of_a_megabyte(model, merges, unit):
    text = unit * (1_000_000 // len(unit))
    assert merges.count(pa.array([text, "", text[:1000]])).tolist() == [len(model.encode(text)), 0, len(model.encode(text[:1000]))]


def test_queue_and_steps_agree(merges, monkeypatch):
    r = random.Random(9)
    texts = pa.array(["".join(r.choice("thequickbrown ") for _ in range(300)) for _ in range(300)])
    whole = merges.count(texts).tolist()
    monkeypatch.setattr(tokencount, "STEPS", 0)
    assert merges.count(texts).tolist() == whole


def test_kept_columns_may_not_clash(docs):
    with pytest.raises(ValueError):
        tokencount.count_tokens(docs.withColumn("n_tokens", F.lit(1)), tokencount.public_model(), keep=("n_tokens",))


# --- collocations ------------------------------------------------------------------------------


def brute_collocations(rows, least, top, longest=5):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[(lang, tuple(w[i : i + k]))] += 1
    some = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    gone = {(lang, p[i : i + k]) for (lang, p), c in some.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c >= 100 * f[(lang, p[i : i + k])]}
    out = collections.defaultdict(list)
    for (lang, p), a in some.items():
        if (lang, p) not in gone:
            cuts = [(1000 * a * n[lang] // (f[(lang, p[:k])] * f[(lang, p[k:])]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang].append((score, a, " ".join(p), f[(lang, p[:k])], f[(lang, p[k:])]))
    result = set()
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        result |= {(lang, i + 1, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(found[:top])}
    return result


def found_collocations(df, **how):
    return [tuple(r) for r in collocations.top_collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]


def test_collocations(spark, odd):
    r = random.Random(2)
    texts = [(" ".join(r.choice(["the", "The", "of", "a", "red", "fox", "é", "new york city", "ad hoc committee now open", "x.", ", y", "b;c", "\tq", "z\n"]) for _ in range(r.randrange(90))), r.choice(["en", "de", None, "und"])) for _ in range(160)]
    df = spark.createDataFrame(texts, "text string, lang string")
    for how in ({"least": 5, "top": 2000}, {"least": 2, "top": 17, "block_bytes": 500}):
        out = found_collocations(df.repartition(3), **how)
        assert len(out) == len(set(out)) and set(out) == brute_collocations(texts, how["least"], how["top"])
    rows = [(x[1], x[2]) for x in ODD]
    assert set(found_collocations(odd, least=2)) == brute_collocations(rows, 2, 2000)
    assert found_collocations(odd.limit(0)) == []


@pytest.mark.parametrize("bounds", [{"NAMES_MOST": 0}, {"NAMES_MOST": 0, "NARROW": 0}, {"NAMES_CHARS": 3}, {"NAMES_MOST": 0, "full": True}])
def test_collocations_beyond_the_bounds(spark, docs, monkeypatch, bounds):
    """Names beyond what is sent to tasks, ids of over 31 bits and a full table of bits: the rows stay."""
    import numpy as np

    want = found_collocations(docs, least=20)
    for name, value in bounds.items():
        if name == "full":
            monkeypatch.setattr(collocations, "bit_table", lambda names: np.ones(collocations.FILTER_BITS, bool))
        else:
            monkeypatch.setattr(collocations, name, value)
    assert sorted(found_collocations(docs, least=20)) == sorted(want) and want


def test_long_text_is_cut_between_pieces():
    text = b"a b. c d, " * 5000
    parts = collocations.sliced(text, 1000)
    assert b"".join(parts) == text and max(map(len, parts)) < 1020 and collocations.sliced(b"a" * 5000, 1000) == [b"a" * 5000]


def test_counts_beyond_64_bits(spark):
    """Scores of names whose counts are as large as those of a hundred terabytes."""
    f, n = 3 * 10**12, 2 * 10**13
    score = spark.sql(f"select (cast(1000 as decimal(4,0)) * cast({f} as decimal(19,0)) * cast({n} as decimal(19,0))) div (cast({f + 1} as decimal(19,0)) * cast({f + 7} as decimal(19,0))) as s").first().s
    assert score == 1000 * f * n // ((f + 1) * (f + 7))


# --- divergence ------------------------------------------------------------------------------


def brute_divergence(rows, least=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    df, count = collections.Counter(), collections.Counter()
    for text, lang, source in rows:
        df.update((lang, t) for t in set(terms(text)))
    for text, lang, source in rows:
        count.update((lang, source, t) for t in terms(text) if df[(lang, t)] >= least)
    out = set()
    for lang in {r[1] for r in rows}:
        kept = [t for (x, t), c in df.items() if x == lang and c >= least]
        sources = {r[2] for r in rows if r[1] == lang}

        def shares(get, kept=kept):
            n = sum(map(get, kept))
            return {t: 1 + 10**9 * (get(t) + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(lambda t, s=s: count[(lang, s, t)]) for s in sources}
        whole = shares(lambda t: sum(count[(lang, s, t)] for s in sources))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            own = [((p[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if count[(lang, s, t)] and p[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", own)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top}
    return out


def found_divergence(df, **how):
    return [tuple(r) for r in divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()]


@pytest.mark.parametrize("groups", [1 << 16, 0])
@pytest.mark.parametrize("how", [{}, {"head_terms": 5}, {"head_chars": 12}])
def test_divergence(spark, odd, monkeypatch, how, groups):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    r = random.Random(4)
    rows = [("".join(r.choice(["the ", "The,", "of_", "a ", "red1", "fox", "é", "ÀB ", "new-york ", "　", " ", "x" * 70 + " ", "q"]) for _ in range(r.randrange(60))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None, "é"])) for _ in range(120)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    out = found_divergence(df, **how)
    assert len(out) == len(set(out)) and set(out) == brute_divergence(rows)
    assert set(found_divergence(odd, least=1, **how)) == brute_divergence([(x[1], x[2], x[3]) for x in ODD], 1)
    assert set(found_divergence(odd, **how)) == brute_divergence([(x[1], x[2], x[3]) for x in ODD])
    assert found_divergence(odd.limit(0), **how) == []


def test_divergence_in_small_strips(spark, docs, monkeypatch):
    want = sorted(found_divergence(docs))
    for name, value in (("PAIRS", 3), ("POSTINGS", 50), ("SLICE", 40), ("FLUSH", 10), ("GROUPS", 0)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(found_divergence(docs.limit(60), top=9)) == sorted(brute_divergence([(r.text, r.lang, r.source) for r in docs.limit(60).collect()], top=9))
    assert want


def test_automaton_meets_whole_terms():
    import numpy as np

    v = divergence.Vocabulary({"en": (b"a\nab\nb", np.array([0, 1, 3])), "de": (b"b", np.array([2]))})
    assert [x.tolist() for x in v.counts(" a ab  b ba a ")] == [[0, 1, 2], [2, 1, 1]] and v.ids["de"].tolist() == [-1, -1, 2]
