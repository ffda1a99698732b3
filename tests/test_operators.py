"""Operators on literals and against loops."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators import boilerplate, chunking, evaluation, generation, groundtruth, layout, models, relational, vectors
from lectern.plans import project
from lectern.sources import loaders, store
from lectern.streaming import ingest


def value(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, map(kind, values.values()), strict=True))) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def kind(v):
    return {str: "string", int: "int", float: "double", list: "array<string>", type(None): "string"}[type(v)]


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (1, 1), (40, 1), (220, 1), (221, 2), (400, 2), (401, 3)])
def test_window_count(spark, n, chunks):
    assert value(spark, chunking.window_count(F.col("n")), n=n) == chunks
    df = spark.createDataFrame([(" ".join(map(str, range(n))),)], "clean string")
    rows = sorted(chunking.windows(df).collect(), key=lambda r: r.chunk_no)
    got = [t for k, r in enumerate(rows) for t in r.chunk.split(" ")[40 * (k > 0) :]]
    assert len(rows) == chunks and got == [str(i) for i in range(n)]


def test_windows_need_progress():
    with pytest.raises(ValueError):
        chunking.window_count(F.lit(3), 10, 10)


def test_guard_uses_joined_text(spark):
    rows = [("a", 1, "abc"), ("a", 2, "def"), ("b", 1, "  " + "x" * 10), ("b", 2, "   "), ("b", 3, "y" * 9 + "  "), ("c", 1, None)]
    pages = spark.createDataFrame(rows, "source_file string, page bigint, text string")
    want = {s: len(" ".join(t or "" for q, _, t in rows if q == s).strip()) for s in "abc"}
    assert {r.source_file: r.n_chars for r in chunking.document_lengths(pages).collect()} == want
    kept, short = chunking.guard(pages)
    loose = spark.createDataFrame([(None, None, "t" * 30), ("d", None, "u" * 19)], "source_file string, page bigint, text string")
    assert [r.text[0] for r in chunking.guard(loose)[0].collect()] == ["t"]
    assert {r.source_file for r in kept.collect()} == {"b"} and {r.source_file for r in short.collect()} == {"a", "c"}


@pytest.mark.parametrize(("text", "bad"), [("(10,7),(984,990)", True), ("|" * 11 + " two words", True), ("", True), ("plain words here", False)])
def test_degenerate(spark, text, bad):
    assert value(spark, fn.degenerate(F.col("t")), t=text) is bad


@pytest.mark.parametrize(("text", "out"), [("0. 28", "0.28"), ("$ 975. 00", "$975.00"), ("1 , 2 , 3", "1,2 , 3")])
def test_number_spacing(spark, text, out):
    assert value(spark, fn.fix_number_spacing(F.col("t")), t=text) == out


def test_token_f1(spark):
    assert round(value(spark, fn.token_f1(F.col("a"), F.col("b")), a="a a b c".split(), b="a b b d a".split()), 4) == 0.6667


def test_judge(spark):
    df = spark.createDataFrame([("3,197 sentence pairs", "3197"), ("blue", "red"), ("one two three", "one two four five")], "e string, g string")
    rows = fn.judge(df, "e", "g").collect()
    assert rows[0].correct and rows[0].answer_in_expected and rows[0].expected_numbers == ["3197"]
    assert not rows[1].correct and not rows[1].needs_human_review
    assert rows[2].token_f1 == 0.571 and rows[2].needs_human_review


@pytest.mark.parametrize(("n", "name"), [(0, "empty"), (1, "single word"), (5, "short phrase"), (6, "sentence"), (15, "sentence"), (16, "long answer")])
def test_answer_class(spark, n, name):
    assert value(spark, fn.answer_class(F.col("n")), n=n) == name


@pytest.mark.parametrize(("needs", "budget", "got"), [([300] * 5, 1000, [270, 230, 195, 165, 140]), ([220] * 3, 500, [195, 165, 140]), ([50, 400, 400], 600, [50, 298, 252]), ([0, 100, 10], 60, [0, 50, 10]), ([10] * 3, 2, [1, 1, 0]), ([5, 5], 100, [5, 5]), ([220] * 8, 983, [204, 173, 147, 125, 105, 89, 76, 64]), ([10] * 8, 8, [2, 2, 2, 2, 0, 0, 0, 0])])
def test_budget(spark, needs, budget, got):
    df = spark.createDataFrame([(needs, budget)], "needs array<int>, budget int")
    assert df.select(generation.allocate_budget(F.col("needs"), F.col("budget")).alias("x")).first().x == got


def dealt(needs, budget):
    """The rule step by step."""
    got = [0] * len(needs)
    while budget > 0:
        hungry = [k for k in range(len(needs)) if got[k] < needs[k]]
        pool, total = budget, sum(0.85**k for k in hungry)
        for k in hungry:
            add = min(int(pool * 0.85**k / total), needs[k] - got[k], budget)
            got[k], budget = got[k] + add, budget - add
        if not hungry or budget == pool:
            for k in hungry[:budget]:
                got[k] += 1
            break
    return got


def test_budget_is_the_rule(spark):
    r = random.Random(0)
    rows = [([r.randrange(50) for _ in range(r.randrange(9))], r.randrange(200)) for _ in range(300)] + [([], 5), ([3], 0)]
    df = spark.createDataFrame(rows, "needs array<int>, budget int")
    for row in df.withColumn("got", generation.allocate_budget(F.col("needs"), F.col("budget"))).collect():
        assert row.got == dealt(row.needs, row.budget)
        assert sum(row.got) == min(sum(row.needs), row.budget)


def test_layout(spark):
    rows = [(10, 5, "b"), (0, 9, "c"), (14, 1, "a"), (40, 1, "z"), (26, 0, "q")]
    boxes = F.array(*(F.struct(F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for _ in range(4))).alias("box"), F.lit(t).alias("text"), F.lit(1.0).alias("confidence")) for y, x, t in rows))
    assert spark.range(1).select(layout.reorder_by_layout(boxes).alias("x")).first().x == "a b c\nq z"


def test_boilerplate(spark):
    text = "A Title Of The Paper\nJane Doe\nJohn Roe\nMary Major\nplain words go on here\nmore text in lower case\nwrite to a.b@c.org now\nand a last line of text\nanother line of text\nfinal words here"
    out = value(spark, boilerplate.strip_boilerplate(F.col("t")), t=text)
    assert out == "A Title Of The Paper\nplain words go on here\nmore text in lower case\nand a last line of text\nanother line of text\nfinal words here"
    assert value(spark, boilerplate.strip_boilerplate(F.col("t")), t="Title\na@b.org\nc@d.org\ne@f.org") == "Title\na@b.org\nc@d.org\ne@f.org"
    two = "A title with lower case words\nJane Doe\nJohn Roe\n\nMary Major\nsome text"
    assert value(spark, boilerplate.strip_boilerplate(F.col("t")), t=two) == two


def test_runs_of_name_lines_against_a_loop(spark):
    draw = random.Random(5)
    cases = ["", "\n", "a\r\n", "a\n\r", "\r\n\r\n", "a\x1cb\u2028"] + ["\n".join(draw.choice(["Jane Doe", "plain words here", ""]) for _ in range(draw.choice([3, 12, 4000]))) for _ in range(8)]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, t string").withColumn("f", boilerplate.flagged(F.col("t"))).collect()
    for row in rows:
        parts = fn_lines(row.t)
        assert [r.line for r in row.f] == parts
        named = [r.name for r in row.f]
        for i, r in enumerate(row.f):
            a = b = i
            while a and named[i] and named[a - 1]:
                a -= 1
            while named[i] and b + 1 < len(named) and named[b + 1]:
                b += 1
            assert r.run == (b - a + 1 if named[i] else 0)
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(boilerplate.strip_boilerplate(F.col("t")).alias("x")).first().x is None


def fn_lines(text):
    import re

    parts = re.split("\r\n|[\n\x0b\x0c\r\x85\u2028\u2029\x1c-\x1e]", text)
    return parts[:-1] if len(parts) > 1 and not parts[-1] else parts


def test_windows_clean_each_text_once(spark):
    rows = spark.createDataFrame([(1, " a  b "), (2, ""), (3, None), (4, " \t")], "k int, t string")
    out = chunking.windows(rows.withColumn("clean", fn.collapse(F.col("t"))).drop("t"))
    assert [tuple(r) for r in out.collect()] == [(1, 0, "a b", 2)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    one, many = spark.range(0, 1000, 1, 1), spark.range(0, 1000, 1, cores + 1)
    assert relational.spread(many, "id") is many
    dealt = relational.spread(one, "id")
    assert dealt.rdd.getNumPartitions() == cores and sorted(r.id for r in dealt.collect()) == list(range(1000))
    assert dealt.groupBy(F.spark_partition_id().alias("p")).count().count() == cores


def test_normalisers(spark):
    assert value(spark, fn.normalise_answer(F.col("t")), t="It was 3,197 — or 1 2. e.g. 0.5!") == "it was 3197 or 12 e g 0.5"
    assert value(spark, fn.clean_answer(F.col("t")), t="  Ünïcode  A ") == "ncode a"
    assert value(spark, fn.safe_name(F.col("t")), t=" ..a<b>:c. ") == "abc"


def test_flagship_against_brute_force(spark):
    import numpy as np

    from lectern import queries

    d = "/root/testdata/sf0.001"
    top = queries.QUERIES["question_topk"](spark, d).collect()
    rows = queries.chunks(spark, d).select("position", "chunk").collect()
    asked = queries.table(spark, d, "benchmark").collect()
    model = vectors.HashingEmbedder()
    x = model([r.chunk for r in rows])
    for q in asked[:10]:
        dist = ((model([" ".join(q.text.split())]) - x) ** 2).sum(axis=1)
        want = np.sort(dist)[:5]
        got = [r.distance for r in sorted((r for r in top if r.qid == q.item_id), key=lambda r: r.rank)]
        assert np.allclose(got, want, atol=2e-6)


def test_knn_shorter_table_and_prefix(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "id bigint, embedding array<double>")
    q = df.where("id = 0").withColumnRenamed("id", "qid")
    assert [r.id for r in vectors.knn(q, df, 10).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert [r.id for r in vectors.knn(q, df, 2).orderBy("rank").collect()] == [0, 1]


def test_pearson_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(evaluation.pearson("x", "y").alias("r")).first().r is None


def test_interference(spark):
    schema = "qid bigint, first_correct_rank int"
    row = evaluation.compare_single(spark.createDataFrame([(1, None)], schema), spark.createDataFrame([(1, 2)], schema)).first()
    assert row.rank_improvement == 97 and row.cross_document_interference


def test_mid_slice(spark):
    w = [str(i) for i in range(1, 32)]
    assert value(spark, groundtruth.mid_slice(F.col("w")), w=w) == " ".join(w[8:23])


def test_project_from_files_to_answers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("The river floods in spring. The dam was built in 1931. Fish live there.")
    (tmp_path / "in/b.pdf").write_bytes(b"page one about bread and butter\x0c\x0cpage three about salt and pepper")
    (tmp_path / "in/c.pdf").write_bytes(b"bad")

    def parser(data):
        if data == b"bad":
            raise ValueError("no pdf")
        return data.decode().split("\x0c")

    assert [r.name for r in loaders.list_files(spark, str(tmp_path / "in")).collect()] == ["a.txt", "b.pdf", "c.pdf"]
    rows = loaders.load_folder(spark, str(tmp_path / "in"), {"pdf": parser})
    index, stats, failures = project.build(rows, str(tmp_path / "index"))
    assert {(r.source_file, r.chunks, r.pages) for r in stats.collect()} == {("a.txt", 1, None), ("b.pdf", 2, 3)}
    assert [(r.name, r.error) for r in failures.collect()] == [("c.pdf", "ValueError: no pdf")]
    q = spark.createDataFrame([(1, "when was the dam built")], "qid bigint, question string")
    row = project.ask(q, index, 1).first()
    assert "1931" in row.answer and row.sources == ["a.txt"]
    with pytest.raises(ValueError):
        loaders.parse_files(spark, str(tmp_path), "video", parser)


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "é")], "id bigint, t string")
    store.save(df, str(tmp_path / "s"))
    assert groundtruth.consistent(store.load(spark, str(tmp_path / "s")), df).count() == 0
    store.append_absent(spark.createDataFrame([(2, "x"), (3, "c")], "id bigint, t string"), str(tmp_path / "s"), "id")
    assert sorted(r.t for r in store.load(spark, str(tmp_path / "s")).collect()) == ["a", "c", "é"]
    (tmp_path / "old.json").write_text('["bare", {"text": "t", "source_file": "f", "page": 2}]')
    assert [tuple(r)[1:] for r in store.load_legacy(spark, str(tmp_path / "old.json")).orderBy("position").collect()] == [("bare", None, None), ("t", "f", 2)]


def test_stream_appends_each_file_once(spark, tmp_path):
    pages = spark.createDataFrame([("f", 1, "some words here"), ("f", 2, "and more of them")], "source_file string, page bigint, text string")
    for n in (2, 4):
        pages.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n


def test_white_space_and_digits_of_other_scripts(spark):
    assert value(spark, fn.normalise_answer(F.col("t")), t="1\u00a0550") == "1550"
    assert value(spark, fn.fix_number_spacing(F.col("t")), t="1\u00a0.\u00a05 $\u20035") == "1.5 $5"
    assert value(spark, fn.blank(F.col("t")), t="\n\t\u00a0\u2003") is True and value(spark, fn.stripped(F.col("t")), t="\u00a0a b\u2003") == "a b"
    assert value(spark, fn.degenerate(F.col("t")), t="\u00a0(1,\u0663)") is True


@pytest.mark.parametrize(("line", "flag"), [("Laboratory of Things", "institution"), ("National Laboratories", "institution"), ("J. R. R. T. Smith, A. Doe", "initials"), ("Jane Doe", "name")])
def test_fixed_patterns(spark, line, flag):
    assert value(spark, fn.line_flags(F.col("t")), t=line)[flag] is True


def test_knn_of_labels_and_nulls(spark):
    rows = [(0, [0.0, 1.0], -1), (1, [0.0, 2.0], -1), (2, [0.0, 1.0], -2), (3, None, -1), (4, [5.0, 5.0], None)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>, label int")
    q = df.where("id in (0, 3, 4)").withColumnRenamed("id", "qid")
    assert sorted((r.qid, r.id) for r in vectors.knn(q, df, 5, same="label").collect()) == [(0, 0), (0, 1)]


def test_per_sample(spark):
    chunks = spark.createDataFrame([(1, 1, "red apples grow"), (2, 1, "blue sky above"), (3, 2, "red apples grow"), (4, 3, "x")], "id bigint, sample int, chunk string")
    asked = spark.createDataFrame([(1, 1, "red apples"), (2, 2, "blue sky"), (3, 3, "x")], "qid bigint, sample int, question string")
    got = vectors.per_sample(asked, chunks, "sample", 1, least=5).collect()
    assert sorted((r.qid, r.id) for r in got) == [(1, 1), (2, 3)]


def test_self_retrieval_against_brute_force(spark):
    import numpy as np

    texts = [" ".join(f"w{(i * 37 + k * (i + 3)) % 101}" for k in range(60)) for i in range(12)]
    index = vectors.embed(spark.createDataFrame([(i, f"f{i % 3}", i, t) for i, t in enumerate(texts)], "position bigint, source_file string, page bigint, chunk string"), "chunk")
    asked = spark.createDataFrame([(i, i, f"f{i % 3}", i, texts[i], " ".join(texts[i].split()[20:30])) for i in range(12)], "qid bigint, position bigint, source_file string, page bigint, chunk string, answer string")
    out = groundtruth.self_retrieval(asked, index, vectors.embed)
    model = vectors.HashingEmbedder()
    x = model(texts)
    for r in out.collect():
        w = texts[r.qid].split()
        a = set(w[20:30])
        start = max(range(len(w) - 14), key=lambda s: len(set(w[s : s + 15]) & a))
        text = {"full_text": texts[r.qid], "substring_midchunk": " ".join(w[23:38]), "substring_answer_window": " ".join(w[start : start + 15])}[r.kind]
        dist = ((model([text]) - x) ** 2).sum(axis=1)
        order = sorted(range(12), key=lambda k: (dist[k], k))[:5]
        assert abs(r.first_distance - dist[order[0]]) < 1e-9
        assert r.first_correct_rank == (order.index(r.qid) + 1 if r.qid in order else None) and r.hit_at_1 == (order[0] == r.qid)
    v = groundtruth.verdict(out, out.limit(0)).first()
    assert v.targets == 12 and v.full_text == 12 and v.clean


def test_self_retrieval_over_texts(spark):
    """An index without embeddings is embedded where it is searched, and the rows are the same."""
    texts = [" ".join(f"w{(i * 41 + k * (i + 5)) % 97}" for k in range(50)) for i in range(30)]
    index = spark.createDataFrame([(i, f"f{i % 3}", i, t) for i, t in enumerate(texts)], "position bigint, source_file string, page bigint, chunk string")
    asked = index.selectExpr("position as qid", "position", "source_file", "page", "chunk", "substring(chunk, 20, 40) as answer")
    want = groundtruth.self_retrieval(asked, vectors.embed(index, "chunk"), vectors.embed)
    got = groundtruth.self_retrieval(asked, index, vectors.embed)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() == 90


def test_token_windows_by_a_vocabulary(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = [f"w{i}" for i in range(500)]
    t = Tokenizer(models.WordLevel({w: i for i, w in enumerate([*words, "[UNK]"])}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "t.json"))
    df = spark.createDataFrame([(n, " ".join(words[:n])) for n in (0, 1, 220, 221, 401)] + [(-1, None)], "id int, clean string")
    got = chunking.token_windows(df, lambda p=str(tmp_path / "t.json"): chunking.LibraryTokenizer(p)).collect()
    plain = chunking.windows(df).collect()
    assert sorted((r.id, r.chunk_no, r.chunk, r.n_tokens) for r in got) == sorted((r.id, r.chunk_no, r.chunk, r.n_tokens) for r in plain)


def test_readers_of_images():
    def fails(data):
        raise RuntimeError

    both = models.RecognizerAndCaptioner(lambda d: " found ", lambda d: "")
    assert models.ImageScanner(fails, both)(b"x") == models.ImageScanner(lambda d: " ", both)(b"x") == "Extracted text:  found "
    assert models.ImageScanner(lambda d: "read", both)(b"x") == "read"
    assert models.device("npu", ("gpu", "cpu")) == "cpu" == models.device("toaster") and models.device("GPU") == "gpu"


def test_files_in_order_and_samples(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in "ab":
        (tmp_path / f"in/{n}.txt").write_text(f"text of {n}")
    (tmp_path / "in/c.docx").write_text("no loader")
    assert [r.name for r in loaders.import_samples(spark, str(tmp_path / "in"), project.create(spark, str(tmp_path), "my: project")).collect()] == ["a.txt", "b.txt"]
    rows = loaders.read_text(spark, str(tmp_path / "my project"))
    assert sorted((r.doc_order, r.source_file) for r in loaders.in_order(rows, ["b.txt", "a.txt"]).collect()) == [(0, "b.txt"), (1, "a.txt")]
    with pytest.raises(FileNotFoundError):
        loaders.in_order(rows, ["a.txt", "z.txt"])
    with pytest.raises(ValueError):
        project.create(spark, str(tmp_path), ' .<>. ')


def test_pages_of_null_sources_stay(spark, tmp_path):
    from lectern import queries

    spark.createDataFrame([(4, None, "a b"), (6, None, "c"), (1, "s", "d")], "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((r.doc_id, r.page) for r in queries.pages(spark, str(tmp_path)).collect()) == [(1, 1), (4, 1), (6, 3)]
