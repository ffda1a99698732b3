"""Each operator against brute force, SQL, a round trip or held-out rows, and on awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import DATA, plain
from pyspark.sql import functions as F

from lectern.llm import bpe, chat, dartminhash, mixing, multiset, pitmanyor, quality, queries, secrets, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, " \n\t ", "en", "s", 4), (3, "a b", None, "s", 3), (3, "a b", None, "s", 3), (4, "é ü " * 9000, "fr", None, 36000), (5, "idiot! " * 60 + "password=hunter2secret", "en", "t", 1), (6, "x<|endoftext|>y</s>[INST]", "en", "t", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, i, "z") for i, r in enumerate(ODD)], DOCS + ", label int, t string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    assert plain(df.toPandas()) == plain(duck.execute(queries.SQL[name]).df())


def test_bpe_is_the_librarys(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.public_vocabulary())
    for df in (docs, odd):
        out = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.exact) for r in bpe.encode_documents(df, bpe.public_vocabulary()).collect()}
        want = set()
        for r in df.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), True))
        assert out == want


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\x85", "\xa0", "\u3000", " \n", "\x1c"])
def test_bpe_of_long_white_space(blank):
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(bpe.public_vocabulary()), bpe.ChunkCoder(bpe.public_vocabulary())
    for n in (bpe.LONG_RUN - 1, bpe.LONG_RUN, 1_000_000 // len(blank)):
        for text in (blank * n, f"a b c d {blank * n}e", f"{blank * n}'s it", f"x{blank * n}{bpe.SPECIAL}{blank * n}"):
            assert c.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_bpe_of_20_million_blanks(spark):
    df = spark.createDataFrame([(1, 20_000_000), (2, 2_000_000)], "doc_id bigint, n int").select("doc_id", F.expr("repeat(' ', n)").alias("text"))
    out = {r.doc_id: (r.n_tokens, r.exact) for r in bpe.encode_documents(df, bpe.public_vocabulary(), ids=False).collect()}
    assert out == {1: (20_000_000, True), 2: (2_000_000, True)}


def test_bpe_joins(spark):
    from tokenizers import Tokenizer

    t, c, r = Tokenizer.from_file(bpe.public_vocabulary()), bpe.ChunkCoder(bpe.public_vocabulary(), average=16), random.Random(3)
    for _ in range(1500):
        text = "".join(r.choice([r.choice("ab c  \n'sré1²٣中🙂.-_"), " the of and ", " don't", bpe.SPECIAL, "   x", "привет мир ", "中文，你好。", "・。", " 0123 4567"]) for _ in range(r.randrange(200)))
        assert list(c.encode(text)) == t.encode(text, add_special_tokens=False).ids
        c.shared = {}
    assert c.reused > 0 and c.grown == 0
    df = spark.createDataFrame([(t.encode("héllo wörld").ids,), (None,)], "ids array<int>")
    assert [x.text for x in bpe.decode_ids(df, bpe.public_vocabulary()).collect()] == ["héllo wörld", None]


def test_bpe_shares_chunks(spark, odd):
    r = random.Random(2)
    passage = " ".join(f"word{r.randrange(900)}" for _ in range(2500))
    df = spark.createDataFrame([(i, f"{i} own start " + passage + f" end {i}") for i in range(12)] + [(None, passage), (99, "0123 4567 привет мир " * 800), (98, "中文，你好。" * 2000)], "doc_id bigint, text string")
    path = bpe.public_vocabulary()
    shared = bpe.shared_chunks(df, path)
    out = bpe.encode_documents(df, path, shared=shared).collect()
    assert sum(x.n_shared for x in out) > 0.8 * sum(x.n_chunks for x in out if x.doc_id not in (98, 99)) and all(x.exact for x in out)
    plain_ids = {str(x.doc_id): x.ids_sha256 for x in bpe.encode_documents(df, path).collect()}
    assert {str(x.doc_id): x.ids_sha256 for x in out} == plain_ids
    assert bpe.shared_chunks(odd.limit(0), path) == [] and bpe.shared_chunks(df, path, chars=1) == []
    assert all(len(bpe.cuts(t)) >= 2 and max(np.diff([0, *bpe.cuts(t)])) <= 8 * bpe.AVERAGE for t in (passage, "a" * 30000))
    with pytest.raises(ValueError):
        bpe.encode_documents(df.withColumn("ids", F.lit(1)), path, keep=("ids",))


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) + [""]


def test_language_model(spark, rows):
    out = {r.doc_id: r for r in pitmanyor.op2_lm(spark, DATA).collect()}
    counts = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(out) == len(rows)
    for i, t in rows:
        r = out[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(tokens(t)), n)
        assert r.n_known == sum(w in counts for w in tokens(t))
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    table = pitmanyor.perplexity(spark.createDataFrame(list(out.values()))).collect()
    assert {r.held_out: round(r.perplexity, 6) for r in table} == {h: round(10 ** (-sum(r.score for r in out.values() if r.held_out == h) / sum(r.n_tokens for r in out.values() if r.held_out == h)), 6) for h in (True, False)}


def stirling_by_recursion(c, d):
    row = [1.0]
    for k in range(1, c):
        row = [(row[t - 1] if t else 0.0) + ((k - d * (t + 1)) * row[t] if t < len(row) else 0.0) for t in range(k + 1)]
    return row


def posterior(texts, d, d0, strength):
    """Predictive probabilities of the model by summing over all seatings of its contexts: {(u, w): p}, and for words that never follow u."""
    pairs = collections.Counter()
    for t in texts:
        w = tokens(t)
        pairs.update(zip([""] + w[:-1], w, strict=True))
    keys, words = list(pairs), sorted({w for _, w in pairs})
    contexts = sorted({u for u, _ in keys} | set(words))
    law = {k: stirling_by_recursion(pairs[k], d) for k in keys}
    total, sums = 0.0, collections.Counter()
    import itertools

    for seats in itertools.product(*(range(1, pairs[k] + 1) for k in keys)):
        t_u, c_w = collections.Counter(), collections.Counter()
        weight = 1.0
        for k, t in zip(keys, seats, strict=True):
            weight *= law[k][t - 1]
            t_u[k[0]] += t
            c_w[k[1]] += t
        for u in t_u:
            for j in range(t_u[u]):
                weight *= strength + d * j
        n = sum(c_w.values())
        for j in range(n):
            weight /= strength + j
        for w in words:
            for j in range(1, c_w[w]):
                weight *= j - d0
        total += weight
        for u in contexts:
            c_u, room = sum(pairs[x, w] for x, w in keys if x == u), strength + d * t_u[u]
            for w in words:
                t = dict(zip(keys, seats, strict=True)).get((u, w), 0)
                sums[u, w] += weight * (max(pairs[u, w] - d * t, 0) + room * (c_w[w] - d0) / (strength + n)) / (strength + c_u)
    return {k: x / total for k, x in sums.items()}


@pytest.mark.parametrize("tail", [False, True])
def test_language_model_scores_are_the_posteriors(tail):
    """Means over many samples of the sampler's own steps, in one bucket, against the sum over all seatings; once with head words, once with words outside the head."""
    texts, strength = ["a b a b a b", "a b a c", "c a b"], pitmanyor.STRENGTH
    words = sorted({w for t in texts for w in tokens(t)})
    code = {w: k if not tail or w == "" else pitmanyor.TAIL + k for k, w in enumerate(words)}
    context = {w: k for k, w in enumerate(words)}
    pairs = collections.Counter((code[x], context[u]) for t in texts for u, x in zip([""] + tokens(t)[:-1], tokens(t), strict=True))
    w, u, n = np.array([(*k, c) for k, c in sorted(pairs.items())], np.int64).T
    row = pitmanyor.bucket_row(0, [pitmanyor.pack(w, u, n)])
    model = pitmanyor.Model(int(n.sum()), len(words))
    model.d, model.d0 = 0.6, 0.4
    code_, alone_, several_, customers_ = pitmanyor.unpack(row[4])
    alone, several = np.zeros((2, pitmanyor.CONTEXTS + pitmanyor.HEAD), np.int64)
    alone[code_], several[code_] = alone_, several_
    model.customers = np.zeros(pitmanyor.CONTEXTS)
    model.customers[code_[code_ < pitmanyor.CONTEXTS]] = customers_[code_ < pitmanyor.CONTEXTS]
    rest, rest_customers = row[9], row[10]
    state, now, ahead, sweeps = (0, row[2], row[3]), several, 0.0, 1200
    for sweep in range(sweeps):
        tables, head = (alone + now)[: pitmanyor.CONTEXTS], (alone + now)[pitmanyor.CONTEXTS :]
        now = np.zeros_like(alone)
        state, ahead = pitmanyor.reseated(state, sweep, model.d, model.d0, *pitmanyor.drawn(model, sweep, tables, head, ahead, rest, rest_customers), sweep - 20, now)
        if sweep >= 20:
            model.keep((alone + now)[: pitmanyor.CONTEXTS], (alone + now)[pitmanyor.CONTEXTS :][: len(words)])
    bucket = pitmanyor.Bucket(model, np.stack([r[: len(words)] for r in model.rooms], axis=1), row[1], state[1], state[2])
    want = posterior(texts, model.d, model.d0, strength)
    for (x, y), p in want.items():
        got = bucket.log10(np.array([code[y]]), np.array([context[x]]))[0][0]
        assert abs(10**got / p - 1) < 0.04, (x, y)


def test_language_model_hears_the_order_of_words(spark):
    df = spark.createDataFrame([(i, "a b c") for i in (0, 1, 3, 4)] + [(40, "b c a"), (41, "a b c")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in pitmanyor.model_documents(df)[0].collect()}
    assert got[41] > got[40] + 0.5


def test_language_model_sums_to_one(spark):
    """All words after a context, and the unknown one."""
    docs = spark.createDataFrame([(i, "a b c a b d e f a b") for i in range(4)], "doc_id bigint, text string")
    known = sorted({w for w in tokens("a b c a b d e f a b")} - {""})
    vocab = pitmanyor.materialize(pitmanyor.vocabulary(docs), "v")
    model, pairs, state, words, buckets = pitmanyor.train(docs, vocab)
    shared = pitmanyor.Bucket
    rooms = np.stack(model.rooms, axis=1)
    p, q = pairs.collect(), {r.bucket: r for r in state.where("bucket >= 0").collect()}
    codes = pitmanyor.Codes(*words.value)([w.encode() for w in [*known, "", "unseen"]])
    u = pitmanyor.context_of(codes[:1])
    total = 0.0
    for c in codes:
        b = int(pitmanyor.bucket_of(np.array([c]), u, buckets)[0])
        row = next((r for r in p if r.bucket == b), None)
        own = shared(model, rooms, row and row.pairs, row and q[b].state, row and q[b].words)
        total += 10 ** own.log10(np.array([c]), u)[0][0]
    assert math.isclose(total, 1, abs_tol=1e-9)


def test_language_model_odd_tables(spark, odd):
    scored, _ = pitmanyor.model_documents(odd)
    got = scored.collect()
    assert len(got) == len(ODD) and sorted(r.n_tokens for r in got)[:3] == [1, 1, 1]
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ODD)
    assert pitmanyor.model_documents(odd.limit(0))[0].count() == 0
    held = spark.createDataFrame([(i, "x y") for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id bigint, text string")
    assert {(r.score, r.n_known) for r in pitmanyor.model_documents(held)[0].collect()} == {(0.0, 0)}


def test_language_model_names_that_meet(spark, monkeypatch):
    """A word whose name is another's goes by its second name, so base counts stay exact."""
    vocab = spark.createDataFrame([(pitmanyor.TAIL + 7, pitmanyor.TAIL + 1, 3), (pitmanyor.TAIL + 7, pitmanyor.TAIL + 2, 5)], "name bigint, second bigint, c bigint")
    assert vocab.groupBy("name").count().where("count > 1").count() == 1
    words = [b"one", b"two"]
    doubled = np.sort(pitmanyor.names(words))
    codes = pitmanyor.Codes(np.zeros(0, np.int64), doubled)
    assert (codes(words) == pitmanyor.names(words, True)).all()


@pytest.mark.parametrize("c", [1, 2, 6, 16, 17, 40, 41, 400])
def test_seats_follow_the_law(c):
    """Mean number of tables at mixed weights, all in one call."""
    d, n = 0.5, 20_000
    law = np.array(pitmanyor.stirling(d)[c, 1 : c + 1])
    t = np.arange(1, c + 1)
    if c <= 40:
        assert np.allclose(np.exp(law), stirling_by_recursion(c, d), rtol=1e-9)
    z = np.tile([0.3, 3.0, 1000.0], n)
    got = pitmanyor.seat(np.full(3 * n, c), z, d, np.random.default_rng(c).random(3 * n))
    for k, weight in enumerate(z[:3]):
        w = np.exp(law + t * np.log(weight) - (law + t * np.log(weight)).max())
        mean = (w * t).sum() / w.sum()
        assert abs(got[k::3].mean() - mean) < 0.02 * max(1.0, math.sqrt(mean))


@pytest.mark.parametrize("d", [0.3, 0.5, 0.8])
def test_seats_of_many_customers(d):
    """Beyond the table: the series and the saddle point against the recursion."""
    table = pitmanyor.stirling(d, 2000)
    t = np.arange(1, 2001)
    got = pitmanyor.log_stirling(np.full(2000, 2000), t, d)
    assert np.abs(np.diff(got) - np.diff(table[2000, 1:])).max() < 0.01
    for z in (0.5, 30.0, 4000.0):
        w = table[2000, 1:] + t * np.log(z)
        w = np.exp(w - w.max())
        mean = pitmanyor.seat(np.full(400, 2000), np.full(400, z), d, (np.arange(400) + 0.5) / 400).mean()
        assert abs(mean - (w * t).sum() / w.sum()) < 0.05


def test_warc_files_repeat_exactly(spark, tmp_path):
    body = "<p>" + "x" * 1200
    pages = spark.createDataFrame([(1, "u", body, 0), (7, "u\r\nv", body, 0), (7, "u\r\nv", body, 0), (3, None, "tiny", 0), (4, "u", "tiny", 0), (5, "u", None, 0), (None, "u", body, 0)], "page_id bigint, url string, html string, digest int")
    names = []
    for k in (1, 5):
        root = str(tmp_path / str(k))
        m = warc.write_archive(pages.repartition(k), root, shard_bytes=2000, roll_bytes=300)
        names.append(sorted((r.file, r.sha256) for r in m.collect()))
        got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(m, root, payload=True).collect())
        assert got == [("1", 1203, "revisit", 7), ("3", 4, "response", None), ("4", 4, "response", None), ("5", 0, "response", None), ("7", 1203, "response", None), ("7", 1203, "response", None), ("None", 1203, "revisit", 7)]
        assert not [f for f in (tmp_path / str(k)).iterdir() if f.name.startswith(".tmp")]
    assert names[0] == names[1] and len(names[0]) > 2
    import gzip

    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "1").glob("*.warc.gz")))
    ids = re.findall(rb"WARC-Record-ID: (<urn:page[^>]*>)", data)
    assert len(ids) == len(set(ids)) == 7 and data.count(b"WARC-Type: warcinfo") == len(names[0])
    empty = warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert empty.count() == 0 and warc.read_archive(empty, str(tmp_path / "e")).count() == 0


def test_warc_failed_attempts_and_outliers(spark, tmp_path):
    rows = [(i, "u", "x" * 1200 + str(i)) for i in range(3000)] + [(2**60, "u", "y")] + [(None, "u", "z" * 1500 + str(i)) for i in range(500)]
    (tmp_path / ".tmp-part-00000000-00000.warc.gz-9").write_bytes(b"half")
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    m = warc.write_archive(pages, str(tmp_path), shard_bytes=200_000)
    shards = [r.n for r in m.groupBy("shard").agg(F.sum("records").alias("n")).collect()]
    assert sum(shards) == len(rows) and len(shards) > 20 and max(shards) < 400
    assert not list(tmp_path.glob(".tmp*"))
    assert warc.read_archive(m, str(tmp_path)).where("record_type = 'response'").count() == len(rows)


def test_warc_of_another_writer(spark, tmp_path):
    import base64
    import gzip

    body = b"<p>hello</p>"
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    block = b"HTTP/1.0 200 OK\r\n\r\n" + body
    record = lambda kind, block, more="": f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    parts = [record("warcinfo", b"x: y\r\n"), record("request", b"GET / HTTP/1.0\r\n\r\n"), record("response", block, f"WARC-Target-URI: http://a.b/\r\nWARC-Payload-Digest: sha1:{sha}\r\n"), record("revisit", b"")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    manifest = spark.createDataFrame([("a.warc.gz", 2)], "file string, records bigint")
    got = sorted((r.record_type, r.page_id, r.payload_bytes, r.payload_digest, r.url) for r in warc.read_archive(manifest, str(tmp_path)).collect())
    assert got == [("response", None, len(body), hashlib.sha1(body).hexdigest(), "http://a.b/"), ("revisit", None, None, None, None)]


def test_chat_layouts(spark):
    records = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"instruction":"q","output":"a"}', '{"instruction":"q","input":"","output":"a"}', '{"prompt":"q","response":"a"}', '{"completion":"a","prompt":"q"}', '{"question":"q","answer":"a"}', '{"system":"s","prompt":"q","response":"a"}', '{"other":1}', "no json", None]
    out = chat.canonical(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    assert [r.layout for r in out] == ["messages", "from_value", "instruction", "instruction_input", "prompt_response", "prompt_completion", "question", "system_prompt", None, None, None]
    assert all([tuple(t) for t in r.turns][-2:] == [("user", "q"), ("assistant", "a")] for r in out[:8])
    assert out[8].turns is None and len({r.fingerprint for r in out[:8]}) == 8


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "[~INST]<~~/s><s>", "<s>[INST] a [/INST]b</s>\n", "", None, "<", "[/INST", "</s>\n" * 3]
    df = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant [/INST]", t, 0) for i, t in enumerate(texts)] + [(None, None, None, "x", 0)] * 2, "conv_id bigint, turn bigint, role string, text string, turns int")
    rows = df.drop("turns").withColumn("turns", F.array(F.struct("role", "text")))
    out = {r.conv_id: r.t for r in chat.format_conversations(rows).select("conv_id", chat.parse_formatted(F.col("formatted")).alias("t")).collect()}
    assert [(x.role, x.text) for x in out[1]] == [("user" if i % 2 else "assistant [/INST]", t or "") for i, t in enumerate(texts)]
    assert [tuple(x) for x in out[None]] == [("", "x")] * 2
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_chat_mask(spark):
    rows = [(1, 0, "user", "q</s>"), (1, 1, "assistant", "[INST] a"), (1, 2, "human", "h"), (1, 3, "assistant", ""), (1, 4, "assistant", "ünd </s>\n"), (2, 0, "user", "x"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_conversations(chat.canonical(chat.as_records(df, piece=5), shape="shape"))
    out = out.withColumn("loss", chat.under_mask(chat.turn_strings(F.col("formatted")), F.col("mask")))
    got = {r.conv_id: r for r in out.collect()}
    assert {i: r.loss for i, r in got.items()} == {1: "[INST] aünd </s>\n", 2: "", 3: ""}
    for r in got.values():
        assert sum(x.chars for x in r["mask"]) == len(r.formatted) and r.n_rejected == 0
        at, kept = 0, ""
        for x in r["mask"]:
            kept, at = kept + r.formatted[at : at + x.chars] * x.loss, at + x.chars
        assert re.sub(r"\[~(~*/?INST)\]", r"[\1]", re.sub("<~(~*/?s)>", r"<\1>", kept)) == r.loss


def test_chat_layouts_of_a_table(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text")
    seen = {r.layout for r in chat.canonical(chat.as_records(rows, piece=1500), shape="shape").select("layout").distinct().collect()}
    assert seen == {"turn", "messages", "from_value", "turn_pieces"}


def test_chat_very_long_text(spark):
    text = F.concat(F.repeat(F.lit("ab</s>"), 3_500_000), F.lit("end"))
    df = spark.range(1).select(F.lit(7).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("assistant").alias("role"), text.alias("text"))
    out = chat.format_conversations(chat.canonical(chat.as_records(df), shape="shape"))
    r = out.withColumn("l", chat.under_mask(chat.turn_strings(F.col("formatted")), F.col("mask"))).select(F.length("l").alias("n"), F.sha2("l", 256).alias("h")).first()
    assert r.n == 21_000_003 and r.h == hashlib.sha256(b"ab</s>" * 3_500_000 + b"end").hexdigest()


def test_chat_rejects(spark):
    df = spark.createDataFrame([(1, 0, '{"role":"user","text":"q"}'), (1, 1, '{"unknown":{"x":1}}')], "conv_id bigint, turn bigint, record string")
    out = chat.canonical(df)
    assert [r.record for r in chat.rejects(out).collect()] == ['{"unknown":{"x":1}}']
    assert chat.format_conversations(out).first().n_rejected == 1


def test_fingerprints(spark, rows):
    out = {r.doc_id: r for r in multiset.op5_fingerprints(spark, DATA).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        after, cut = order[(k + 1) % len(order)][1], len(t) // 3
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
    same = collections.defaultdict(set)
    for i, t in rows:
        same[t].add(out[i].fingerprint)
    assert all(len(f) == 1 for f in same.values()) and len({f for s in same.values() for f in s}) > 0.9 * len(same)
    # Likeness against the true overlap of the multisets of clauses.
    clauses = lambda t: collections.Counter(x for x in re.split(r"(?<=[.!?,;:])[\x20\t\r\x0b\f]+|\n", t) if x)
    errors = []
    for k, (i, t) in enumerate(order):
        after, cut = order[(k + 1) % len(order)][1], len(t) // 3
        for other, near in ((t[: len(t) - cut] + after[:cut], out[i].near_edited), (after, out[i].near_next)):
            a, b = clauses(t), clauses(other)
            norm = sum(x * x for x in a.values()) + sum(x * x for x in b.values())
            errors.append(abs(near - (1.0 if t == other else 2 * sum(a[c] * b[c] for c in a) / norm if norm else 0.0)))
    assert np.mean(errors) < 0.08 and np.quantile(errors, 0.95) < 0.25


def test_fingerprint_is_a_homomorphism(spark, odd):
    df = spark.createDataFrame([("one. two.\nthree\nfour", "four\none. two.\nthree", "three\nfour", "one. two.", "one. two.\n", "")], "a string, b string, c string, d string, e string, f string")
    for c in "abcdef":
        df = multiset.with_fingerprint(df, F.col(c), f"f{c}")
    r = df.select("fa", "fb", "fd", "fe", "ff", multiset.combined(F.col("fd"), F.col("fc")).alias("sum"), multiset.combined(F.col("fa"), F.col("fc"), -1).alias("back")).first()
    assert r.fa == r.fb == r["sum"] and r.back == r.fd != r.fe and set(r.ff) == {0}
    assert multiset.with_next(multiset.fingerprint_documents(odd), ["t", "fp"]).count() == len(ODD)
    assert multiset.with_next(multiset.fingerprint_documents(odd.limit(0)), ["t", "fp"]).count() == 0
    one = multiset.with_next(multiset.fingerprint_documents(odd.where("doc_id = 4")), ["t"]).first()
    assert one.next_t == one.t


def test_next_documents_of_outliers(spark, monkeypatch):
    """Far-off, repeated and null ids in many ranges: the cycle is the sorted order's."""
    monkeypatch.setattr(multiset, "ROWS", 20)
    r = random.Random(4)
    rows = [(i, f"t{i}") for i in range(300)] + [(2**60, "far"), (-(2**60), "low")] + [(7, f"x{k}") for k in range(150)] + [(None, f"n{k}") for k in range(150)]
    r.shuffle(rows)
    out = multiset.with_next(spark.createDataFrame(rows, "doc_id bigint, t string"), ["t"]).collect()
    after = {x.t: x.next_t for x in out}
    assert len(out) == len(after) == len(rows)
    at, seen = "far", []
    for _ in rows:
        seen.append(at)
        at = after[at]
    ids = dict((t, i) for i, t in rows)
    assert at == "far" and len(set(seen)) == len(rows)
    assert [ids[t] for t in seen] == sorted((i for i, _ in rows if i is not None), reverse=True) + [None] * 150


def test_ranges(spark):
    from lectern.llm import _shared

    r = random.Random(1)
    rows = [(r.choice([None, 5, *range(2000)]) if k % 3 else 5, r.randrange(10**6)) for k in range(4000)] + [(2**62, 1), (-(2**62), 1)]
    df, n = _shared.ranges(spark.createDataFrame(rows, "a bigint, b bigint"), ["a", "b"], F.lit(1), 100)
    out = sorted(df.collect(), key=lambda x: (x.a is None, x.a or 0, x.b))
    assert len(out) == len(rows) and all(x.range <= y.range for x, y in zip(out, out[1:], strict=False))
    assert max(collections.Counter(x.range for x in out).values()) <= 100 and n == out[-1].range + 1


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, docs, odd):
    for df in (docs, odd, odd.limit(0)):
        got = sorted((str(r.doc_id), r.base_sha256) for r in secrets.scan_documents(df).collect())
        assert got == sorted((str(r.doc_id), hashlib.sha256(base_spans(r.text or "").encode()).hexdigest()) for r in df.collect())
    s = secrets.NoveltyScanner(dictionary=secrets.learn_identifiers(docs))
    assert [k for _, k, _ in s.spans("bearer qZ8vK2mX9pL4tR7wB3nY6cF1")] == [3]
    assert s.spans("the authorization of abcdefabcdefabcdefghijklmnop words") == []
    assert s.spans("token:abc é PASSWORD = 'x1y2z3'") == [(12, 0, 30)]
    row = secrets.redact_documents(odd.select("doc_id", "text", "lang", "source", "n_chars")).where("doc_id = 5").first()
    assert "hunter2" not in row.text and row.text.endswith("<secret:assign>") and row.n_chars == len(row.text)


def test_planted_secrets(spark, rows):
    """Recall of random strings of several alphabets, and precision on names and words, in the same places."""
    import string

    r = random.Random(5)
    prose = [t for _, t in rows if 400 < len(t) < 4000]
    scanner = secrets.NoveltyScanner()
    places = ["Authorization: Bearer {}", "my login is {} ok", "{} is the session", "the private key\n{}\n", "credentials {}", "auth: {}"]

    def found(what):
        t = r.choice(prose)
        at = max(t.find(" ", r.randrange(len(t))), 0)
        t = t[:at] + " " + r.choice(places).format(what) + " " + t[at:]
        start = t.index(what)
        return any(k == 3 and a <= start and b >= start + len(what) for a, k, b in scanner.spans(t))

    alphabets = [string.ascii_letters + string.digits + "+/", string.ascii_letters + "!#$%&*@?^", string.ascii_lowercase + string.digits]
    hits = [found("".join(r.choice(a) for _ in range(n))) for a in alphabets for n in (14, 20, 32) for _ in range(40)]
    words = ["configuration_settings_default", "internationalization", "/usr/local/lib/python/site-packages", "https://example.org/docs/index.html", "aaaaaaaaaaaaaaaaaaaa", "authenticationmiddleware"]
    wrong = [found(w) for w in words for _ in range(40)]
    assert sum(hits) >= 0.95 * len(hits) and sum(wrong) <= 0.1 * len(wrong)
    novel = sum(x.n_novel for x in secrets.op6_secrets(spark, "/root/testdata/sf0.01").collect())
    assert novel <= 10  # of a thousand documents, in which nothing novel is planted


def test_toxicity_on_held_out_rows(spark, odd):
    d = "/root/testdata/sf0.1"
    p = toxicity.op7_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted == r.toxic for r in p) / len(p)
    caught = [r.predicted for r in p if r.toxic == 1]
    assert hit > 0.97 and sum(caught) > 0.9 * len(caught)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for df in (odd, odd.limit(0)):
        out = toxicity.score_documents(df, toxicity.learn(df, none)).collect()
        assert len(out) == df.count() and all(0 <= r.toxicity <= 1 for r in out)


def best_of_all(words, factors):
    """The best weight over all ways to mark insults and threats, by the rules and without the machine."""
    import itertools

    symbols, best = [s for s, _ in words], None
    hot = [k for k, s in enumerate(symbols) if s in ("insult", "threat")]
    for marks in itertools.product((False, True), repeat=len(hot)):
        total, holds = 0.0, True
        for k, plus in zip(hot, marks, strict=True):
            before, ahead = "target" in symbols[max(0, k - toxicity.NEAR) : k], "target" in symbols[k + 1 : k + 1 + toxicity.NEAR]
            holds &= plus if before else ahead or not plus
            event = symbols[k] + "~" * ("negation" in symbols[max(0, k - toxicity.SCOPE) : k]) + '"' * ("report" in symbols[:k]) + "+" * plus
            total += factors[event] * words[k][1] if event in factors else 0.0
        if holds and (best is None or total > best):
            best = total
    return best


def test_toxicity_machine_is_the_grammar():
    r, g = random.Random(1), toxicity.Grammar({})
    g.factors = {e: r.uniform(-0.5, 2) for e in toxicity.EVENTS}
    for _ in range(1500):
        words = [(s, {"insult": r.uniform(1, 3), "threat": 2.0}.get(s, 0.0)) for s in r.choices(toxicity.SYMBOLS, weights=[2, 2, 1, 1, 1, 6], k=r.randrange(14))]
        total, events = g.clause(words)
        assert math.isclose(total, best_of_all(words, g.factors), abs_tol=1e-9)
        assert math.isclose(total, sum(g.factors[e] * w for e, w in events), abs_tol=1e-9)


def test_toxicity_grammar():
    g = toxicity.Grammar({})
    weigh = lambda s, g=g: g.clause([g.classed(w) for w in toxicity.WORD.findall(s)])[0]
    assert weigh("you are an idiot") > weigh("an idiot") > weigh("he said an idiot lives") > 0 == weigh("a table")
    assert weigh("an idiot") > weigh("not an idiot") and weigh("i will kill you") > 0 == weigh("kill the process")


@pytest.mark.parametrize(("part", "text"), [("negation", "that is not an idiot"), ("report", "they wrote that some idiot came"), ("target", "you are an idiot"), ("insult", "an idiot"), ("threat", "i will kill you")])
def test_toxicity_without_a_transducer(part, text):
    whole, less = toxicity.Grammar({}), toxicity.Grammar({}, without=part)
    assert abs(whole.score(text) - less.score(text)) > 0.01


def test_toxicity_target_tells_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    g = toxicity.learn(docs, labels.union(labels))  # labels may repeat
    held = docs.join(labels.where(toxicity.held_out()), "doc_id", "left_semi").select("doc_id", "text")
    whole, less = ({r.doc_id: r.toxicity for r in toxicity.score_documents(held, g, without=w).collect()} for w in ("", "target"))
    assert sum(abs(whole[i] - less[i]) for i in whole) / len(whole) > 1e-4


def test_quality_ledger(spark, odd):
    assert quality.ledger(odd).count() == len(ODD) and quality.ledger(odd.limit(0)).count() == 0
    texts = ["a b c a b c", "a a a a", "a b c d", "", "x y z\n\nx y z\n", "| a # b"]
    got = [r.n_repeat_words for r in quality.measured(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    assert got == [6, 4, 0, 0, 6, 0]
    rows = spark.createDataFrame([(0,), (1,), (3,), (2,), (2,)], "failed int")
    assert {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablations(rows, "base").collect()} == {"few_words": (2, 1, 2), "repeated_windows": (3, 2, 3)}


def test_quality_of_hashes_that_meet(spark, docs, monkeypatch):
    same = lambda df: {r.doc_id: r.n_repeat_words for r in df.select("doc_id", "n_repeat_words").collect()}
    want = same(quality.measured(docs))
    assert same(quality.measured(docs, hashed=lambda a, b, c: F.length(a).cast("bigint") * 2**50)) == want
    text = spark.createDataFrame([("a b c x a b d y a b c",)], "text string")
    assert quality.measured(text, hashed=lambda a, b, c: F.lit(5).cast("bigint")).first().n_repeat_words == 6
    monkeypatch.setattr(quality, "PLACE_BITS", 4)
    assert same(quality.measured(docs)) == want


CELL = "source string, language string, topic string, tokens bigint"


def test_mixing_is_iterative_proportional_fitting(spark, odd, monkeypatch):
    r = random.Random(1)
    cells = [(s, l, t, r.randrange(1, 500)) for s in "abc" for l in "xy" for t in "pq"]
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "language": {"x": 0.7, "y": 0.3}, "topic": {"p": 0.5}}
    w, gap = mixing.rake_here(cells, targets)
    total = sum(c[3] for c in cells)
    assert gap < mixing.TOLERANCE
    for k, want in enumerate(({"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.7, "y": 0.3}, {"p": 1 - sum(c[3] for c in cells if c[2] == "q") / total})):
        for v, share in want.items():
            assert math.isclose(sum(x for c, x in zip(cells, w, strict=True) if c[k] == v), share * total, rel_tol=1e-8)
    # Raked weights are tokens times a factor of each margin: odds ratios stay.
    at = {c[:3]: (c[3], x) for c, x in zip(cells, w, strict=True)}
    odds = lambda j: at["a", "x", "p"][j] * at["b", "y", "p"][j] / at["a", "y", "p"][j] / at["b", "x", "p"][j]
    assert math.isclose(odds(0), odds(1), rel_tol=1e-9)
    scale = mixing.scale_here(cells, w, 0.6)
    assert math.isclose(sum(c[3] * min(1, scale * x / c[3]) for c, x in zip(cells, w, strict=True)), 0.6 * total, rel_tol=1e-9)
    # The same by joins, where cells are too many for the driver.
    monkeypatch.setattr(mixing, "MOST_SWEEPS", 3)
    df = spark.createDataFrame(cells + [(None, "x", "p", 0)], CELL)
    spread, gap = mixing.calibrated(df, targets, most=0)
    here, want = mixing.calibrated(df, targets)
    key = lambda rows: {(x.source, x.language, x.topic): (round(x.w, 6), round(x.probability, 9)) for x in rows.collect()}
    assert key(spread) == key(here) and math.isclose(gap, want, rel_tol=1e-6)
    # Targets that contradict the empty cells: the gap says so.
    assert mixing.rake_here([("a", "x", "p", 5), ("b", "y", "p", 5)], {"source": {"a": 0.9, "b": 0.1}, "language": {"x": 0.1, "y": 0.9}})[1] > 0.1
    assert mixing.mix_documents(odd).count() == len(ODD) and mixing.mix_documents(odd.limit(0)).count() == 0
    clashing = odd.withColumns({c: F.lit("own") for c in ("topic", "tokens", "sampled", "probability", "cell")})
    assert set(mixing.sample_documents(clashing).columns) == set(clashing.columns)


def test_mixing_draws_rows(spark):
    df = spark.createDataFrame([(None, "word " * 20, "en", "s", 1)] * 2000 + [(7, f"text {k} of one id " * 5, "en", "t", 1) for k in range(2000)], DOCS)
    out = mixing.mix_documents(df).groupBy("source").agg(F.avg(F.col("sampled").cast("int")).alias("got"), F.avg("probability").alias("p")).collect()
    assert all(abs(r.got - r.p) < 0.06 for r in out)


def test_mixing_expected_share(spark):
    out = mixing.op9_mixing(spark, "/root/testdata/sf0.01").collect()
    total = sum(r.n_tokens for r in out)
    assert math.isclose(sum(r.n_tokens * r.probability for r in out), mixing.SHARE * total, rel_tol=1e-6)
    assert abs(sum(r.n_tokens for r in out if r.sampled) - mixing.SHARE * total) < 0.06 * total


def weighted(text):
    w = text.lower().split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def test_near_duplicates_against_all_pairs(spark):
    r, words = random.Random(5), [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(words, k=120)) for _ in range(30)]
    texts = base + [t.replace(t.split()[60], "changed") for t in base[:15]] + base[:5] + ["", "", "two words", "two words", None]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, h int")
    got = {x.doc_id: x for x in dartminhash.classes(df).collect()}
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(len(texts)):
        for b in range(a):
            x, y = weighted(texts[a] or ""), weighted(texts[b] or "")
            if (texts[a] or "") == (texts[b] or "") or (x and y and sum((x & y).values()) >= 0.8 * sum((x | y).values())):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: x.class_id for i, x in got.items()} == {i: find(i) for i in range(len(texts))}
    assert got[len(texts) - 1].n_copies == 3


def classes_by_all_pairs(texts):
    """The least place of each text's class."""
    sets, parent = [weighted(t) for t in texts], list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(len(texts)):
        for b in range(a):
            shared = sum((sets[a] & sets[b]).values())
            if shared >= 0.8 * (sets[a].total() + sets[b].total() - shared):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in range(len(texts))}


def edited(words, n, r):
    out = list(words)
    for k in r.sample(range(len(words) // 10), n):
        out[10 * k + 5] = f"e{r.random()}"
    return " ".join(out)


def test_near_duplicates_of_a_middle_id(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(404)]
    copies = [edited(words, 8, r) for _ in range(100)]
    texts = copies[:50] + [" ".join(words)] + copies[50:]
    want = classes_by_all_pairs(texts)
    assert set(want.values()) == {0}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {x.doc_id: x.class_id for x in dartminhash.classes(df).collect()} == want


def test_near_duplicates_recall_on_a_table(spark):
    """All pairs that share a shingle, by bands of similarity: from the threshold on all are of one class, and below none is linked without a chain."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts, got = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r.class_id for r in dartminhash.classes(docs).collect()}
    sets, by = {i: weighted(t) for i, t in texts.items()}, collections.defaultdict(list)
    for i, x in sets.items():
        for shingle in x:
            by[shingle].append(i)
    pairs = {(b, a) if b < a else (a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[:k]}
    met, caught, near = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for a, b in pairs:
        shared = sum((sets[a] & sets[b]).values())
        j = shared / (sets[a].total() + sets[b].total() - shared)
        band = "equal" if j == 1 else "0.9" if j >= 0.9 else "0.8" if j >= 0.8 else "less"
        met[band] += 1
        caught[band] += got[a] == got[b]
        if j >= 0.8:
            near[a].add(b), near[b].add(a)
    assert met["equal"] > 50 and caught["equal"] == met["equal"]
    assert met["0.9"] + met["0.8"] >= 10 and caught["0.9"] + caught["0.8"] >= 0.9 * (met["0.9"] + met["0.8"])
    assert all(near[i] or texts[i] in {t for k, t in texts.items() if k != i} for i, c in got.items() if c != i)


def test_near_duplicates_of_shared_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    df = spark.createDataFrame([(5, a), (5, b), (7, b + " more"), (9, a + " more")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in dartminhash.classes(df).collect())
    assert got == [(5, 5, 1, 1), (5, 5, 1, 1), (7, 5, 1, 1), (9, 5, 1, 1)]
    assert sorted((r.doc_id, r.text) for r in dartminhash.drop_near_duplicates(df).collect()) == [(5, a), (5, b)]


def test_signatures_estimate_weighted_similarity():
    a, b = [f"{i} {i + 1} {i + 2} {i + 3} {i + 4} " * (1 + i % 3) for i in range(300)], [f"{i} {i + 1} {i + 2} {i + 3} {i + 4} " * (1 + i % 3) for i in range(90, 390)]
    x, y = "".join(a), "".join(b)
    s = dartminhash.signatures(*dartminhash.shingles([x.encode(), y.encode()], dartminhash.WordHashes()), 2, 1024)
    true = sum((weighted(x) & weighted(y)).values()) / sum((weighted(x) | weighted(y)).values())
    assert abs((s[0] == s[1]).mean() - true) < 0.06


def test_near_duplicates_odd_tables(spark, odd):
    out = dartminhash.classes(odd).collect()
    assert len(out) == len(ODD) and dartminhash.classes(odd.limit(0)).count() == 0
    kept = dartminhash.drop_near_duplicates(odd.select("doc_id", "text", "lang", "source", "n_chars")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 3, 4, 5, 6]


def test_near_duplicates_without_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, a, "x"), (None, a + " more", "x"), (9, b, "x"), (None, b + " more", "x"), (None, a, "x"), (None, "alone", "x"), (None, "alone", "x"), (9, b, "y"), (9, b, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, h string")
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.n_copies) for r in dartminhash.classes(df).collect()))
    assert got == sorted([(5, 5, 2), (0, 5, 1), (9, 9, 3), (0, 9, 1), (0, 5, 2), (0, 0, 2), (0, 0, 2), (9, 9, 3), (9, 9, 3)])
    kept = dartminhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "alone"), (5, a), (9, b)]


def test_pipeline(spark, odd):
    """Each stage's rows against a result of its own kind by brute force, on its own input."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(p.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "secret_scan", "mixing", "bpe"]
    at = {"": docs}
    for before, (name, stage) in zip(["", *stages], p.STAGES, strict=False):
        out = stage(spark, at[before], DATA)
        at[name] = spark.createDataFrame(out.collect(), out.schema)
        if name != "bpe":
            assert at[name].columns == docs.columns
    rows = {n: {r.doc_id: r for r in df.collect()} for n, df in at.items()}
    g = toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert set(rows["toxicity"]) == {i for i, r in rows[""].items() if g.score(r.text or "") < 0.5}
    ids = sorted(rows["toxicity"])
    places = classes_by_all_pairs([rows["toxicity"][i].text or "" for i in ids])
    assert set(rows["near_dedup"]) == {ids[k] for k in set(places.values())}
    scanner = secrets.NoveltyScanner(dictionary=secrets.learn_identifiers(at["near_dedup"]))
    for i, r in rows["near_dedup"].items():
        text = r.text and secrets.redacted(r.text, scanner.spans(r.text))
        assert (rows["secret_scan"][i].text, rows["secret_scan"][i].n_chars) == (text, len(text or ""))
    drawn = mixing.mix_documents(at["secret_scan"], mixing.TARGETS).collect()
    assert set(rows["mixing"]) == {x.row.doc_id for x in drawn if x.draw < x.probability}
    total = sum(x.tokens for x in drawn)
    assert math.isclose(sum(x.tokens * x.probability for x in drawn), mixing.SHARE * total, rel_tol=1e-6)
    t = Tokenizer.from_file(bpe.public_vocabulary())
    assert {i: r.ids for i, r in rows["bpe"].items()} == {i: t.encode(r.text or "", add_special_tokens=False).ids for i, r in rows["mixing"].items()}


def test_pipeline_of_odd_tables(spark, odd, tmp_path):
    import corpus_pipeline as p

    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 0, 1), (77, 0, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for k, df in enumerate((odd.select("doc_id", "text", "lang", "source", "n_chars"), odd.limit(0).select("doc_id", "text", "lang", "source", "n_chars"))):
        root = str(tmp_path / str(k))
        df.write.parquet(f"{root}/documents.parquet")
        labels.write.parquet(f"{root}/labels.parquet")
        assert p.run(spark, root).count() <= df.count()


def test_secrets_in_linear_time():
    import time

    scanner = secrets.NoveltyScanner()
    for text in ("token " * 1_700_000, "1" * 3_000_000 + " token", 'token"' * 500_000, "token_" * 500_000, "9a" * 1_000_000 + "_key "):
        began = time.perf_counter()
        scanner.spans(text)
        assert time.perf_counter() - began < 60


def test_dates_are_no_secrets():
    scanner = secrets.NoveltyScanner()
    for date in ("2024-05-06T10:11:12Z", "2024-05-06T10:11:12.345+02:00", "2024/05/06-10:11", "2024-05-06_10.11.12"):
        assert scanner.spans(f"the login token expires {date} at noon") == []
    assert [s[1] for s in scanner.spans("the login token x9f8Kq2LmZ0pQw7vB3 at noon")] == [3]


def test_runs_near_sensitive_words():
    r, scanner = random.Random(8), secrets.NoveltyScanner()
    for _ in range(500):
        text = "".join(r.choice(["token", "api_key", "a_token_key", "x9f8Kq2LmZ0pQw7", "\n", " ", "=", '"', "-", "pass", "longer text here", "aVeryLongIdentifierName" * 4]) + r.choice(["", " "]) for _ in range(r.randrange(50)))
        near = [(a - secrets.REACH, b + secrets.REACH) for a, b in secrets.sensitive(text)]
        want = [m.span() for m in secrets.CANDIDATE.finditer(text) if any(m.start() < hi and m.end() > lo for lo, hi in near)]
        assert list(scanner.candidates(text)) == want


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_equal_rows_are_drawn_apart(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "REPEATS", most)
    rows = [(7, "the same text again", "en", "a", 19)] * 500 + [(i, f"text number {i} of many words here", "en" if i % 2 else "de", "b", 30) for i in range(100, 400)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    out = mixing.mix_documents(df, {"language": {"en": 0.5, "de": 0.5}}).select(F.col("row.doc_id").alias("i"), "probability", "sampled").collect()
    same = [r for r in out if r.i == 7]
    p = same[0].probability
    assert len(same) == 500 and 0.05 < p < 0.95 and abs(sum(r.sampled for r in same) - 500 * p) < 5 * math.sqrt(500 * p * (1 - p))
    single = [r for r in out if r.i != 7]
    again = {r.i: r.sampled for r in mixing.mix_documents(df.repartition(7), {"language": {"en": 0.5, "de": 0.5}}).select(F.col("row.doc_id").alias("i"), "sampled").collect() if r.i != 7}
    assert {r.i: r.sampled for r in single} == again


def test_components_join_a_link_in_few_rounds(spark, monkeypatch):
    """Long paths, a star and a clique: each round is left with fewer links (all were joined in each of many rounds)."""
    r = np.random.default_rng(3)
    name = r.permutation(1000).tolist()
    edges = {(name[i], name[i + 1]) for i in range(399)} | {(name[400], name[i]) for i in range(401, 600)}
    edges |= {(name[i], name[j]) for i in range(600, 620) for j in range(600, i)} | {(name[i], name[i + 1]) for i in range(700, 900, 2)}
    edges = sorted((min(e), max(e)) for e in edges)
    parts = [range(400), range(400, 600), range(600, 620), *(range(i, i + 2) for i in range(700, 900, 2))]
    want = {name[i]: min(name[j] for j in p) for p in parts for i in p}
    rows, write = [], dartminhash.materialize
    monkeypatch.setattr(dartminhash, "materialize", lambda df, tag: (out := write(df, tag), rows.append(out.count()) if tag == "edges" else None)[0])
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {x.id: x.label for x in dartminhash.components(df).collect()} == want
    assert rows[-1] == 0 and all(2 * y <= x for x, y in zip([len(edges), *rows], rows)), rows
    assert dartminhash.components(df.limit(0)).count() == 0


def test_packing_makes_one_codec(monkeypatch):
    import zstandard

    made, one = [], zstandard.ZstdCompressor
    pitmanyor.codec.cache_clear()
    monkeypatch.setattr(zstandard, "ZstdCompressor", lambda **k: made.append(k) or one(**k))
    columns = np.arange(0, 900, 3), np.arange(300) % 7, np.linspace(0, 1, 300)
    for _ in range(3):
        assert all(np.array_equal(x, y) for x, y in zip(columns, pitmanyor.unpack(pitmanyor.pack(*columns)), strict=True))
    assert len(made) == 1
