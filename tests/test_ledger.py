"""The versioned store against a dictionary, with writers at once, and the index that follows its files against a full rebuild."""

import json
import random
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from lectern.sources.ledger import Ledger
from lectern.streaming import reindex

SCHEMA = "name string, n bigint"


def rows(spark, pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(df):
    return sorted(((r["name"] or "", r.n) for r in df.collect()))


def test_commits_are_those_of_a_dictionary(spark, tmp_path):
    r, table, want = random.Random(3), Ledger(spark, str(tmp_path / "t"), SCHEMA, "name"), []
    for step in range(12):
        keys = [r.choice([*"abcdefg", None]) for _ in range(r.randrange(1, 4))]
        pairs = [(k, step * 10 + i) for i, k in enumerate(keys)]
        kind = r.choice(["append", "upsert", "delete", "absent", "compact"])
        if kind == "append":
            table.append(rows(spark, pairs))
            want += pairs
        elif kind == "upsert":
            table.upsert(rows(spark, pairs))
            want = [x for x in want if x[0] not in keys] + pairs
        elif kind == "delete":
            table.delete(rows(spark, pairs))
            want = [x for x in want if x[0] not in keys]
        elif kind == "absent":
            table.append_absent(rows(spark, pairs))
            want += [x for x in pairs if x[0] not in {w[0] for w in want}]
        else:
            table.compact()
        assert held(table.read()) == sorted((k or "", n) for k, n in want), (step, kind)
        ids = [x.row_id for x in table.read().collect()]
        assert len(ids) == len(set(ids))


def test_snapshots_stay(spark, tmp_path):
    table = Ledger(spark, str(tmp_path / "t"), SCHEMA, "name")
    assert table.read().count() == 0 and table.latest().number == 0
    table.append(rows(spark, [("a", 1), ("b", 2)]))
    first = table.read()
    table.upsert(rows(spark, [("a", 9)]))
    table.delete(rows(spark, [("b", 0)]))
    assert held(first) == [("a", 1), ("b", 2)] == held(table.read(1))
    assert held(table.read(2)) == [("a", 9), ("b", 2)] and held(table.read()) == [("a", 9)]
    assert table.versions() == [1, 2, 3]


def test_two_writers_at_once(spark, tmp_path):
    path, errors = str(tmp_path / "t"), []

    def write(w):
        try:
            table = Ledger(spark, path, SCHEMA, "name")
            for i in range(5):
                table.append(rows(spark, [(f"{w}-{i}", i)]))
                table.append_absent(rows(spark, [(f"shared-{i}", w)]))
        except Exception as e:  # noqa: BLE001  threads' errors are looked at below
            errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    out = held(Ledger(spark, path, SCHEMA, "name").read())
    assert [n for n, _ in out if n[0] != "s"] == [f"{w}-{i}" for w in range(3) for i in range(5)]
    assert sorted(n for n, _ in out if n[0] == "s") == [f"shared-{i}" for i in range(5)]
    assert Ledger(spark, path, SCHEMA, "name").versions() == list(range(1, 31))


def test_a_writer_of_another_process(spark, tmp_path):
    path = str(tmp_path / "t")
    code = f"""
import sys
sys.path.insert(0, {json.dumps(sys.path[0])})
from pyspark.sql import SparkSession
from lectern.sources.ledger import Ledger
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
table = Ledger(spark, {json.dumps(path)}, "{SCHEMA}", "name")
for i in range(6):
    table.append(spark.createDataFrame([("other", i)], "{SCHEMA}"))
"""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    other = subprocess.Popen([sys.executable, "-c", code], cwd=root, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, env=os.environ | {"PYTHONPATH": root})
    table = Ledger(spark, path, SCHEMA, "name")
    while other.poll() is None:
        table.append(rows(spark, [("own", len(table.versions()))]))
    assert other.returncode == 0, other.stderr.read().decode()[-2000:]
    out = held(table.read())
    assert [n for k, n in out if k == "other"] == list(range(6))
    assert table.versions() == list(range(1, len(out) + 1))


def test_a_batch_is_published_once(spark, tmp_path):
    table = Ledger(spark, str(tmp_path / "t"), SCHEMA, "name")
    for n in (0, 1, 1, 0, 2):
        table.append(rows(spark, [("a", n)]), batch=("s", n))
    assert held(table.read()) == [("a", 0), ("a", 1), ("a", 2)]


def test_schema_is_checked(spark, tmp_path):
    for schema, key in (("a int", "b"), ("a int, row_id int", "a"), ("a int, __x int", "a")):
        with pytest.raises(ValueError):
            Ledger(spark, str(tmp_path / "t"), schema, key)


# --- re-index ------------------------------------------------------------------------------


def pages_of(files):
    return [(f, s, p, t, t is None) for f, (s, texts) in files.items() for p, t in enumerate(texts or [None], 1)]


def chunks(df):
    return sorted((r.source_file, r.page, r.chunk_no, r.chunk) for r in df.collect())


def long(word, n=300):
    return " ".join(f"{word}{i}" for i in range(n))


def test_index_follows_changes(spark, tmp_path):
    index = reindex.index_of(spark, str(tmp_path / "index"))
    steps = [
        {"a": (1, [long("a"), long("aa")]), "b": (1, [long("b")]), "c": (1, [long("c")])},
        {"a": (2, [long("new")]), "b": (2, None)},
        {"a": (1, [long("late")]), "c": (3, ["short"]), "d": (1, [long("d")])},  # an older state, and one too short to index
        {"b": (5, [long("again")])},
    ]
    now: dict = {}
    for i, step in enumerate(steps):
        changes = spark.createDataFrame(pages_of(step) * 2, reindex.CHANGE)  # every row twice
        for _ in range(2):  # and every batch
            reindex.apply_changes(index, changes, ("s", i))
        now |= {f: x for f, x in step.items() if f not in now or now[f][0] <= x[0]}
        whole = spark.createDataFrame([(f, s, p, t) for f, s, p, t, gone in pages_of(now) if not gone], "source_file string, state bigint, page bigint, text string")
        assert chunks(index.read()) == chunks(reindex.chunked(whole))
    assert {r.source_file for r in index.read().select("source_file").distinct().collect()} == {"a", "b", "d"}


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    index, source = reindex.index_of(spark, str(tmp_path / "index")), str(tmp_path / "in")
    send = lambda x: spark.createDataFrame(pages_of(x), reindex.CHANGE).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint="c"):
        stream = spark.readStream.schema(reindex.CHANGE).option("maxFilesPerTrigger", 1).parquet(source)
        reindex.follow(stream, index, str(tmp_path / checkpoint)).awaitTermination()

    send({"a": (1, [long("a")]), "b": (1, [long("b")])})
    run()
    send({"a": (2, [long("a2")])})
    send({"b": (2, None)})
    run()
    got = chunks(index.read())
    assert {x[0] for x in got} == {"a"} and got[0][3].startswith("a20 ")
    n = index.latest().number
    run()
    run("lost")  # all batches anew, after the checkpoint was lost
    assert index.latest().number == n and chunks(index.read()) == got


def test_folder_is_followed(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    files, index = Ledger(spark, str(tmp_path / "f"), reindex.FILES, "path"), reindex.index_of(spark, str(tmp_path / "i"))
    seen = []

    def parser(content):
        if content == b"bad":
            raise ValueError("no pages")
        return content.decode().split("|")

    run = lambda: reindex.sync(spark, str(folder), files, index, {"pdf": parser})
    (folder / "a.pdf").write_text(f"{long('x')}|{long('y')}")
    (folder / "b.TXT").write_text(long("t"))
    (folder / "c.pdf").write_bytes(b"bad")
    assert run() == {"changed": 3, "gone": 0, "failed": 1}
    assert {(r.source_file, r.page) for r in index.read().collect()} == {("a.pdf", 1), ("a.pdf", 2), ("b.TXT", None)}
    before = index.latest().number
    assert run() == {"changed": 0, "gone": 0, "failed": 0} and index.latest().number == before
    (folder / "a.pdf").write_text(f"{long('changed')} once more")
    (folder / "b.TXT").unlink()
    (folder / "c.pdf").write_text(long("fine"))
    assert run() == {"changed": 2, "gone": 1, "failed": 0}
    assert {(r.source_file, r.page) for r in index.read().collect()} == {("a.pdf", 1), ("c.pdf", 1)}
    assert index.read().where("source_file = 'a.pdf'").first().chunk.startswith("changed0 ")
    assert files.read().count() == 2 and not seen
