"""A project's cached indexes and its chat as a stream."""

import datetime
import os
import random

from pyspark.sql import functions as F

from lectern.plans.project import IndexCache
from lectern.sources import store
from lectern.streaming import chat


def files(spark, rows):
    return spark.createDataFrame([(p, n, datetime.datetime(2024, 1, 1, m), s) for p, n, m, s in rows], "project string, name string, modified timestamp, length bigint")


def test_one_changed_file_rebuilds_one_project(spark, tmp_path):
    rows = [(p, f"{n}.txt", n, 10 * n) for p in ("a", "b", "c") for n in range(4)]
    built = []

    def run(rows, most=8):
        cache = IndexCache(spark, f"file://{tmp_path}/cache", most)  # another session finds what there is
        for r in store.signature(files(spark, rows)).orderBy("project").collect():

            def make(folder, project=r.project):
                built.append(project)
                spark.range(1).select(F.lit(project).alias("project")).write.parquet(folder)

            assert spark.read.parquet(cache.get(r.project, r.signature, make)).first().project == r.project

    run(rows)
    run(list(reversed(rows)))  # the order of files doesn't matter
    assert built == ["a", "b", "c"]
    run([x if x[:2] != ("b", "2.txt") else ("b", "2.txt", 2, 21) for x in rows])
    assert built == ["a", "b", "c", "b"]
    assert len(os.listdir(tmp_path / "cache" / "indexes")) == 3
    del built[:]
    run([x for x in rows if x[0] != "b"], most=2)  # a and c were used last
    assert built == [] and len(os.listdir(tmp_path / "cache" / "indexes")) == 2
    run([x for x in rows if x[0] == "b"], most=2)  # b comes, a goes
    run([x for x in rows if x[0] == "c"], most=2)
    assert built == ["b"]
    run([x for x in rows if x[0] == "a"], most=2)
    assert built == ["b", "a"]


def test_equal_files_are_counted(spark):
    one = store.signature(files(spark, [("a", "x", 1, 1)])).first().signature
    assert store.signature(files(spark, [("a", "x", 1, 1)] * 2)).first().signature != one == store.signature(files(spark, [("a", "x", 1, 1)])).first().signature


def test_chat_is_replayed_in_order(spark, tmp_path):
    r, start = random.Random(4), datetime.datetime(2024, 1, 1)
    sent = [(p, t, "user" if t % 2 == 0 else "assistant", f"{p} says {t}", start + datetime.timedelta(seconds=20 * t)) for p in ("a", "b", "c") for t in range(12)]
    sent = [x for x in sent if x[:2] != ("c", 3)]  # never comes
    mixed = sent + r.sample(sent, 15)  # sent again
    r.shuffle(mixed)
    source, chats = str(tmp_path / "in"), chat.store_of(spark, str(tmp_path / "chats"))

    def send(rows):
        spark.createDataFrame(rows, chat.TURN).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint="checkpoint"):
        stream = spark.readStream.schema(chat.TURN).option("maxFilesPerTrigger", 1).parquet(source)
        chat.follow(stream, chats, str(tmp_path / checkpoint)).awaitTermination()

    def got():
        return [(x.project, x.turn, x.content) for x in chats.read().orderBy("project", "row_id").collect()]

    send(mixed[:20])
    run()
    send(mixed[20:30]), send(mixed[30:])
    run()  # goes on from its checkpoint
    want = [x[:2] + (x[3],) for x in sent if x[0] != "c" or x[1] < 3]
    assert got() == want
    n = chats.latest().number
    run("lost")  # all anew: nothing is published twice
    assert chats.latest().number >= n and got() == want
    send([("z", 0, "user", "z says 0", start + datetime.timedelta(hours=2))])
    send([("z", 1, "user", "z says 1", start + datetime.timedelta(hours=2))])
    send([("c", 3, "user", "c says 3, too late", start + datetime.timedelta(hours=2))])
    run()
    assert got() == [x[:2] + (x[3],) for x in sent] + [("z", 0, "z says 0"), ("z", 1, "z says 1")]
