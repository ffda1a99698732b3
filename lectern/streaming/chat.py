"""X4 as a stream: each project's turns in order, once.

State is kept by project: the turn that is due, and the turns that came before it was their turn. A turn that is due is given out with those that
wait behind it; one that was given out, or waits already, is dropped when it is sent again. Where a turn doesn't come, those behind it wait
until the watermark has passed the oldest of them by `wait`; then they go out without it, and if it comes later it is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.sources.ledger import Ledger

TURN = "project string, turn bigint, role string, content string, ts timestamp"
OUT = "project string, turn bigint, role string, content string"
STATE = "due bigint, waiting string"


def ordered(turns: DataFrame, late: str = "10 minutes", wait: str = "30 minutes", first: int = 0) -> DataFrame:
    """Turns (project, turn, role, content, ts) by project in order, from the first on, each once."""
    pause = int(pd.Timedelta(wait).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, waiting = (state.get[0], {int(k): v for k, v in json.loads(state.get[1]).items()}) if state.exists else (first, {})
        out = []
        if state.hasTimedOut:
            due = min(waiting)  # the gap is given up
        for batch in batches:
            for turn, role, content, ts in zip(batch["turn"], batch["role"], batch["content"], batch["ts"], strict=True):
                if turn >= due and turn not in waiting:
                    waiting[int(turn)] = [role, content, int(ts.timestamp() * 1000)]
        while due in waiting:
            out.append((key[0], due, *waiting.pop(due)[:2]))
            due += 1
        state.update((due, json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(min(v[2] for v in waiting.values()) + pause, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["project", "turn", "role", "content"])

    return turns.withWatermark("ts", late).groupBy("project").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def store_of(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, path, OUT, "project")


def follow(turns: DataFrame, chats: Ledger, checkpoint: str, name: str = "chat", **how) -> StreamingQuery:
    """Ordered turns into a store, all that is there now; a batch that is run again is published once."""

    def one(rows: DataFrame, number: int) -> None:
        if chats.latest().batches.get(name, -1) >= number:
            rows.write.format("noop").mode("overwrite").save()  # published before; the state is still to be made
        else:
            chats.append(rows, batch=(name, number))

    return ordered(turns, **how).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
