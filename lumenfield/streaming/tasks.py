"""Streams: task states, latest contents and reference pools that change with each query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfield.operators.selection import update_pool

TASK = "task_id string, status string, stage string, result string, error_message string, seq long"
POOL_STATE = "view_id array<string>, reliability array<double>, members array<array<long>>"


def task_table(events: DataFrame) -> DataFrame:
    """The last state of each task of an append log; a stage only counts where it is not empty."""
    latest = lambda c, where=None: F.max_by(c, F.when(where, F.col("seq")) if where is not None else F.col("seq"))
    named = F.col("stage").isNotNull() & (F.col("stage") != "")
    return events.groupBy("task_id").agg(
        latest("status").alias("status"), latest("stage", named).alias("stage"), latest("result").alias("result"), latest("error_message").alias("error_message"), F.max("seq").alias("seq")
    )


def task_stream(events: DataFrame) -> DataFrame:
    """The same on a stream: a state of a few strings for each task."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(("status", "stage", "result", "error_message", "seq"), state.get if state.exists else (None, None, None, None, -1), strict=True))
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for row in rows.itertuples():
            if row.seq < now["seq"]:
                continue
            text = lambda x: x if isinstance(x, str) else None
            now = {"status": text(row.status), "stage": text(row.stage) or now["stage"], "result": text(row.result), "error_message": text(row.error_message), "seq": int(row.seq)}
        state.update(tuple(now.values()))
        yield pd.DataFrame([{"task_id": key[0], **now}])

    return events.groupBy("task_id").applyInPandasWithState(step, TASK, TASK.removeprefix("task_id string, "), "update", GroupStateTimeout.NoTimeout)


def pool_stream(queries: DataFrame, capacity: int = 50, margin: float = 0.05, first: int = 2) -> DataFrame:
    """scene, seq, accepted, size for queries (scene, seq, view_id, reliability, members, has_pose).

    Each scene's pool is its state, changed in one commit with the answer. Queries without a pose leave
    it as it is; a pool with fewer than `first` views takes any view with a pose.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [])
        pool = [(v, float(r), set(m)) for v, r, m in zip(*held, strict=True)]
        out = []
        for row in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
            accepted = False
            if row.has_pose and row.view_id not in {v[0] for v in pool}:
                candidate = (row.view_id, float(row.reliability), set(row.members))
                if len(pool) < first:
                    pool, accepted = [*pool, candidate], True
                else:
                    pool, accepted = update_pool(pool, candidate, capacity, margin)
            out.append((key[0], int(row.seq), accepted, len(pool)))
        state.update(([v[0] for v in pool], [v[1] for v in pool], [[int(x) for x in sorted(v[2])] for v in pool]))
        yield pd.DataFrame(out, columns=["scene", "seq", "accepted", "size"])

    return queries.groupBy("scene").applyInPandasWithState(
        step, "scene string, seq long, accepted boolean, size long", POOL_STATE, "append", GroupStateTimeout.NoTimeout
    )
