"""The dispute fold over a stream of events.

A subset of the batch fold's state: status, round, submissions and rejections. What follows from
these and the last event (next action, outcome, strategy, letter) is a column function of
``functions.steps`` over its output, or the batch fold's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docketry.functions import steps

OUTPUT = "dispute_id long, status string, round int, sent int, rejected int"
STATE = "status string, round int, sent int, rejected int"


def advance(state: tuple, action: str, response: str | None) -> tuple:
    """One event; the same guards as the batch fold."""
    status, round_, sent, rejected = state
    if action == "create" and status is None:
        return "pending_approval", 1, 0, rejected
    if action == "approve" and status == "pending_approval":
        return "approved", round_, sent, rejected
    if action == "submit" and status == "approved":
        return "submitted", round_, sent + 1, rejected
    if action == "respond" and status is not None:
        return steps.STATUS_AFTER.get(response, "response_received"), round_ if response in ("removed", "frivolous") else round_ + 1, sent, rejected
    return status, round_, sent, rejected + 1


def _fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(state.get) if state.exists else (None, None, 0, 0)
    events = pd.concat(list(batches)).sort_values(["ts", "seq"])
    for action, response in zip(events["action"], events["response_type"], strict=True):
        now = advance(now, action, response)
    state.update(now)
    yield pd.DataFrame([(key[0], *now)], columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"round": "Int32", "sent": "int32", "rejected": "int32"})


def fold_stream(actions: DataFrame) -> DataFrame:
    """The state of each dispute with new events, after each micro-batch (update mode).

    Events of one dispute must come in order over micro-batches; within one they are sorted.
    """
    log = actions.where(F.col("action").isin("create", "approve", "submit", "respond"))
    return log.groupBy("dispute_id").applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows, late ones dropped after the watermark; ``ts`` is read as UTC."""
    timed = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    return timed.groupBy(F.window("time", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
