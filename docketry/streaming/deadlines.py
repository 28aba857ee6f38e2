"""Deadlines of disputes as timers over the stream of events.

A dispute waits in two ways: it is silent when 35 days have passed since its submission, and
overdue when its next action is due while it is submitted or answered. Both moments are facts of
the log, whether or not an event follows: a timer on event time brings them about. Events that the
watermark has not passed wait in a list, so they may come in any order within the lateness allowed;
the state moves over them in order of time.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docketry.functions import dates, steps
from docketry.sources.shared import shared_path

DAY = 86_400_000_000
EVENTS = "events string"
STATE = "status string, round int, since long, due long, overdue_said boolean, silent_said boolean, waiting_from long, timer long"
MOMENT = "dispute_id long, kind string, round int, us long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Dispute(NamedTuple):
    """Status, round, when the last accepted event came, when the next action is due (in microseconds), and what has been said since."""

    status: str | None = None
    round: int | None = None
    since: int | None = None
    due: int | None = None
    overdue_said: bool = False
    silent_said: bool = False

    def after(self, us: int, action: str, response: str | None) -> Dispute:
        """The state after an event; the same state if a guard rejects it."""
        if action == "create" and self.status is None:
            return Dispute("pending_approval", 1, us, us + dates.RESPONSE_DAYS * DAY)
        if action == "approve" and self.status == "pending_approval":
            return Dispute("approved", self.round, us, self.due)
        if action == "submit" and self.status == "approved":
            return Dispute("submitted", self.round, us, self.due)
        if action == "respond" and self.status is not None:
            stays = response in ("removed", "frivolous")
            due = None if response == "removed" else us + dates.ROUND_DAYS * DAY
            return Dispute(steps.STATUS_AFTER.get(response, "response_received"), self.round if stays else self.round + 1, us, due)
        return self

    def waits(self) -> dict[str, int]:
        """The moments that come unless an event is accepted before, by kind."""
        out = {}
        if self.status in ("submitted", "response_received") and self.due is not None and not self.overdue_said:
            out["overdue"] = max(self.due, self.since)
        if self.status == "submitted" and not self.silent_said:
            out["silent"] = self.since + dates.RESPONSE_DAYS * DAY
        return out

    def said(self, before: int) -> tuple[Dispute, list[tuple[str, int, int]]]:
        """What comes to pass before a moment (kind, round, moment), and the state that has said so."""
        out = [(kind, self.round, us) for kind, us in self.waits().items() if us < before]
        kinds = {kind for kind, _, _ in out}
        return self._replace(overdue_said=self.overdue_said or "overdue" in kinds, silent_said=self.silent_said or "silent" in kinds), out


class Deadlines(StatefulProcessor):
    """Keeps events that are not final yet in a list and the dispute in a value; one timer stands at the next moment of either.

    A row of the list holds all events that one batch brought, as JSON, and the value knows the earliest of
    them and the timer: the list is read when the watermark has passed an event, and not before.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENTS)
        self.dispute = handle.getValueState("dispute", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        return self._moved(key, timerValues.getCurrentWatermarkInMs(), "[" + ",".join(r.event for r in rows) + "]")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return self._moved(key, timerValues.getCurrentWatermarkInMs(), "[]", expiredTimerInfo.getExpiryTimeInMs())

    def _moved(self, key: Any, watermark: int, batch: str, gone: int | None = None) -> Iterator[Row]:
        """Takes all events before the watermark in order, and says what came to pass between and after them; ``gone`` is a timer that Spark deletes."""
        kept, until = self.dispute.get() or (*Dispute(), None, None), max(watermark, 0) * 1000
        *state, stored, timer = kept
        now, events, ready = Dispute(*state), json.loads(batch), []
        first = min((us for us in (stored, *(e["us"] for e in events)) if us is not None), default=None)
        if first is not None and first < until:
            if stored is not None:
                events += [e for (earlier,) in self.waiting.get() for e in json.loads(earlier)]
                self.waiting.clear()
            events.sort(key=lambda e: (e["us"], e["seq"]))
            n = bisect_left(events, until, key=lambda e: e["us"])
            ready, events = events[:n], events[n:]
            first, batch = events[0]["us"] if events else None, json.dumps(events)
        if events:
            self.waiting.appendValue((batch,))
        out: list[tuple[str, int, int]] = []
        for e in ready:
            if (then := now.after(e["us"], e["action"], e.get("response_type"))) is not now:
                out += now.said(e["us"])[1]
                now = then
        now, more = now.said(until)
        out += more
        coming = [*([] if first is None else [first]), *now.waits().values()]
        at = max(min(coming) // 1000 + 1, watermark + 1) if coming else None
        if at != timer:
            if timer is not None and timer != gone:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        if (*now, first, at) != tuple(kept):
            self.dispute.update((*now, first, at))
        return (Row(dispute_id=key[0], kind=kind, round=round_, us=us) for kind, round_, us in out)

    def close(self) -> None:
        pass


def moments(actions: DataFrame, late: str) -> DataFrame:
    """When each dispute of the log (dispute_id, seq, ts, action, response_type) falls silent or overdue: dispute_id, kind, round, moment.

    A moment is put out once, as soon as the watermark (the latest ``ts`` less ``late``) is past it,
    if no event was accepted before it; an event of the very same moment comes after it. An event
    that comes behind the watermark is dropped and counted in the stream's progress. Rows without a
    dispute, or of actions other than the four, only move the watermark.
    """
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    timed = actions.select("dispute_id", F.timestamp_micros(us).alias("time"), "action", F.to_json(F.struct(us.alias("us"), "seq", "action", "response_type")).alias("event")).withWatermark("time", late)
    # the key depends on the time, else the filter would go below the watermark, which other rows would no longer move
    counts = F.col("time").isNotNull() & F.col("action").isin("create", "approve", "submit", "respond")
    log = timed.withColumn("dispute_id", F.when(counts, F.col("dispute_id"))).where(F.col("dispute_id").isNotNull()).select("dispute_id", "time", "event")
    out = log.groupBy("dispute_id").transformWithState(Deadlines(), MOMENT, "Append", "EventTime")
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("us") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    return out.select("dispute_id", "kind", "round", at.alias("moment"))


@contextmanager
def state_in_rocks(spark: SparkSession):
    """Streams that start meanwhile keep their state in RocksDB, of which only changes are written for each batch."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def follow(spark: SparkSession, log: str, out: str, checkpoint: str, late: str, files: int = 1000) -> int:
    """Takes up all files of the folder ``log`` that are new since the last call, and adds the moments to the folder ``out``.

    Returns the number of events that came too late. A call that fails is taken up where its
    checkpoint ends; a moment is written once.
    """
    schema = spark.read.parquet(log).schema
    with state_in_rocks(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(log)
        run = moments(stream, late).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
        run.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in p["stateOperators"])


def tick(spark: SparkSession, log: str, at: str) -> None:
    """Adds a row to the folder ``log`` that says the time and nothing else."""
    schema = spark.read.parquet(log).schema
    values = {"ts": F.lit(at).cast("timestamp_ntz"), "action": F.lit("tick")}
    row = spark.range(1).select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    row.coalesce(1).write.mode("append").parquet(log)


def moments_until(actions: DataFrame, until: str, late: str, files: int = 4) -> DataFrame:
    """All moments of a log before ``until``, by a stream over its files in any order, some ``files`` at a time.

    ``late`` must reach over the whole log if its files are in no order. An empty log has none.
    """
    spark = actions.sparkSession
    log, out, checkpoint = (shared_path(spark, x) for x in ("log", "moments", "moments-checkpoint"))
    actions.write.parquet(log)
    follow(spark, log, out, checkpoint, late, files)
    end = spark.range(1).select((F.lit(until).cast("timestamp_ntz") + F.expr(f"INTERVAL {late}")).cast("string")).first()[0]
    tick(spark, log, end)
    follow(spark, log, out, checkpoint, late, files)
    return spark.read.schema("dispute_id long, kind string, round int, moment timestamp_ntz").parquet(out)
