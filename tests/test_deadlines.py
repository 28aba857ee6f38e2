"""Deadlines over the stream of events: moments do not depend on the order of files, and each comes once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docketry.streaming import deadlines

SCHEMA = "dispute_id long, seq long, ts timestamp_ntz, action string, response_type string"
T = datetime(2024, 1, 1)
END = datetime(2024, 12, 31)


def events(seed=3, disputes=12, n=25):
    rng = random.Random(seed)
    out = []
    for d in range(disputes):
        at = T + timedelta(days=rng.random() * 20)
        for i in range(n):
            action = rng.choice(["create", "approve", "submit", "respond", "noop"]) if i % 6 else "create"
            out.append((d, len(out), at, action, rng.choice(["removed", "verified", "denied", "no_response", "frivolous", None]) if action == "respond" else None))
            at += timedelta(days=rng.choice([0, 0.5, 3, 9, 36, 60]))
    return [e for e in out if e[2] < END]


def slow(log, until=END):
    """Every dispute replayed for itself, interval by interval."""
    out = []
    for d in {e[0] for e in log}:
        steps, now = [], deadlines.Dispute()
        for _, seq, ts, action, response in sorted((e for e in log if e[0] == d), key=lambda e: (e[2], e[1])):
            us = (ts - datetime(1970, 1, 1)) // timedelta(microseconds=1)
            if (then := now.after(us, action, response)) is not now:
                steps.append((us, then))
                now = then
        ends = [us for us, _ in steps[1:]] + [(until - datetime(1970, 1, 1)) // timedelta(microseconds=1)]
        for (_, state), end in zip(steps, ends, strict=True):
            out += [(d, kind, state.round, datetime(1970, 1, 1) + timedelta(microseconds=us)) for kind, us in state.waits().items() if us < end]
    return sorted(out)


def rows(spark, folder):
    return sorted(tuple(r) for r in spark.read.parquet(folder).collect())


def write(spark, log, folder):
    spark.createDataFrame(log, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_the_guards_are_those_of_the_batch_fold(spark):
    from docketry.operators import lifecycle

    log = events()
    found = {r["dispute_id"]: (r["status"], r["round"], r["next_action"]) for r in lifecycle.fold(spark.createDataFrame(log, SCHEMA)).collect()}
    for d in {e[0] for e in log}:
        now = deadlines.Dispute()
        for _, _, ts, action, response in sorted((e for e in log if e[0] == d), key=lambda e: (e[2], e[1])):
            now = now.after((ts - datetime(1970, 1, 1)) // timedelta(microseconds=1), action, response)
        due = None if now.due is None else datetime(1970, 1, 1) + timedelta(microseconds=now.due)
        assert found[d] == (now.status, now.round, due)


@pytest.mark.parametrize("order", ["backwards", "mixed"])
def test_files_in_any_order(spark, order):
    log = events()
    assert len(slow(log)) >= 20 and {k for _, k, _, _ in slow(log)} == {"silent", "overdue"}
    frame = spark.createDataFrame(sorted(log, key=lambda e: e[2], reverse=True) if order == "backwards" else log, SCHEMA)
    found = deadlines.moments_until(frame.coalesce(1) if order == "backwards" else frame.repartition(3, "seq"), str(END), "500 days", 2)
    assert sorted(tuple(r) for r in found.collect()) == slow(log)


def test_day_by_day_with_little_lateness_repeats_nothing_and_counts_what_is_late(spark, tmp_path):
    """Each call takes up what is new; moments come when the watermark passes them; what is behind it is counted."""
    log, folder, out, checkpoint = sorted(events(5, 6), key=lambda e: e[2]), *(f"file://{tmp_path}/{x}" for x in ("log", "out", "checkpoint"))
    half = len(log) // 2
    mixed = log[: half - 3] + log[half : half + 1] + log[half - 3 : half]
    write(spark, mixed[:half], folder)
    assert deadlines.follow(spark, folder, out, checkpoint, "70 days") == 0
    early = rows(spark, out)
    assert early and early == [r for r in slow(log) if r[3] < mixed[:half][-1][2] and r in early]
    write(spark, mixed[half:] + log[half + 1 :], folder)
    assert deadlines.follow(spark, folder, out, checkpoint, "70 days") == 0
    write(spark, [(0, 9999, T, "create", None)], folder)
    assert deadlines.follow(spark, folder, out, checkpoint, "70 days") == 1
    deadlines.tick(spark, folder, str(END + timedelta(days=70)))
    assert deadlines.follow(spark, folder, out, checkpoint, "70 days") == 0
    assert rows(spark, out) == slow(log)
    assert deadlines.follow(spark, folder, out, checkpoint, "70 days") == 0 and rows(spark, out) == slow(log)


def test_empty_log(spark):
    empty = spark.createDataFrame([], SCHEMA).withColumn("extra", F.lit(1))
    assert deadlines.moments_until(empty, str(END), "500 days").count() == 0


def test_the_list_of_waiting_events_has_a_row_for_a_batch(spark, tmp_path):
    """State grows by one row for each batch that brings events of a dispute, whatever their number."""
    log, folder, checkpoint = events(), f"file://{tmp_path}/log", f"file://{tmp_path}/checkpoint"
    for part in (log[::2], log[1::2]):
        write(spark, part, folder)
        deadlines.follow(spark, folder, f"file://{tmp_path}/out", checkpoint, "500 days")
    rows = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    assert len(log) > 100 and rows.count() == 2 * len({e[0] for e in log})
