"""Stored tables of disputes: slices add up to one fold, may be repeated, and leave other buckets alone."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from docketry.operators import incremental, lifecycle

SCHEMA = "dispute_id long, seq long, ts timestamp_ntz, action string, response_type string"
T = datetime(2024, 1, 1)


def events(seed, n=400, disputes=25):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        action = rng.choice(["create", "approve", "submit", "respond", "noop"])
        rows.append((rng.randrange(disputes) if i % 50 else None, i, T + timedelta(hours=i // 3), action, rng.choice(["removed", "verified", "denied", "no_response", "frivolous", None]) if action == "respond" else None))
    return rows


def sorted_rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def agree(spark, folder, log):
    whole = spark.createDataFrame([e for e in log if e[0] is not None], SCHEMA)
    assert sorted_rows(incremental.disputes(spark, folder)) == sorted_rows(lifecycle.fold(whole))
    assert sorted_rows(incremental.rounds(spark, folder)) == sorted_rows(lifecycle.round_rows(whole))
    assert sorted_rows(incremental.counts_by_day(spark, folder)) == sorted_rows(lifecycle.counts_by_day(lifecycle.status_changes(lifecycle.accepted(whole))))


def files(folder, *tables):
    return {str(p): p.stat().st_mtime_ns for t in tables for p in Path(folder, t).rglob("*.parquet")}


def test_ten_slices_are_one_fold_and_a_repeated_one_changes_nothing(spark, tmp_path):
    log, folder = events(1), f"{tmp_path}/tables"
    for i in range(10):
        part = log[40 * i : 40 * (i + 1)]
        incremental.apply_slice(spark, folder, spark.createDataFrame(part[::-1] + part[:3], SCHEMA), f"s{i}", 8)
    agree(spark, folder, log)
    before = files(folder, "disputes", "rounds", "changes")
    for i in (9, 4):
        incremental.apply_slice(spark, folder, spark.createDataFrame(log[40 * i : 40 * (i + 1)], SCHEMA), f"s{i}", 8)
    assert files(folder, "disputes", "rounds", "changes") == before
    agree(spark, folder, log)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    log, folder = events(2), f"{tmp_path}/tables"
    incremental.apply_slice(spark, folder, spark.createDataFrame(log, SCHEMA), "all", 8)
    before = files(folder, "disputes", "rounds")
    more = [(3, 1000, T + timedelta(days=100), "respond", "denied"), (3, 1001, T + timedelta(days=101), "respond", "removed")]
    incremental.apply_slice(spark, folder, spark.createDataFrame(more, SCHEMA), "more", 8)
    after = files(folder, "disputes", "rounds")
    changed = {p.split("bucket=")[1].split("/")[0] for p in before.keys() ^ after.keys()}
    assert len(changed) == 1 and {p: t for p, t in before.items() if p in after} == {p: after[p] for p in before if p in after}
    agree(spark, folder, log + more)


@pytest.mark.parametrize("fails_at", [1, 2, 3])
def test_a_slice_that_failed_is_repeated(spark, tmp_path, monkeypatch, fails_at):
    """Rounds, changes and disputes are written in turn; the driver may be lost before any of them."""
    log, folder = events(3, 200), f"{tmp_path}/tables"
    half = spark.createDataFrame(log[:100], SCHEMA), spark.createDataFrame(log[100:], SCHEMA)
    incremental.apply_slice(spark, folder, half[0], "a", 4)
    real, calls = incremental.put, []

    def broken(rows, path, *by):
        calls.append(path)
        if len(calls) == fails_at:
            raise RuntimeError("lost")
        real(rows, path, *by)

    monkeypatch.setattr(incremental, "put", broken)
    with pytest.raises(RuntimeError):
        incremental.apply_slice(spark, folder, half[1], "b", 4)
    monkeypatch.setattr(incremental, "put", real)
    incremental.apply_slice(spark, folder, half[1], "b", 4)
    agree(spark, folder, log)


def test_nothing_to_apply(spark, tmp_path):
    empty = spark.createDataFrame([(None, 1, T, "create", None)], SCHEMA)
    incremental.apply_slice(spark, f"{tmp_path}/t", empty, "a", 4)
    assert incremental.disputes(spark, f"{tmp_path}/t").count() == 0 and incremental.counts_by_day(spark, f"{tmp_path}/t").count() == 0
