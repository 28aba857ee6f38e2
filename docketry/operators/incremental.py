"""Stored tables of disputes that slices of the event log are applied to.

``disputes`` holds each dispute's state and its mark, the last event it has seen. ``rounds`` holds
the rows that submissions and responses append. ``changes`` holds what each slice took from and
gave to the statuses. All three are in folders by bucket of the dispute; a slice reads and rewrites
only the buckets it touches, by dynamic partition overwrite. Disputes are written last and an event
at or before its dispute's mark is left out, so a slice may be repeated, after success or failure:
what is written twice is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import lifecycle

BUCKETS = 64
_STATE = lifecycle.STATE[len("struct<") : -1].replace(":", " ").replace(",", ", ")
DISPUTES = f"dispute_id bigint, {_STATE}, mark_ts timestamp_ntz, mark_seq bigint, bucket int"
ROUNDS = (
    "dispute_id bigint, seq bigint, round_number int, sent_date timestamp_ntz, response_received_date timestamp_ntz, response_type string, next_strategy string, bucket int"
)
CHANGES = "day date, status string, change bigint, slice string, bucket int"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the folder; empty before its first slice."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def put(rows: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that ``rows`` have rows of, and no others."""
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert(spark: SparkSession, path: str, schema: str, new: DataFrame, keys: list[str]) -> None:
    """Rows of ``new`` (one for each key) take the place of stored ones with their keys; other rows stay.

    Only the buckets of new rows are read and rewritten; their numbers are all that the driver sees.
    """
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    if touched:
        old = stored(spark, path, schema).where(F.col("bucket").isin(touched))
        names = [f.name for f in old.schema]
        put(old.join(new.select(*keys, "bucket"), [*keys, "bucket"], "left_anti").select(names).unionByName(new.select(names)), path, "bucket")


def apply_slice(spark: SparkSession, folder: str, actions: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """Applies a slice of the log (dispute_id, seq, ts, action, response_type), called ``name``, to the tables in ``folder``.

    Slices come in the order of the log by dispute: an event before its dispute's mark counts as
    seen. Within a slice any order will do; repeated events count once. Rows without a dispute are
    left out. The number of buckets is that of the first slice for good.
    """
    paths = {x: f"{folder}/{x}" for x in ("disputes", "rounds", "changes", "applied")}
    log = lifecycle.gathered(actions.where(F.col("dispute_id").isNotNull()).dropDuplicates(["dispute_id", "ts", "seq"])).withColumn("bucket", bucket_of(F.col("dispute_id"), buckets))
    touched = [r["bucket"] for r in log.select("bucket").distinct().collect()]
    if not touched:
        return
    fields = [f.split(" ")[0] for f in _STATE.split(", ")]
    old = stored(spark, paths["disputes"], DISPUTES).where(F.col("bucket").isin(touched))
    old = old.select("dispute_id", "bucket", F.struct("mark_ts", "mark_seq").alias("mark"), F.struct(*fields).alias("was"))
    both = log.join(old, ["dispute_id", "bucket"], "left").withColumn("was", F.coalesce("was", lifecycle.nothing()))
    unseen = F.filter("events", lambda e: F.col("mark").isNull() | (F.struct(e["ts"].alias("mark_ts"), e["seq"].alias("mark_seq")) > F.col("mark")))
    both = both.withColumn("events", unseen).where(F.size("events") > 0)
    last = F.element_at("events", -1)
    result = both.select("dispute_id", "bucket", last["ts"].alias("mark_ts"), last["seq"].alias("mark_seq"), lifecycle.replayed(F.col("events"), F.col("was")).alias("r"))
    # written once, so that all three tables follow from one reading of the old state; a failed slice leaves it behind and the next one replaces it
    result.write.mode("overwrite").parquet(paths["applied"])
    result = spark.read.schema(result.schema).parquet(paths["applied"])
    events = result.select("dispute_id", "bucket", F.inline("r.out"))
    upsert(spark, paths["rounds"], ROUNDS, lifecycle.rounds_of(events, "bucket"), ["dispute_id", "seq"])
    changes = lifecycle.status_changes(events, "bucket")
    put(changes.withColumn("slice", F.lit(name)).select("day", "status", "change", "slice", "bucket"), paths["changes"], "slice", "bucket")
    upsert(spark, paths["disputes"], DISPUTES, result.select("dispute_id", "r.s.*", "mark_ts", "mark_seq", "bucket"), ["dispute_id"])


def disputes(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, f"{folder}/disputes", DISPUTES).drop("bucket", "mark_ts", "mark_seq")


def rounds(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, f"{folder}/rounds", ROUNDS).drop("bucket")


def counts_by_day(spark: SparkSession, folder: str) -> DataFrame:
    changes = stored(spark, f"{folder}/changes", CHANGES).groupBy("day", "status").agg(F.sum("change").alias("change"))
    return lifecycle.counts_by_day(changes)
