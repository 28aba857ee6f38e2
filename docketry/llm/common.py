"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``: the white space between words and around line keys.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_stored: list[str] = []
_tables: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder, by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches, so that a task's Python memory follows bytes and not rows of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's ``spark.checkpoint.dir``.

    Where it is not set, one machine (a ``local`` master) takes a temporary folder of its own, which
    becomes the setting for the whole session; a cluster has no folder that every executor sees, so
    there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; a master of {master!r} needs a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``clear`` will delete."""
    _stored.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _stored[-1]


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (in folders by a column, if named) and read it again: cuts lineage, and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, by: list[str]) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed and sorted by the columns ``by``."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(table)
    _tables.append(table)
    return spark.table(table)


def clear(spark: SparkSession) -> None:
    """Delete the tables that this process has stored; for when no result that reads them is needed any more."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _stored:
        delete(spark, _stored[-1])


def delete(spark: SparkSession, where: str) -> None:
    """Delete a path of ``shared_path`` that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _stored.remove(where)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; the built-in lower() serves where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def clean_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name
