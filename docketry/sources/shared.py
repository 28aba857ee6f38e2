"""The folder that driver and executors share, for tables that outlive a query."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's ``spark.checkpoint.dir``.

    Where that is not set, a ``local`` master takes a temporary folder, and the session keeps it as
    the setting; a cluster has no folder that every executor sees, so there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; a master of {master!r} needs a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where}/{name}-{uuid.uuid4().hex}"
