"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a session on one machine that names none gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="quire-")).rstrip("/")


def light(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, to be broadcast if there are at most so many of them."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
