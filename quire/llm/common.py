"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column whose name is taken literally, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    A session on one machine that names none (a local test) gets a temporary one; a
    cluster must name it, since no machine's own folder is seen by the others.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="quire-")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows: the size check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after asking for Arrow batches that fit whole texts.

    A batch has 1000 rows or 32 MB at most (or one longer row). These are settings of the
    session and stay; a session that names numbers of its own keeps them.
    """
    conf = df.sparkSession.conf
    for name, common, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", str(2**63 - 1), str(32 << 20))):
        key = f"spark.sql.execution.arrow.{name}"
        if conf.get(key, None) in (common, f"{common}b", f"{common}B"):
            conf.set(key, value)
    return df


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def release() -> None:
    """Give memory that a batch or task no longer needs back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def portions(text: pa.Array, size: int = 750_000) -> Iterator[list[str | None]]:
    """The texts of a batch in lists of about ``size`` code points, so that work on many at once stays bounded."""
    held, n = [], 0
    for t in text:
        held.append(t.as_py())
        n += len(held[-1] or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held
