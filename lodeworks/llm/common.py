"""Shared storage and small helpers of the operators in this package."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Token separator class of the word operators: ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A session within one process that names none gets a temporary folder; on a cluster that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lodeworks-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lodeworks/{name}-{uuid.uuid4().hex}"


class _Made(threading.local):
    """Tables that ``stored`` has made in this thread and that are still there."""

    def __init__(self):
        self.paths: list[str] = []


_MADE = _Made()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage.

    It stays until ``drop_stored`` or ``release`` deletes it, since results are read from it later.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _MADE.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _MADE.paths:
        _MADE.paths.remove(path)


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing reads any more; other tables stay."""
    if path := getattr(df, "_stored_at", None):
        _delete(df.sparkSession, path)


def stored_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, stored; the tables that were stored for it are deleted."""
    before = set(_MADE.paths)
    out = stored(make(), name)
    for path in [p for p in _MADE.paths if p not in before and p != out._stored_at]:
        _delete(out.sparkSession, path)
    return out


def release(spark: SparkSession) -> int:
    """Delete all tables that operators have stored in this thread, once their results are written elsewhere; how many there were."""
    paths = list(_MADE.paths)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col):
    """A-Z to a-z, all else as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
