"""Versioned snapshots of tables, and what else is kept in shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the session's shared folder.

    A session within one process that names no folder gets a temporary one; on a cluster that raises.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="lodeworks-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that is there with all its content or not at all; False if one is there already, which stays.

    The content is written under another name first. Taking the final name is one exclusive step: a
    hard link on a local file system, a rename that doesn't overwrite elsewhere. Of several writers one
    succeeds, and a crash leaves nothing under the final name.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    hidden = hadoop.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(hidden, False)
    try:
        stream.writeUTF(text)
    finally:
        stream.close()
    try:
        if target.toUri().getScheme() == "file":
            link, own = (jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, hidden))
            jvm.java.nio.file.Files.createLink(link, own)
        else:
            kind = getattr(hadoop, "Options$Rename")
            how = spark.sparkContext._gateway.new_array(kind, 1)
            how[0] = kind.NONE
            hadoop.FileContext.getFileContext(target.toUri(), conf).rename(hidden, target, how)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(hidden, False)
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """The content of a file made by ``publish``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers that name files of the folder, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


class SnapshotStore:
    """Tables of one version are written as a whole; the version's marker file makes them visible."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """The latest visible version, 0 if there is none."""
        return max(versions(self.spark, f"{self.path}/versions"), default=0)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{read_text(self.spark, f'{self.path}/versions/{version or self.version()}')}/{table}")

    def write(self, tables: dict[str, DataFrame]) -> int:
        """A new version; raises ``FileExistsError`` if another writer made it meanwhile, and then changes nothing."""
        version = self.version() + 1
        folder = f"{self.path}/data/{version}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        if not publish(self.spark, f"{self.path}/versions/{version}", folder):
            raise FileExistsError(f"version {version} of {self.path}")
        return version
