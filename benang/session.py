"""Session settings and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and the master is local, since
    a machine's own folder would lose what other machines write."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="benang-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Written tables that cut lineage; a lost executor costs a re-read, not a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark).rstrip('/')}/benang-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.remove)
        self.paths: dict[int, str] = {}

    def remove(self, path: str | None = None) -> None:
        """Delete a folder, all of this scratch's by default, on whatever store it is."""
        path = path or self.base
        if urlparse(path).scheme in ("", "file"):
            shutil.rmtree(urlparse(path).path, ignore_errors=True)
            return
        try:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone already
            pass

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a superseded table; nothing lazy may still depend on it."""
        path = self.paths.pop(id(df), None)
        if path is not None:
            self.remove(path)


def broadcast_if_small(df: DataFrame, bound: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast where ``bound``, which has at least as many rows, is small; else left to a
    shuffled join."""
    return F.broadcast(df) if bound.limit(rows + 1).count() <= rows else df


def parallelism(spark: SparkSession, rows: int, rows_per_task: int = 200_000) -> int:
    """Partitions such that a task holds a bounded number of rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), rows // rows_per_task + 1)
