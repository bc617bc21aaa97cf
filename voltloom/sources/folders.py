"""Folders that all executors reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session; a new temporary one only where none is named on a single machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="voltloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder inside the shared one; it goes when the application ends."""
    name = f"{shared_dir(spark)}/voltloom/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return name


class Workspace:
    """The written tables of one operator call, under one folder of their own.

    A table that later jobs read more than once is written and read back, which
    cuts its lineage on storage that every executor reaches. Results are lazy, so
    their tables must outlive the call; the folder goes when the application
    ends, and tables that nothing reads any more with ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = new_folder(spark, name)
        self._n = 0

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        self._n += 1
        name = f"{self.root}/{self._n:03d}-{label}"
        # hashes do not shrink, but zstd still helps ids and counts
        df.write.option("compression", "zstd").parquet(name)
        back = self.spark.read.schema(df.schema).parquet(name)
        back._settled_at = name  # noqa: SLF001
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete settled tables nothing reads any more."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._settled_at)  # noqa: SLF001
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
