"""Intermediate tables in the cluster's shared folder.

A table that later jobs read more than once is written to the folder named by
``spark.checkpoint.dir`` and read back. That cuts the lineage on storage every
executor can reach, so losing executors costs nothing but the tasks they ran.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltloom.sources.folders import new_folder

#: Uncompressed bytes of hashes do not shrink; zstd still helps ids and counts.
_OPTIONS = {"compression": "zstd"}
#: Rows of texts that a Python worker is sent at once at most.
TEXT_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Send texts to workers in batches of ``TEXT_ROWS`` rows, which bounds what a task holds of them on both sides.

    Sets the session's ``spark.sql.execution.arrow.maxRecordsPerBatch``, unless
    it is smaller already.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


class Workspace:
    """The tables of one operator call, under one folder of their own.

    Results are lazy, so their tables must outlive the call; the folder goes
    when the application ends, and tables that nothing reads any more with ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = new_folder(spark, name)
        self._n = 0

    def _path(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        self._n += 1
        name = f"{self.root}/{self._n:03d}-{label}"
        df.write.options(**_OPTIONS).parquet(name)
        back = self.spark.read.schema(df.schema).parquet(name)
        back._settled_at = name  # noqa: SLF001
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete settled tables nothing reads any more."""
        for table in tables:
            files, path = self._path(table._settled_at)  # noqa: SLF001
            files.delete(path, True)
