"""A store of batches: each is written once and merged when read.

A batch is a folder of its own, so that taking it in costs what the batch costs,
however much the store holds. A version is a small manifest that names the
folders it is made of: a compacted base and the batches since. Readers of a
version are not disturbed by later ones; a batch that comes again counts once.
Now and then the batches are merged into a new base.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column that holds the number of the batch a row comes from.
BATCH = "batch"
Merge = Callable[[DataFrame], DataFrame]


class BatchStore:
    """Batches under one folder, with a ``merge`` that makes one table of rows of several batches.

    ``merge`` takes rows with their number in ``batch`` and returns such rows, so
    that merged rows can be merged again. After ``compact_after`` batches the next
    one is followed by a compaction.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Merge, *, compact_after: int = 32):
        self.spark, self.path, self.merge, self.compact_after = spark, path.rstrip("/"), merge, compact_after
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        """The numbers of all versions, oldest first."""
        if not self._fs.exists(self._path("versions")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """Folders and batch numbers of a version, by default the newest."""
        known = self.versions()
        if version is None:
            if not known:
                return {"version": 0, "base": None, "parts": [], "last": {}}
            version = known[-1]
        text = self.spark.read.text(f"{self.path}/versions/{version:09d}.json", wholetext=True).head()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> int:
        """Name a new version; of two writers of one version the second fails."""
        manifest = manifest | {"version": manifest["version"] + 1}
        aside = self._path(f"versions/.{manifest['version']:09d}.tmp")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(aside, self._path(f"versions/{manifest['version']:09d}.json")):
            raise RuntimeError(f"version {manifest['version']} of {self.path} was written by another writer")
        return manifest["version"]

    def append(self, batch: DataFrame, number: int, *, source: str = "") -> int:
        """Take in a batch and return the version that has it; a number that its source has sent already changes nothing.

        Numbers of a source ascend. A batch that failed half-way is written anew.
        """
        now = self.manifest()
        if number <= now["last"].get(source, -1):
            return now["version"]
        ordinal = sum(v + 1 for v in now["last"].values())
        name = f"batches/{source or 'batch'}-{number:09d}"
        batch.withColumn(BATCH, F.lit(ordinal).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{name}")
        version = self._commit(now | {"parts": [*now["parts"], name], "last": now["last"] | {source: number}})
        return self.compact() if len(now["parts"]) >= self.compact_after else version

    def read(self, version: int | None = None) -> DataFrame:
        """The merged rows of a version."""
        now = self.manifest(version)
        folders = [*([now["base"]] if now["base"] else []), *now["parts"]]
        if not folders:
            raise ValueError(f"{self.path} has no batch")
        return self.merge(self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders]))

    def compact(self) -> int:
        """Merge base and batches into a new base; older versions stay readable."""
        now = self.manifest()
        base = f"bases/{now['version'] + 1:09d}"
        self.read(now["version"]).write.mode("overwrite").parquet(f"{self.path}/{base}")
        return self._commit(now | {"base": base, "parts": []})

    def vacuum(self, keep: int = 1) -> None:
        """Delete versions but the newest ``keep``, and folders that none of those has."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        used = {f.rsplit("/", 1)[-1] for m in kept for f in [m["base"] or "", *m["parts"]]}
        for folder in ("batches", "bases"):
            for status in self._fs.listStatus(self._path(folder)) if self._fs.exists(self._path(folder)) else []:
                if status.getPath().getName() not in used:
                    self._fs.delete(status.getPath(), True)
        for v in known[:-keep]:
            self._fs.delete(self._path(f"versions/{v:09d}.json"), False)


def keep_values(keys: Sequence[str], value: str, policy: str = "skip") -> Merge:
    """A merge that keeps the first known value of each key ("skip") or the last ("overwrite"); null keys meet as equals."""
    if policy not in ("skip", "overwrite"):
        raise ValueError(policy)

    def merge(rows: DataFrame) -> DataFrame:
        known = F.when(F.col(value).isNotNull(), F.col(BATCH))
        pick = F.min_by if policy == "skip" else F.max_by
        return rows.groupBy(*keys).agg(pick(F.struct(value, BATCH), known).alias("__s"), F.min(BATCH).alias("__b")).select(*keys, F.col(f"__s.{value}").alias(value), F.coalesce(f"__s.{BATCH}", "__b").alias(BATCH))

    return merge
