"""Writing results: versions, partitions, bundles, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from voltloom.operators.frames import look_up, reorder, require
from voltloom.operators.summaries import upsert
from voltloom.sources.tables import dialects, read_csv


def write(df: DataFrame, path: str, *, form: str = "parquet", by: Sequence[str] = (), mode: str = "overwrite", **options: str) -> None:
    """Write a table, one directory for each value of ``by``; CSV has a header.

    Rows of a value are brought together, but a value with many rows is split
    over several tasks and files.
    """
    if by:
        df = df.hint("rebalance", *[F.col(c) for c in by])
    writer = df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)
    writer.option("header", True).options(**options).format(form).save(path)


def write_bundle(tables: dict[str, DataFrame], path: str, *, form: str = "parquet") -> None:
    """Several results under one directory."""
    for name, df in tables.items():
        write(df, f"{path}/{name}", form=form)


def latest(spark: SparkSession, path: str) -> int | None:
    """The newest complete version under a path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max(done, default=None)


def merge_and_save(new: DataFrame, path: str, keys: Sequence[str], value: str, *, policy: str = "skip") -> int:
    """Merge values into the stored table and write the result as its next version; readers keep theirs meanwhile."""
    spark = new.sparkSession
    before = latest(spark, path)
    merged = new.select(*keys, value) if before is None else upsert(spark.read.parquet(f"{path}/v{before}"), new, keys, value, policy=policy)
    version = 0 if before is None else before + 1
    merged.write.parquet(f"{path}/v{version}")
    return version


def write_summary(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def observed(df: DataFrame, name: str, **counts: str) -> tuple[DataFrame, Observation]:
    """The table, and counts of rows for which conditions hold, known once it has been written; no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), *[F.count_if(F.expr(c)).alias(n) for n, c in counts.items()]), seen


def required(df: DataFrame, name: str, columns: Sequence[str], *, blank: bool = False) -> tuple[DataFrame, Observation]:
    """``require``, with the counts of ``rows`` and of rows that lack each column (``lacks_<n>``), known once it has been written."""
    lacking = {f"lacks_{n}": f"`{c}` is null" + (f" or trim(cast(`{c}` as string)) = ''" if blank else "") for n, c in enumerate(columns)}
    seen, counts = observed(df, name, **lacking)
    return require(seen, columns, blank=blank), counts


def amend_files(lookup: DataFrame, path: str, key: str, value: str, *, after: str | None = None, suffix: str = "", delimiter: str | None = None) -> int:
    """Insert a looked-up column into each CSV file of a path; one file comes out for each that goes in.

    The column stands behind ``after`` (by default the key); rows without a match
    have an empty cell. Each file keeps its name (with ``suffix`` before the
    ending), delimiter and order of rows. All files are written before the first
    is swapped in, by renaming; a run that fails leaves the old ones. Returns the
    number of files.
    """
    spark = lookup.sparkSession
    once = lookup.select(key, value).groupBy(key).agg(F.min(value).alias(value))
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    written = []
    for dialect, files in dialects(spark, path, delimiter=delimiter).items():
        for file in files:
            rows = read_csv(spark, file, delimiter=dialect.delimiter).withColumn("__row", F.monotonically_increasing_id())
            rows = rows.drop(value) if value in dialect.columns else rows
            made = reorder(look_up(rows, once, key, value, None).orderBy("__row").drop("__row").select(*[c for c in dialect.columns if c != value], value), after=(value, after or key))
            folder, _, name = file.rpartition("/")
            stem, dot, ending = name.rpartition(".")
            target = f"{folder}/{stem}{suffix}{dot}{ending}" if dot else f"{folder}/{name}{suffix}"
            aside = f"{folder}/.{name}.amending"
            made.coalesce(1).write.mode("overwrite").option("header", True).option("sep", dialect.delimiter).option("emptyValue", "").csv(aside)
            written.append((aside, target))
    for aside, target in written:
        files = fs_path(aside).getFileSystem(conf)
        part = next(s.getPath() for s in files.listStatus(fs_path(aside)) if s.getPath().getName().startswith("part-"))
        files.delete(fs_path(target), False)
        files.rename(part, fs_path(target))
        files.delete(fs_path(aside), True)
    return len(written)
