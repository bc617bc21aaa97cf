"""Mergeable summaries of resources, and the conflict rules of repeated files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.functions.values import finite, ratio
from voltloom.operators.frames import first_by, require, value_by_order

KEYS = ("resource_name", "resource_type")


def partial_summary(rows: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """One row a resource: first and last time, row count, and sum, count, least and greatest of each metric.

    Partial summaries of different files add up with ``merge_summaries``.
    """
    rows = require(rows, [*keys, ts])
    parts = [F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("row_count")]
    for m in metrics:
        parts += [F.sum(finite(m)).alias(f"{m}_sum"), F.count(finite(m)).alias(f"{m}_count"), F.min(finite(m)).alias(f"{m}_min"), F.max(finite(m)).alias(f"{m}_max")]
    return rows.groupBy(*keys).agg(*parts)


def merge_summaries(parts: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Partial summaries of the same resources as one."""
    merged: list[Column] = [F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("row_count").alias("row_count")]
    for m in metrics:
        merged += [f(f"{m}_{n}").alias(f"{m}_{n}") for n, f in (("sum", F.sum), ("count", F.sum), ("min", F.min), ("max", F.max))]
    return parts.groupBy(*keys).agg(*merged)


def finish_summary(summary: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """With averages in place of sums and counts; none where nothing was counted."""
    shown = [c for m in metrics for c in (ratio(f"{m}_sum", f"{m}_count").alias(f"{m}_avg"), F.col(f"{m}_min"), F.col(f"{m}_max"))]
    return summary.select(*keys, "first_ts", "last_ts", "row_count", *shown)


def resource_summary(rows: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return finish_summary(partial_summary(rows, metrics, keys), metrics, keys)


def resolve_files(rows: DataFrame, keys: Sequence[str], value: str, *, policy: str = "skip", file: str = "file_ord", row: str = "row_ord") -> DataFrame:
    """One value for each key: within a file its first; of several files the first ("skip") or the last ("overwrite")."""
    if policy not in ("skip", "overwrite"):
        raise ValueError(policy)
    order = [F.col(file), F.col(row)] if policy == "skip" else [F.col(file), -F.col(row)]
    return rows.groupBy(*keys).agg(value_by_order(value, order, last=policy == "overwrite").alias(value))


def mean_then_last(rows: DataFrame, keys: Sequence[str], value: str, *, file: str = "file_ord") -> DataFrame:
    """The mean within each file; of several files the last."""
    means = rows.groupBy(*keys, file).agg(F.avg(value).alias(value))
    return means.groupBy(*keys).agg(value_by_order(value, [file], last=True).alias(value))


def attach_type(rows: DataFrame, types: DataFrame, *, order: Sequence[str], last: bool = False, default: str = "Unknown", key: str = "resource_name", kind: str = "resource_type") -> DataFrame:
    """The resource's first (or last) non-blank type, or the default."""
    known = first_by(require(types, [kind], blank=True), [key], order, last=last).select(key, F.trim(kind).alias("__kind"))
    return rows.drop(kind).join(known, key, "left").withColumn(kind, F.coalesce("__kind", F.lit(default))).drop("__kind")


def average_by(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Averages by key, groups of null keys included and last."""
    made = rows.groupBy(*keys).agg(F.avg(value).alias(value))
    return made.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def box_rows(summary: DataFrame, groups: dict[str, Sequence[str]], value: str, *, kind: str = "resource_type", ts: str = "last_ts") -> DataFrame:
    """Values of a metric by named group of types and year, for box plots; a type may be in several groups."""
    pairs = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(t).alias("kind")) for g, ts_ in groups.items() for t in ts_])
    rows = summary.withColumn("__pair", F.explode(F.filter(pairs, lambda p: p["kind"] == F.col(kind))))
    return rows.select(F.col("__pair.group").alias("group"), kind, F.year(ts).alias("year"), value).filter(F.col(value).isNotNull())


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str, *, policy: str = "skip") -> DataFrame:
    """Old and new values of all keys: new ones fill gaps ("skip") or replace ("overwrite"); null keys meet as equals."""
    parts = old.select(*keys, value, F.lit(0).alias("__new")).unionByName(new.select(*keys, value, F.lit(1).alias("__new")))
    return parts.groupBy(*keys).agg(value_by_order(value, ["__new"], last=policy == "overwrite").alias(value))


def in_day(rows: DataFrame, day: str, ts: str = "ts") -> DataFrame:
    """Rows of one date, by a half-open range so that files and row groups can be skipped."""
    start = F.lit(day).cast("timestamp_ntz")
    return rows.filter((F.col(ts) >= start) & (F.col(ts) < start + F.expr("interval 1 day")))


def in_month(rows: DataFrame, month: str, ts: str = "ts") -> DataFrame:
    """Rows of one month (its first day is given)."""
    start = F.lit(month).cast("timestamp_ntz")
    return rows.filter((F.col(ts) >= start) & (F.col(ts) < start + F.expr("interval 1 month")))


def in_hour(rows: DataFrame, day: str, hour: int, ts: str = "ts") -> DataFrame:
    """Rows of one hour (0-23) of a date."""
    start = F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour))
    return rows.filter((F.col(ts) >= start) & (F.col(ts) < start + F.expr("interval 1 hour")))


def type_matrix(rows: DataFrame, values: Sequence[str], row: Sequence[str], column: str, value: str, *, agg: str = "first") -> DataFrame:
    """Long to wide with an explicit list of column values, so that no extra job looks for them."""
    cell = {"first": F.first(value, ignorenulls=True), "mean": F.avg(value), "sum": F.sum(value)}[agg]
    return rows.groupBy(*row).pivot(column, list(values)).agg(cell)
