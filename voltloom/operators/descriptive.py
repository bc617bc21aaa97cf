"""Fuel and plant statistics: heat rates, categories, buckets, off-peak hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.functions.names import clean
from voltloom.functions.values import last_pattern, ratio
from voltloom.operators.frames import value_counts

#: Evening hour from which a month's hours are off peak (fixed values; other months 21).
OFF_PEAK_START = {11: 18, 12: 18, 1: 18, 10: 19, 2: 19, 9: 20, 4: 20}
#: Month names as tables spell them (fixed values).
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Parent categories whose units are recoded, and patterns of unit names with the category
#: each gives; of several that match the last counts (fixed values).
RECODED = ("Base Expansion", "Historical Proxies", "Spark Spread Proxies")
CATEGORY_PATTERNS = [
    (r"\bwind\b", "WT_WND"),
    (r"\bnuclear\b", "ST_NUC"),
    (r"\bscct\b", "SCCT_NG"),
    (r"\bsolar\b", "PV_SUN"),
    (r"\bhybrid\s*pv[-\s]*bess\b", "PVGR-BESS"),
    (r"\bccct\b", "CCCT_NG"),
    (r"\bcgt\b|\bgt\b", "CCGT_NG"),
    (r"\bcoal\b", "ST_COAL"),
    (r"\bhydro\b", "HY_WAT"),
    (r"\bgas\b", "OtherTech_NG"),
]


def heat_rates(wide: DataFrame, ids: Sequence[str], *, heat: str = "Elec_MMBtu", net: str = "Netgen") -> DataFrame:
    """Heat rate by month, long, from two families of twelve columns: MMBtu over net MWh times 1000, NULL of zero."""
    months = F.explode(F.array(*[F.struct(F.lit(k).alias("month"), F.col(f"`{heat} {m}`").cast("double").alias("heat"), F.col(f"`{net} {m}`").cast("double").alias("net")) for k, m in enumerate(MONTHS, 1)]))
    rows = wide.select(*[f"`{c}`" for c in ids], months.alias("m"))
    return rows.select(*[f"`{c}`" for c in ids], "m.month", ratio("m.heat", F.col("m.net") * 1000).alias("heat_rate"))


def monthly_heat_rate(rates: DataFrame, fuel: str, scale: float = 1e6) -> DataFrame:
    """Mean heat rate by fuel and month, scaled."""
    return rates.filter("heat_rate is not null").groupBy(fuel, "month").agg((F.avg("heat_rate") * scale).alias("heat_rate"))


def recode(rows: DataFrame, category: str, child: str, *, parents: Sequence[str] = RECODED, patterns: Sequence[tuple[str, str]] = tuple(CATEGORY_PATTERNS)) -> DataFrame:
    """Category by the child's name where the parent is one that is recoded; of several patterns the last counts."""
    made = last_pattern(child, list(patterns), F.col(category))
    return rows.withColumn(category, F.when(F.trim(category).isin(*parents), made).otherwise(F.col(category)))


def category_summary(rows: DataFrame, category: str, value: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Count, sum, mean, median and extremes by category."""
    rows = rows.filter(~F.col(category).isin(*excluded)) if excluded else rows
    return rows.groupBy(category).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def property_pairs(rows: DataFrame, left: str, right: str, *, child: str = "Child Object", prop: str = "Property", value: str = "Value") -> DataFrame:
    """Two properties of the same object side by side."""
    a, b = (rows.filter(F.col(prop) == p).select(child, F.col(value).alias(n)) for p, n in ((left, "left_value"), (right, "right_value")))
    return a.join(b, child)


def bucket_fuels(units: DataFrame, bucket: str, fuel: str) -> DataFrame:
    """The sorted fuels of each bucket, and its number of units."""
    return units.groupBy(bucket).agg(F.array_sort(F.collect_set(fuel)).alias("fuels"), F.count("*").alias("units"))


def bucket_types(units: DataFrame, bucket: str, fuel: str) -> DataFrame:
    """How many buckets have each set of fuels."""
    return value_counts(bucket_fuels(units, bucket, fuel).withColumn("type", F.array_join("fuels", "|")), ["type"])


def in_buckets_with(units: DataFrame, bucket: str, fuel: str, target: str) -> DataFrame:
    """Units by fuel within the buckets that have the target fuel."""
    with_target = bucket_fuels(units, bucket, fuel).filter(F.array_contains("fuels", target)).select(bucket)
    return value_counts(units.join(with_target, bucket, "left_semi"), [fuel])


def plant_bucket(name: str) -> F.Column:
    """A plant's name up to the first underscore, the bucket of a combined cycle's units."""
    return F.substring_index(clean(name), "_", 1)


def off_peak(rows: DataFrame, ts: str = "ts", *, until: int = 6) -> DataFrame:
    """Rows of the evening from the month's hour on, or of the morning."""
    starts = F.create_map(*[F.lit(x) for pair in OFF_PEAK_START.items() for x in pair])
    return rows.filter((F.hour(ts) >= F.coalesce(F.try_element_at(starts, F.month(ts)), F.lit(21))) | (F.hour(ts) <= until))


def supported(rows: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Rows whose resource also has rows an hour before and an hour after; repeated neighbours do not multiply them."""
    near = rows.select(F.col(key).alias("__k"), F.col(ts).alias("__t")).distinct()
    for shift in ("+ interval 1 hour", "- interval 1 hour"):
        rows = rows.join(near.select("__k", F.expr(f"__t {shift}").alias("__t")), (F.col(key) == F.col("__k")) & (F.col(ts) == F.col("__t")), "left_semi")
    return rows


def hour_counts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Hours and total of each resource, most hours first."""
    return rows.groupBy(key).agg(F.count("*").alias("hours"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total")).orderBy(F.desc("hours"), key)


def two_families(wide: DataFrame, ids: Sequence[str], first: Sequence[str], second: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Two families of year columns as one long table by year (the 20yy in the column's name)."""

    def long(columns: Sequence[str], name: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.regexp_extract(F.lit(c), r"(20\d{2})", 1).cast("int").alias("year"), F.col(f"`{c}`").cast("double").alias(name)) for c in columns]))
        return wide.select(*ids, pairs.alias("p")).select(*ids, "p.year", f"p.{name}")

    return long(first, names[0]).join(long(second, names[1]), [*ids, "year"])
