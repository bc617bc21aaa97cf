"""Offer curves: long rows ``resource_type, resource_name, ts, step, mw, price`` with ``hsl`` and ``bp`` of the (resource, ts)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltloom.functions.values import finite, hour_ending, hour_start, ratio, total, weighted_mean
from voltloom.operators.frames import domain, first_by
from voltloom.operators.ordering import quantiles, running

UNIT = ["resource_type", "resource_name"]
CELL = [*UNIT, "ts"]


def assemble(mw: DataFrame, price: DataFrame, hsl: DataFrame, bp: DataFrame | None = None) -> DataFrame:
    """Join metric tables (each ``CELL`` and ``value``, steps where they have them) to curve rows; null keys meet nothing.

    Cells meet before they meet steps. Each join looks its right side up, a
    shuffled partition at a time, so that neither side is sorted.
    """
    cells = hsl.withColumnRenamed("value", "hsl")
    if bp is not None:
        cells = cells.join(bp.withColumnRenamed("value", "bp").hint("shuffle_hash"), CELL, "left")
    made = mw.withColumnRenamed("value", "mw").join(price.withColumnRenamed("value", "price").hint("shuffle_hash"), [*CELL, "step"])
    return made.join(cells.hint("shuffle_hash"), CELL)


def offer_profile(curves: DataFrame, by: Sequence[str] = ("month", "hour", "step", "resource_type")) -> DataFrame:
    """Mean fraction of the limit offered, and mean price, by step and type and any of month and hour."""
    rows = curves.withColumns({"month": F.month("ts"), "hour": F.hour("ts"), "fraction": F.when(F.col("hsl") > 0, F.col("mw") / F.col("hsl"))})
    return rows.groupBy(*by).agg(F.avg(finite("fraction")).alias("mw_fraction"), F.avg(finite("price")).alias("price"), F.count(finite("fraction")).alias("n"))


def hourly_by_type(series: DataFrame, *, mode: str = "mw", minutes: int = 5) -> DataFrame:
    """Hourly mean of the type's totals ("mw"), or their energy ("mwh")."""
    totals = series.groupBy("resource_type", "ts").agg(total("value").alias("value"))
    value = F.avg("value") if mode == "mw" else F.sum("value") * minutes / 60
    return totals.groupBy("resource_type", hour_start("ts").alias("hour")).agg(value.alias(mode))


def dispatch_error(actual: DataFrame, planned: DataFrame) -> DataFrame:
    """Finite differences of two metrics of the same (resource, ts)."""
    joined = actual.withColumnRenamed("value", "__a").join(planned.withColumnRenamed("value", "__p"), CELL)
    return joined.select(*CELL, finite(F.col("__a") - F.col("__p")).alias("error")).filter("error is not null")


def hour_of_day(series: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Mean total by hour 0-23, hours without rows included."""
    rows = series.filter(F.lower("resource_type").isin([t.lower() for t in types])) if types else series
    totals = rows.groupBy("ts").agg(total("value").alias("value")).groupBy(F.hour("ts").alias("hour")).agg(F.avg("value").alias("value"))
    return domain(series.sparkSession, "hour", range(24)).join(totals, "hour", "left")


def mask_idle(curves: DataFrame) -> DataFrame:
    """Without MW and price where the base point is zero, nor resources whose base point is zero throughout."""
    idle = F.coalesce(F.col("bp") == 0, F.lit(False))
    ever = F.max(F.when(F.col("bp") != 0, 1)).over(W.partitionBy(*UNIT))
    some = F.max(F.when(F.col("bp").isNotNull(), 1)).over(W.partitionBy(*UNIT))
    rows = curves.withColumn("__ever", F.coalesce(ever, 1 - some, F.lit(1))).filter("__ever = 1").drop("__ever")
    return rows.withColumns({c: F.when(~idle, F.col(c)) for c in ("mw", "price", "hsl")} | {"bp": F.when(~idle, F.col("bp"))}).filter("mw is not null or price is not null")


def _common(curves: DataFrame) -> DataFrame:
    """Rows whose resource and whose timestamp occur in all of the type's steps."""
    steps = curves.groupBy("resource_type").agg(F.countDistinct("step").alias("__all"))
    units = curves.groupBy(*UNIT).agg(F.countDistinct("step").alias("__n")).join(F.broadcast(steps), "resource_type").filter("__n = __all").select(*UNIT)
    times = curves.groupBy("resource_type", "ts").agg(F.countDistinct("step").alias("__n")).join(F.broadcast(steps), "resource_type").filter("__n = __all").select("resource_type", "ts")
    return curves.join(units, UNIT, "left_semi").join(times, ["resource_type", "ts"], "left_semi")


def representative_quantities(curves: DataFrame, *, masked: bool = False) -> DataFrame:
    """A type's typical curve: mean share of each resource's largest MW, times the mean of those, per timestamp, then over time.

    ``masked`` leaves cells of zero base point out. Base point and limit are
    scaled alike. A largest MW of zero gives no share.
    """
    rows = _common(mask_idle(curves) if masked else curves)
    rows = rows.withColumn("top", F.max("mw").over(W.partitionBy(*CELL)))
    rows = rows.withColumns({f"n_{c}": ratio(c, "top") for c in ("mw", "bp", "hsl")})
    per_ts = rows.groupBy("resource_type", "step", "ts").agg(*[(F.avg(f"n_{c}") * F.avg("top")).alias(c) for c in ("mw", "bp", "hsl")])
    return per_ts.groupBy("resource_type", "step").agg(*[F.avg(c).alias(c) for c in ("mw", "bp", "hsl")])


def representative_prices(curves: DataFrame, *, masked: bool = False) -> DataFrame:
    """A type's typical price by step: mean over resources, then over time."""
    rows = _common(mask_idle(curves) if masked else curves)
    return rows.groupBy("resource_type", "step", "ts").agg(F.avg("price").alias("price")).groupBy("resource_type", "step").agg(F.avg("price").alias("price"))


def typical_bid(quantities: DataFrame, prices: DataFrame, market: DataFrame, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bid price of each type (that of the largest MW below the base point) beside the market's mean and deviation."""
    joined = quantities.join(prices, ["resource_type", "step"])
    bid = joined.groupBy("resource_type").agg(
        F.avg("bp").alias("bp"), F.avg("hsl").alias("hsl"), F.max_by("price", F.when(F.col("mw") <= F.col("bp"), F.struct("mw", -F.col("step")))).alias("bid_price")
    )
    rows = market.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end))) if start else market
    return bid.crossJoin(F.broadcast(rows.agg(F.avg("price").alias("market_mean"), F.stddev_pop("price").alias("market_std"))))


def marginal_unit(curves: DataFrame, keys: Sequence[str] = ("resource_type",), *, tolerance: float = 0.0) -> DataFrame:
    """The unit whose offer first lifts supply above the total base point.

    Steps are increments: their totals are added until they exceed the base
    points' sum; within that step units come by price (then name and time), from
    the supply of the steps before. With ``ts`` among the keys it is per
    interval. Groups whose supply never exceeds it have no row.
    """
    keys = list(keys)
    base = curves.select(*{*keys, *CELL}, "bp").distinct().groupBy(*keys).agg(F.sum("bp").alias("total_bp"))
    steps = curves.groupBy(*keys, "step").agg(F.sum("mw").alias("step_mw"))
    upto = W.partitionBy(*keys).orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = steps.withColumn("until", F.sum("step_mw").over(upto)).join(base, keys).filter(F.col("until") > F.col("total_bp") + tolerance)
    target = first_by(steps, keys, ["step"]).select(*keys, "step", "total_bp", (F.col("until") - F.col("step_mw")).alias("before_step"))
    rows = curves.join(target, [*keys, "step"]).filter("mw is not null and price is not null")
    rows = running(rows, keys, ["price", "resource_name", "ts"], {"cumulative": "mw"})
    rows = rows.withColumn("cumulative", F.col("before_step") + F.col("cumulative")).filter(F.col("cumulative") > F.col("total_bp") + tolerance)
    extra = [c for c in ("resource_name", "ts") if c not in keys]
    kept = ["total_bp", "step", *extra, "price", "mw", "cumulative"]
    found = rows.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct("cumulative", "price", "resource_name", "ts")).alias("__s")).select(*keys, "__s.*")
    return found.select(*keys, "total_bp", "step", *extra, "price", "mw", (F.col("cumulative") - F.col("mw")).alias("cumulative_before"))


def hourly_supply(curves: DataFrame) -> DataFrame:
    """Supply by type, hour ending and step: cumulative MW of each (resource, ts), and the price weighted by it."""
    upto = W.partitionBy(*CELL).orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = curves.withColumn("cumulative", F.sum("mw").over(upto))
    return rows.groupBy("resource_type", hour_ending("ts").alias("hour"), "step").agg(F.sum("cumulative").alias("mw"), weighted_mean("price", "cumulative").alias("price"))


def price_quartiles(curves: DataFrame, *, least: int = 5) -> DataFrame:
    """Exact quartiles of price by step and type with enough values."""
    made = quantiles(curves, ["resource_type", "step"], "price", (0.25, 0.5, 0.75))
    return made.filter(F.col("n") >= least).select("resource_type", "step", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "n")


def normalised_levels(curves: DataFrame) -> DataFrame:
    """Mean and quartiles by type and step of MW over the row's largest value (limit and base point count), rescaled.

    The scale is the sum over resources of their mean largest value, so the
    levels are those of the type's whole fleet.
    """
    top = F.greatest(F.max("mw").over(W.partitionBy(*CELL)), "hsl", "bp")
    rows = curves.withColumn("top", F.when(top > 0, top)).withColumns({f"n_{c}": ratio(c, "top") for c in ("mw", "hsl", "bp")})
    scale = rows.groupBy(*CELL).agg(F.max("top").alias("top")).groupBy(*UNIT).agg(F.avg("top").alias("top")).groupBy("resource_type").agg(F.sum("top").alias("scale"))
    quarters = quantiles(rows, ["resource_type", "step"], "n_mw", (0.25, 0.75))
    made = rows.groupBy("resource_type", "step").agg(F.avg("n_mw").alias("mean"), F.avg("n_hsl").alias("hsl"), F.avg("n_bp").alias("bp"))
    made = made.join(quarters, ["resource_type", "step"], "left").join(scale, "resource_type")
    return made.select("resource_type", "step", *[(c * F.col("scale")).alias(n) for n, c in (("mean", F.col("mean")), ("q25", F.col("q")[0]), ("q75", F.col("q")[1]), ("hsl", F.col("hsl")), ("bp", F.col("bp")))])


def strict_fraction(mw: DataFrame, hsl: DataFrame) -> DataFrame:
    """MW over the limit where both are known and the limit is positive, by (resource, ts, step); with its mean of means by type."""
    rows = mw.withColumnRenamed("value", "mw").join(hsl.withColumnRenamed("value", "hsl"), CELL).filter("hsl > 0").withColumn("fraction", F.col("mw") / F.col("hsl"))
    per_unit = rows.groupBy(*UNIT, "step").agg(F.avg("fraction").alias("fraction"))
    return per_unit.groupBy("resource_type", "step").agg(F.avg("fraction").alias("fraction"))


def average_without_first(curves: DataFrame) -> DataFrame:
    """Mean MW by type, the lowest step left out."""
    by_step = curves.groupBy("resource_type", "step").agg(F.sum("mw").alias("mw"), F.count("mw").alias("n"))
    lowest = F.min("step").over(W.partitionBy("resource_type"))
    return by_step.withColumn("__low", lowest).filter("step > __low").groupBy("resource_type").agg(F.try_divide(F.sum("mw"), F.sum("n")).alias("mw"))


def price_against_mw(quantities: DataFrame, prices: DataFrame) -> DataFrame:
    """Price and MW of the steps that both have."""
    return quantities.select("resource_type", "step", "mw").join(prices.select("resource_type", "step", "price"), ["resource_type", "step"])


def active_by_step(curves: DataFrame, value: str = "mw") -> DataFrame:
    """Resources with any finite value, by type and step."""
    units = curves.groupBy(*UNIT, "step").agg(F.max(F.when(finite(value).isNotNull(), 1).otherwise(0)).alias("on"))
    return units.groupBy("resource_type", "step").agg(F.sum("on").alias("active"))


def coverage_counts(curves: DataFrame) -> DataFrame:
    """Rows, resources and timestamps by type: what a selection leaves to analyse."""
    return curves.groupBy("resource_type").agg(F.count("*").alias("rows"), F.countDistinct("resource_name").alias("resources"), F.countDistinct("ts").alias("timestamps"))
