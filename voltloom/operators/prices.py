"""Price series: settlement rows, hour and month profiles, spreads, errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.functions.values import hour_ending, hour_start, interval_start, number
from voltloom.operators.frames import calendar, complete, domain, require


def settlement_rows(raw: DataFrame) -> DataFrame:
    """Typed rows ``node, node_type, ts, price, repeated`` from delivery date, hour ending and quarter hour."""
    day = F.to_date(F.col("Delivery Date"), "MM/dd/yyyy")
    rows = require(raw, ["Settlement Point Name"], blank=True)
    return rows.select(
        F.trim("Settlement Point Name").alias("node"),
        F.col("Settlement Point Type").alias("node_type"),
        interval_start(day, "Delivery Hour", "Delivery Interval").alias("ts"),
        number("Settlement Point Price").alias("price"),
        (F.upper(F.trim("Repeated Hour Flag")) == "Y").alias("repeated"),
    )


def hourly_means(prices: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    return prices.groupBy(*keys, hour_start("ts").alias("ts")).agg(F.avg("price").alias("price"))


def month_hour_means(prices: DataFrame, keys: Sequence[str] = ("node",), *, by_year: bool = False) -> DataFrame:
    """Mean by month and hour ending of the means of each hour: a mean of means, not of all rows."""
    hourly = hourly_means(prices, keys)
    year = [F.year("ts").alias("year")] if by_year else []
    return hourly.groupBy(*keys, *year, F.month("ts").alias("month"), hour_ending("ts").alias("hour")).agg(F.avg("price").alias("price"))


def heatmap(means: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    """A row for each month 1-12, a column for each hour 1-24; only here is it wide."""
    spark = means.sparkSession
    wide = means.groupBy(*keys, "month").pivot("hour", list(range(1, 25))).agg(F.first("price"))
    return complete(wide, [means.select(*keys).distinct(), domain(spark, "month", range(1, 13))], {})


def value_range(means: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Least and greatest mean, the common scale of several heatmaps."""
    return means.groupBy(*keys).agg(F.min("price").alias("low"), F.max("price").alias("high"))


def spread(prices: DataFrame, left: str, right: str, node: str = "node") -> DataFrame:
    """Difference of two nodes at each timestamp; a timestamp that repeats gives every combination."""
    a, b = (prices.filter(F.col(node) == n).select("ts", F.col("price").alias(p)) for n, p in ((left, "left_price"), (right, "right_price")))
    return a.join(b, "ts").withColumn("spread", F.col("left_price") - F.col("right_price"))


def monthly_averages(prices: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    """Monthly mean of hourly means, with the month's first day."""
    month = F.make_date(F.year("ts"), F.month("ts"), F.lit(1)).alias("month")
    return hourly_means(prices, keys).groupBy(*keys, month).agg(F.avg("price").alias("price"))


def monthly_errors(averages: DataFrame, left: str, right: str, node: str = "node") -> DataFrame:
    """Absolute and percentage error of two nodes' monthly averages; no percentage of a zero."""
    a, b = (averages.filter(F.col(node) == n).select("month", F.col("price").alias(p)) for n, p in ((left, "left_price"), (right, "right_price")))
    gap = F.abs(F.col("left_price") - F.col("right_price"))
    return a.join(b, "month").withColumn("mae", gap).withColumn("mape", F.try_divide(gap, F.abs("right_price")) * 100)


def error_summary(errors: DataFrame) -> DataFrame:
    """Mean errors of each year and over all (year NULL)."""
    rows = errors.withColumn("year", F.year("month"))
    made = rows.groupingSets([[F.col("year")], []], F.col("year")).agg(F.avg("mae").alias("mae"), F.avg("mape").alias("mape"), F.count("*").alias("months"))
    return made


def hourly_resample(series: DataFrame, values: Sequence[str], ts: str = "ts") -> DataFrame:
    """Hourly means of the columns from the first hour to the last; hours without rows are there, empty."""
    means = series.groupBy(hour_start(ts).alias(ts)).agg(*[F.avg(v).alias(v) for v in values])
    return calendar(series, ts).join(means, ts, "left")


def day_profile(series: DataFrame, day: str, value: str = "price", ts: str = "ts") -> DataFrame:
    """Hourly means of one day in each year (``day`` is month-day), all 24 hours of years that have it."""
    rows = series.filter(F.date_format(ts, "MM-dd") == day).groupBy(F.year(ts).alias("year"), F.hour(ts).alias("hour")).agg(F.avg(value).alias(value))
    return complete(rows, [rows.select("year").distinct(), domain(series.sparkSession, "hour", range(24))], {})
