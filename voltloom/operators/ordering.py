"""Running sums, positions and exact quantiles of any number of rows in one order.

A window over a whole group sorts it in one task. Here rows are dealt to pieces
by ranges of key and order, cut where a sample of them says, so that pieces are
about equal whatever the values are; rows that tie in the order are cut apart
too. Sums of the pieces give what stands before each, and only the inside of a
piece is sorted by a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltloom.functions.values import col
from voltloom.sources.folders import Workspace


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], amounts: Mapping[str, str | Column], *, totals: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with running sums within ``keys``, in ``order``, each row included.

    ``amounts`` names the sums; ``totals`` names columns for the whole sum of a
    key. Null keys are a group, null amounts add nothing; rows that tie in the
    order come in any.
    """
    space = Workspace(df.sparkSession, "ordering")
    by = [col(o) for o in order]
    held = df.withColumns({f"__{n}": F.coalesce(col(a), F.lit(0)) for n, a in amounts.items()}).withColumn("__tie", F.monotonically_increasing_id())
    pieces = space.settle(held.repartitionByRange(*keys, *by, "__tie").drop("__tie").withColumn("__piece", F.spark_partition_id()), "pieces")
    sums = pieces.groupBy(*keys, "__piece").agg(*[F.sum(f"__{n}").alias(f"__{n}_sum") for n in amounts])
    of_key = W.partitionBy(*keys)
    before = of_key.orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    whole = [F.sum(f"__{n}_sum").over(of_key).alias(out) for n, out in (totals or {}).items()]
    sums = sums.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__piece").alias("__at"), *whole, *[F.coalesce(F.sum(f"__{n}_sum").over(before), F.lit(0)).alias(f"__{n}_before") for n in amounts])
    same = F.col("__piece") == F.col("__at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__key{i}"))
    inside = W.partitionBy(*keys, "__piece").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    made = pieces.join(sums, same).withColumns({n: F.col(f"__{n}_before") + F.sum(f"__{n}").over(inside) for n in amounts})
    return made.select(*[f"`{c}`" for c in df.columns], *(totals or {}).values(), *amounts)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "position") -> DataFrame:
    """``df`` with gapless numbers from 1 within ``keys``, in ``order``."""
    return running(df, keys, order, {out: F.lit(1).cast("long")})


def quantiles(df: DataFrame, keys: Sequence[str], value: str, parts: Sequence[float], out: str = "q", n: str = "n") -> DataFrame:
    """Exact quantiles (an array, interpolated) and the count of non-null values of each key.

    Equal values are counted first. No group is held in a buffer, so its size
    does not matter. Keys without a value have no row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__times"))
    made = running(counts, keys, ["__v"], {"__upto": "__times"}, totals={"__upto": n})
    picked = []
    for i, part in enumerate(parts):
        at = F.lit(float(part)) * (F.col(n) - 1)
        # the value at a place is the smallest with more values up to it
        picked += [F.min(F.when(F.col("__upto") > f(at), F.col("__v"))).alias(f"__{name}{i}") for name, f in (("low", F.floor), ("high", F.ceil))]
    found = made.groupBy(*keys).agg(F.first(n).alias(n), *picked)

    def between(i: int, part: float) -> Column:
        at = F.lit(float(part)) * (F.col(n) - 1)
        low, high = F.col(f"__low{i}"), F.col(f"__high{i}")
        return F.when(F.floor(at) == F.ceil(at), low.cast("double")).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*keys, n, F.array(*[between(i, p) for i, p in enumerate(parts)]).alias(out))


def side_by_side(left: DataFrame, right: DataFrame, left_order: Sequence[str | Column], right_order: Sequence[str | Column], *, pad: bool = True) -> DataFrame:
    """Rows of two tables beside each other by position, each in its own order.

    The shorter table is padded with nulls; with ``pad=False`` different lengths
    are an error. ``position`` counts from 1.
    """
    a, b = (numbered(df, [], order, "__position") for df, order in ((left, left_order), (right, right_order)))
    twice = set(left.columns) & set(right.columns)
    if twice:
        raise ValueError(f"both tables have {sorted(twice)}")
    b = b.withColumnRenamed("__position", "__other")
    met = a.join(b, F.col("__position") == F.col("__other"), "full")
    position = F.coalesce("__position", "__other")
    if not pad:
        alone = F.col("__position").isNull() | F.col("__other").isNull()
        position = F.when(alone, F.raise_error(F.concat(F.lit("tables differ in length at row "), position)).cast("long")).otherwise(position)
    return met.select(position.alias("position"), *[f"`{c}`" for c in (*left.columns, *right.columns)])
