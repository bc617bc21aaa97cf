"""Relational building blocks; each takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltloom.functions.values import col, number
from voltloom.operators.ordering import numbered, quantiles


def resolve_columns(df: DataFrame, wanted: dict[str, Sequence[str]], *, mode: str = "exact") -> DataFrame:
    """Rename columns to the names in ``wanted``, found by any of their aliases.

    Case, spaces and a byte order mark do not matter; ``mode`` "alnum" compares
    letters and digits alone, "substring" also accepts an alias inside a name.
    All missing ones are named in the error.
    """

    def plain(name: str) -> str:
        name = name.lstrip("﻿").strip().lower()
        return "".join(ch for ch in name if ch.isalnum()) if mode != "exact" else " ".join(name.split())

    have = {plain(c): c for c in reversed(df.columns)}
    found, missing = {}, []
    for target, aliases in wanted.items():
        names = [plain(a) for a in (target, *aliases)]
        match = next((have[n] for n in names if n in have), None)
        if match is None and mode == "substring":
            match = next((have[h] for n in names for h in have if n in h), None)
        if match is None:
            missing.append(target)
        else:
            found[match] = target
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{c}`").alias(found.get(c, c)) for c in df.columns])


def reorder(df: DataFrame, first: Sequence[str] = (), *, after: tuple[str, str] | None = None) -> DataFrame:
    """Columns in ``first`` at the front; with ``after=(a, b)``, column a right behind b."""
    names = [*first, *[c for c in df.columns if c not in first]]
    if after:
        names.remove(after[0])
        names.insert(names.index(after[1]) + 1, after[0])
    return df.select(*[f"`{c}`" for c in names])


def require(df: DataFrame, columns: Sequence[str], *, blank: bool = False) -> DataFrame:
    """Rows in which none of the columns is null (or, with ``blank``, white space alone)."""
    for c in columns:
        keep = F.col(c).isNotNull()
        df = df.filter(keep & (F.trim(F.col(c).cast("string")) != "") if blank else keep)
    return df


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], *, last: bool = False) -> DataFrame:
    """One whole row for each key: the first in ``order``, or the last."""
    by = [col(o).desc() if last else col(o).asc() for o in order]
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).filter("__n = 1").drop("__n")


def value_by_order(value: str | Column, order: Sequence[str | Column], *, last: bool = False) -> Column:
    """Aggregate: the first non-null value in ``order``, or the last; combined before the shuffle."""
    at = F.when(col(value).isNotNull(), F.struct(*[col(o) for o in order]))
    return (F.max_by if last else F.min_by)(col(value), at)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in ``order``, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def shares(df: DataFrame, keys: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """The value's part of its group's sum; NULL where that is zero."""
    return df.withColumn(out, F.try_divide(F.col(value), F.sum(value).over(W.partitionBy(*keys))))


def with_total(df: DataFrame, key: str, aggregates: Sequence[Column], label: str = "ALL") -> DataFrame:
    """Aggregates for each key and for all rows, under ``label``; a null key is a group of its own."""
    made = df.groupingSets([[F.col(key)], []], F.col(key)).agg(F.grouping(key).alias("__all"), *aggregates)
    return made.withColumn(key, F.when(F.col("__all") == 1, F.lit(label)).otherwise(F.col(key).cast("string"))).drop("__all")


def sectioned(df: DataFrame, sections: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """One summary with a section for all rows and one for each column: ``section, value`` and the aggregates."""
    cols = [F.col(s) for s in sections]
    made = df.groupingSets([[], *[[c] for c in cols]], *cols).agg(F.grouping_id().alias("__set"), *aggregates)
    full = (1 << len(sections)) - 1
    section = F.when(F.col("__set") == full, "overall")
    value = F.when(F.col("__set") == full, "ALL")
    for k, s in enumerate(sections):
        mine = F.col("__set") == full - (1 << (len(sections) - 1 - k))
        section, value = section.when(mine, s), value.when(mine, F.col(s).cast("string"))
    return made.select(section.alias("section"), value.alias("value"), *[c for c in made.columns if c not in (*sections, "__set")])


def complete(df: DataFrame, domains: Sequence[DataFrame], fill: dict[str, object]) -> DataFrame:
    """Rows for every combination of the (small) domains, missing values filled."""
    grid = domains[0]
    for d in domains[1:]:
        grid = grid.crossJoin(d)
    return grid.join(df, grid.columns, "left").fillna(fill)


def domain(spark: SparkSession, name: str, values: Sequence[object]) -> DataFrame:
    """A one-column table of known values."""
    kind = "string" if isinstance(values[0], str) else "int"
    return spark.range(1).select(F.explode(F.array(*[F.lit(v).cast(kind) for v in values])).alias(name))


def calendar(df: DataFrame, ts: str, unit: str = "hour", keys: Sequence[str] = ()) -> DataFrame:
    """Every ``unit`` from the first to the last timestamp (of each key)."""
    low, high = (F.date_trunc(unit, f(ts)) for f in (F.min, F.max))
    steps = F.explode(F.sequence("__low", "__high", F.expr(f"interval 1 {unit}"))).alias(ts)
    return df.groupBy(*keys).agg(low.alias("__low"), high.alias("__high")).select(*keys, steps).withColumn(ts, F.col(ts).cast("timestamp_ntz"))


def overlay(df: DataFrame, overrides: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """``df`` with the override's value wherever it is not blank; of several overrides the last in ``order`` counts."""
    last = first_by(require(overrides, [key], blank=True), [key], [order], last=True)
    last = last.select(F.col(key).alias("__key"), *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(f"__{c}") for c in columns])
    joined = df.join(last, F.col(key) == F.col("__key"), "left")
    kinds = dict(df.dtypes)
    return joined.select(*[F.coalesce(F.col(f"__{c}").try_cast(kinds[c]), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def flag_members(df: DataFrame, other: DataFrame, left: Column, right: Column, flag: str) -> DataFrame:
    """Y or N: whether ``left`` occurs among the other table's ``right`` keys; blanks never do."""
    keys = other.select(right.alias("__member")).filter("__member <> ''").distinct()
    joined = df.withColumn("__left", left).join(keys, F.col("__left") == F.col("__member"), "left")
    return joined.withColumn(flag, F.when(F.col("__member").isNotNull(), "Y").otherwise("N")).drop("__left", "__member")


def look_up(df: DataFrame, dimension: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """Attach a dimension's value, or the default where there is none."""
    return df.join(dimension.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def unique_on(df: DataFrame, keys: Sequence[str], what: str = "keys") -> DataFrame:
    """``df``, which fails when it is read if a key occurs twice; rows without a key (null) may repeat."""
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    error = F.raise_error(F.concat(F.lit(f"{what} are not unique: "), F.to_json(F.struct(*keys)))).cast("boolean")
    return df.withColumn("__n", n).filter(F.when(known & (F.col("__n") > 1), error).otherwise(True)).drop("__n")


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", *, validate: str = "many_to_one", indicator: str | None = None) -> DataFrame:
    """A join that fails where a side that must have unique keys has not; the check runs inside the join.

    ``indicator`` names a column that says where a row comes from: ``both``,
    ``left_only`` or ``right_only``.
    """
    once = {"one_to_one": (True, True), "many_to_one": (False, True), "one_to_many": (True, False), "many_to_many": (False, False)}[validate]
    left, right = (unique_on(df, keys, f"{side} keys ({validate})") if check else df for df, check, side in zip((left, right), once, ("left", "right"), strict=True))
    if indicator is None:
        return left.join(right, list(keys), how)
    met = left.withColumn("__left", F.lit(True)).join(right.withColumn("__right", F.lit(True)), list(keys), how)
    where = F.when(F.col("__left") & F.col("__right"), "both").when(F.col("__left"), "left_only").otherwise("right_only")
    return met.withColumn(indicator, where).drop("__left", "__right")


def outer_wide(df: DataFrame, ts: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Series side by side, a column for each: one shuffle in place of a chain of outer joins."""
    return df.groupBy(ts).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, *, name: str = "name", value: str = "value", numeric: bool = True) -> DataFrame:
    """A row for each value column, missing values left out."""
    values = list(values or [c for c in df.columns if c not in ids])
    if numeric:
        df = df.select(*ids, *[number(f"`{c}`").alias(c) for c in values])
    return df.unpivot(list(ids), values, name, value).filter(F.col(value).isNotNull())


def distinct_texts(df: DataFrame, keys: Sequence[str], value: str | Column, order: str | Column, out: str, *, separator: str = " | ", limit: int | None = None) -> DataFrame:
    """For each key its distinct non-blank texts, joined in the order of their first row; the first ``limit`` of them.

    A text is brought down to its first row before the shuffle, and with a limit
    a key keeps that many texts at most, so that no group's rows are gathered.
    Keys without a text have an empty one.
    """
    rows = df.select(*keys, F.trim(col(value).cast("string")).alias("__text"), col(order).alias("__order"))
    rows = rows.withColumn("__text", F.nullif("__text", F.lit(""))).groupBy(*keys, "__text").agg(F.min("__order").alias("__order"))
    if limit:
        rows = top_k(rows, keys, [F.col("__text").isNull().cast("int"), F.col("__order"), F.col("__text")], limit, "__n")
    listed = F.array_sort(F.collect_list(F.when(F.col("__text").isNotNull(), F.struct("__order", "__text"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda r: r["__text"]), separator).alias(out))


def metric_table(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """Global aggregates as ``metric, value`` rows."""
    return df.agg(*[a.cast("double").alias(n) for n, a in aggregates.items()]).unpivot([], list(aggregates), "metric", "value")


def value_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *keys)


def histogram(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins whose width is the smaller of the Freedman-Diaconis and Sturges widths."""
    stats = df.groupBy(*keys).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    quarters = quantiles(df, keys, value, (0.25, 0.75), "__q", "__n")
    stats = stats.join(quarters, list(keys)) if keys else stats.crossJoin(F.broadcast(quarters))
    spread = F.col("__b") - F.col("__a")
    sturges, robust = spread / (F.log2("__n") + 1), 2 * (F.col("__q")[1] - F.col("__q")[0]) / F.cbrt("__n")
    stats = stats.withColumn("__bins", F.when(spread <= 0, 1).otherwise(F.ceil(spread / F.when(robust > 0, F.least(sturges, robust)).otherwise(sturges))).cast("int"))
    rows = df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))
    position = F.when(spread <= 0, 1).otherwise(F.least(F.floor((F.col(value) - F.col("__a")) / spread * F.col("__bins")) + 1, F.col("__bins"))).cast("int")
    rows = rows.filter(F.col(value).isNotNull()).withColumn("bin", position)
    step = spread / F.col("__bins")
    made = rows.groupBy(*keys, "bin", "__a", "__b", "__bins").agg(F.count("*").alias("count"))
    return made.select(*keys, "bin", (F.col("__a") + (F.col("bin") - 1) * step).alias("low"), (F.col("__a") + F.col("bin") * step).alias("high"), "count")


def duration_curve(df: DataFrame, value: str, ties: Sequence[str]) -> DataFrame:
    """Rows ranked from the largest value down, without one task ranking all; rows without a value are left out."""
    return numbered(df.filter(F.col(value).isNotNull()), [], [F.desc(value), *ties])


def reservoir(df: DataFrame, keys: Sequence[str], k: int, *, seed: int = 42, identity: Sequence[str] = ()) -> DataFrame:
    """A uniform sample of ``k`` rows of each key: those of smallest seeded MD5 of their ``identity``, so reruns agree."""
    parts = [F.col(f"`{c}`") for c in (identity or df.columns)]
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return top_k(df, keys, [drawn, *parts], k, "__n").drop("__n")
