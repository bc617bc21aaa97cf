"""Ranks within groups by a distributed counting sort.

Lines are ranked by a pair of integers that many lines share. Each slice of the
input counts its lines by group and pair: a row of the count matrix. Inside a
slice the counts are cut where a group's lines before a pair reach the number
of places asked for, since what comes later has no place in the whole table
either. Column sums and their exclusive prefix sums allocate every pair's slots.

A group of few lines in a slice sends its uncut lines as cells of one; of other
groups counts travel and their uncut lines wait. All cells are summed by group
and pair, combined before the shuffle, and only a group's first pairs, as many
as places, can have a place: they are picked before and after the shuffle, so a
group brings no more than that from each task. Lines then join their surviving
pairs, those of heavy groups salted. A pair of few lines is numbered where it
stands; lines of the others are scattered into buckets cut by ranges of the
whole sort key, and a second count matrix, of bucket pieces by pair, gives each
piece its first slot. So neither a group nor a pair of any size meets in one
task, whether its lines crowd a slice or lie thinly over all of them, and
nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltloom.llm.durable import Workspace

#: Lines of a slice, a row of the count matrix.
SLICE_LINES = 1 << 19
#: Lines of a group in a slice up to which they travel themselves.
LIGHT = 32
#: Parts into which the lines of a pair are dealt where they learn its slots.
SALTS = 64
#: Lines of a pair up to which one task numbers them.
SMALL_PAIR = 1 << 10
#: What a row of the matrix is: a line that travels, a count of lines, a line that waits.
_LINE, _COUNT, _WAITS = 0, 1, 2


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows differ from the row before; the first row does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _count_slice(table: pa.Table, group: list[str], pair: list[str], order: list[str], places: int, light: int) -> pa.Table:
    """The cells of a slice that can have a place, as counts or as lines."""
    held = [table[c].to_numpy() for c in group + pair]
    varying = [c for c in held if len(c) and (c != c[0]).any()]
    by = np.lexsort(varying[::-1]) if varying else np.arange(table.num_rows)
    held = [c[by] for c in held]
    starts_group = _runs(held[: len(group)])
    starts_cell = starts_group | _runs(held[len(group) :])
    cell_at, group_at = np.flatnonzero(starts_cell), np.flatnonzero(starts_group)
    cell_n = np.diff(np.append(cell_at, len(by)))
    group_n = np.diff(np.append(group_at, len(by)))
    group_of_cell = np.cumsum(starts_group)[cell_at] - 1
    kept = cell_at - group_at[group_of_cell] < places  # the group's lines before the cell
    small = group_n[group_of_cell] <= light
    lines, waiting = by[np.repeat(kept & small, cell_n)], by[np.repeat(kept & ~small, cell_n)]
    counts = by[cell_at[kept & ~small]]
    picked = table.take(pa.array(np.concatenate([lines, counts, waiting])))
    kind = np.repeat([_LINE, _COUNT, _WAITS], [len(lines), len(counts), len(waiting)]).astype(np.int32)
    weight = np.ones(len(kind), np.int64)
    weight[kind == _COUNT] = cell_n[kept & ~small]
    alone = pa.array(kind != _COUNT)
    cells = {c: picked[c] for c in group + pair} | {"weight": pa.array(weight), "kind": pa.array(kind)}
    return pa.table(cells | {c: pa.compute.if_else(alone, picked[c], pa.scalar(None, pa.int64())) for c in order})


def top_places(lines: DataFrame, *, group: list[str], pair: list[str], order: list[str], places: int = 3, slice_lines: int = SLICE_LINES, light: int = LIGHT, small_pair: int = SMALL_PAIR) -> DataFrame:
    """The lines with a place of at most ``places`` within their group.

    All columns named are integral. Pairs rank in ascending order of the
    ``pair`` columns, nulls first and equal to each other; lines of one pair
    tie. Returns the columns of ``group``, ``pair`` and ``order`` (as long),
    ``place`` (1 + the group's lines of earlier pairs), ``pos`` (the line's
    number in the group by pair, then by ``order``, nulls last) and ``tied``
    (the group's lines of its pair), one row for every surviving line. A null in
    a group column is a value of its own; equal lines are lines of their own and
    get different ``pos``; an empty table gives an empty one; other columns of
    the input, whatever their names, are not read.
    """
    space = Workspace(lines.sparkSession, "ranking")
    named = [*[(f"g{i}", c) for i, c in enumerate(group)], *[(f"p{i}", c) for i, c in enumerate(pair)]]
    # beside each key its flag of nulls (0 sorts first), so that keys themselves are never null
    flagged = [F.when(F.col(c).isNull(), 0).otherwise(1).cast("long").alias(f"{k}f") for k, c in named]
    keys = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(k) for k, c in named]
    k_names = [f"k{i}" for i in range(len(order))]
    slim = lines.select(*flagged, *keys, *[F.col(c).cast("long").alias(k) for k, c in zip(k_names, order, strict=True)])
    g = [x for k, _ in named[: len(group)] for x in (f"{k}f", k)]
    p = [x for k, _ in named[len(group) :] for x in (f"{k}f", k)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= slice_lines:
                yield from _count_slice(pa.Table.from_batches(held), g, p, k_names, places, light).to_batches()
                held, n = [], 0
        if n:
            yield from _count_slice(pa.Table.from_batches(held), g, p, k_names, places, light).to_batches()

    schema = ", ".join([*[f"{c} long" for c in g + p], "weight long", "kind int", *[f"{c} long" for c in k_names]])
    # a second run might slice the table otherwise, so what this one says is kept
    matrix = space.settle(slim.mapInArrow(count, schema), "matrix")
    sums = matrix.filter(F.col("kind") != _WAITS).groupBy(*g, *p).agg(F.sum("weight").alias("tied"), F.max(F.col("kind") == _COUNT).alias("heavy"))
    in_group, in_pair = W.partitionBy(*g).orderBy(*p), W.partitionBy(*g, *p)
    by_key = [F.col(c).asc_nulls_last() for c in k_names]
    # every pair has a line, so only the first ones can have a place
    firsts = sums.withColumn("nth", F.row_number().over(in_group)).filter(F.col("nth") <= places).drop("nth")
    place = F.coalesce(F.sum("tied").over(in_group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")) + 1
    slots = space.settle(firsts.withColumn("place", place).filter(F.col("place") <= places), "slots")

    alone = matrix.filter(F.col("kind") != _COUNT).drop("weight").withColumn("row", F.monotonically_increasing_id())
    salted = slots.filter("heavy").drop("heavy").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    waiting = alone.filter(F.col("kind") == _WAITS).withColumn("salt", F.col("row") % SALTS).join(salted.hint("merge"), [*g, *p, "salt"]).drop("salt", "kind")
    sent = alone.filter(F.col("kind") == _LINE).drop("kind").join(slots.drop("heavy").hint("merge"), [*g, *p])
    # written before it is grouped by pair, so that a skewed part of these joins can be split
    placed = space.settle(waiting.unionByName(sent), "placed")
    small = placed.filter(F.col("tied") <= small_pair)
    at_hand = small.withColumn("pos", F.col("place") + F.row_number().over(in_pair.orderBy(*by_key)) - 1)
    scattered = placed.filter(F.col("tied") > small_pair).repartitionByRange(*g, *p, *by_key, "row")
    pieces = space.settle(scattered.withColumn("piece", F.spark_partition_id()), "pieces")
    per_piece = pieces.groupBy(*g, *p, "piece").agg(F.count("*").alias("n"))
    before = in_pair.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    per_piece = per_piece.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")
    in_piece = W.partitionBy(*g, *p, "piece").orderBy(*by_key)
    sorted_pieces = pieces.join(per_piece.hint("merge"), [*g, *p, "piece"]).withColumn("pos", F.col("place") + F.col("before") + F.row_number().over(in_piece) - 1)

    result = [F.when(F.col(f"{k}f") == 1, F.col(k)).alias(c) for k, c in named] + [F.col(k).alias(c) for k, c in zip(k_names, order, strict=True)]
    result += [F.col("place"), F.col("pos").cast("long").alias("pos"), F.col("tied")]
    return at_hand.select(*result).unionByName(sorted_pieces.select(*result))


def _cents(value: str) -> F.Column:
    """Hundredths, rounded half up; what is not a finite number has none."""
    v = F.col(value).cast("double")
    return F.when(F.abs(v) < F.lit(9e16), F.floor(F.lit(100.0) * v + F.lit(0.5)).cast("long"))


def rank_sale_lines(lines: DataFrame, *, places: int = 3, **options: int) -> DataFrame:
    """Places of sale lines by vendor, part (item modulo ten) and month.

    Lines of a sale id whose decimal text has a CRC-32 divisible by 5 form one
    group of their own (-1, -1, -1). Pairs are the tens of the quantity, larger
    first, and the rounded percent of the discount, smaller first, both with
    nulls first. Amounts and discounts that are not finite count as null. Null
    items and dates give part and month -1; a null vendor is a vendor.
    """
    apart = F.col("sale_id").isNotNull() & (F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0)
    quantity = F.col("quantity").cast("long")
    named = lines.select(
        F.when(apart, F.lit(-1)).otherwise(F.col("vendor_id")).cast("long").alias("vendor_id"),
        F.when(apart | F.col("item_id").isNull(), F.lit(-1)).otherwise(F.pmod("item_id", F.lit(10))).cast("long").alias("part"),
        F.when(apart | F.col("shipped_at").isNull(), F.lit(-1)).otherwise(100 * F.year("shipped_at") + F.month("shipped_at")).cast("long").alias("month"),
        F.floor((F.pmod(quantity, F.lit(10)) - quantity) / 10).cast("long").alias("fewer_tens"),
        _cents("discount").alias("percent"),
        "sale_id", "line_no", "quantity",
        _cents("amount").alias("amount_cents"),
    )
    ranked = top_places(named, group=["vendor_id", "part", "month"], pair=["fewer_tens", "percent"], order=["sale_id", "line_no", "quantity", "amount_cents"], places=places, **options)
    return ranked.select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


#: DuckDB SQL for the same rows, over the registered view ``sale_lines``. The
#: CRC-32 is computed bit by bit from its polynomial, once for each sale id.
SQL = """
WITH ids AS (
  SELECT sale_id, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, byte: list_reduce(
             list_prepend(xor(crc, byte), range(8)),
             lambda r, i: CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END))) % 5 = 0 AS apart
  FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL)),
lines AS (
  SELECT CASE WHEN apart THEN -1 ELSE vendor_id END::BIGINT AS vendor_id,
         CASE WHEN apart OR item_id IS NULL THEN -1 ELSE (item_id % 10 + 10) % 10 END::BIGINT AS part,
         CASE WHEN apart OR shipped_at IS NULL THEN -1 ELSE 100 * year(shipped_at) + month(shipped_at) END::BIGINT AS month,
         s.sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS quantity,
         floor(quantity::DOUBLE / 10)::BIGINT AS tens,
         CASE WHEN isfinite(discount) THEN floor(100 * discount + 0.5)::BIGINT END AS percent,
         CASE WHEN isfinite(amount) THEN floor(100 * amount + 0.5)::BIGINT END AS amount_cents
  FROM sale_lines s LEFT JOIN ids ON s.sale_id = ids.sale_id),
ranked AS (
  SELECT *, rank() OVER grouped AS place, count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied,
         row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent NULLS FIRST,
           sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos
  FROM lines WINDOW grouped AS (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent NULLS FIRST))
SELECT vendor_id, part, month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied FROM ranked WHERE place <= 3
"""
