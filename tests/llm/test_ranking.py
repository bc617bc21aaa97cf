"""Places by counting sort against plain sorting."""

import random
import zlib
from collections import defaultdict
from datetime import datetime

import pytest

from voltloom.llm import ranking

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, place string, weight string, g0 string"
NONE = (None,) * 12


def brute(rows, places=3):
    groups = defaultdict(list)
    for sale, line, item, vendor, quantity, amount, discount, _, shipped, *_ in rows:
        apart = sale is not None and zlib.crc32(str(sale).encode()) % 5 == 0
        key = (-1, -1, -1) if apart else (vendor, -1 if item is None else item % 10, -1 if shipped is None else 100 * shipped.year + shipped.month)
        cents = [None if v is None or v != v or abs(v) == float("inf") else int((100 * v + 0.5) // 1) for v in (discount, amount)]
        pair = tuple((v is not None, v or 0) for v in (None if quantity is None else -(quantity // 10), cents[0]))
        groups[key].append((pair, tuple((v is None, v or 0) for v in (sale, line, quantity, cents[1])), (sale, line, quantity, cents[0], cents[1])))
    out = []
    for key, lines in groups.items():
        lines.sort(key=lambda x: x[:2])
        for pos, (pair, _, kept) in enumerate(lines, 1):
            place = 1 + sum(x[0] < pair for x in lines)
            if place <= places:
                out.append((*key, pos, place, *kept, sum(x[0] == pair for x in lines)))
    return sorted(out, key=str)


def sales(n, seed, vendors=6, sales=40, quantities=(1, 5, 12, 37, None), discounts=(0.0, 0.01, 0.02, None, float("nan"))):
    r = random.Random(seed)
    days = [datetime(2024, m, d) for m in (1, 2) for d in (1, 28)] + [None]
    rows = [(r.choice([None, *range(sales)]), r.choice([None, 1, 2]), r.choice([None, 3, 13, 21]), r.choice([None, 0, *range(vendors)]), r.choice(quantities), r.choice([None, 1.005, 2.5, float("inf"), -3.25]), r.choice(discounts), "x", r.choice(days), "a", "b", "c") for _ in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize(("slice_lines", "light", "small_pair"), [(1 << 19, 32, 1024), (70, 2, 1024), (70, 2, 3), (70, 0, 0), (1000, 1, 1), (5, 32, 4)])
def test_places_against_sorting(spark, slice_lines, light, small_pair):
    rows = [*sales(900, 1), NONE]
    got = ranking.rank_sale_lines(spark.createDataFrame(rows, LINES).repartition(5), slice_lines=slice_lines, light=light, small_pair=small_pair)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_pair_with_most_rows_in_pieces(spark):
    hot = [(5, 1, 3, 7, 45, 1.0, 0.0, "x", datetime(2024, 3, 1), "a", "b", "c")] * 4000
    hot += [(i, 1, 3, 7, 45, 1.0, 0.0, "x", datetime(2024, 3, 1), "a", "b", "c") for i in range(2000)]
    rows = hot + sales(300, 2)
    got = ranking.rank_sale_lines(spark.createDataFrame(rows, LINES).repartition(6), slice_lines=256, light=8)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_a_group_thin_in_every_slice(spark):
    # no slice counts it: all its lines travel alone, and its pair is still cut into pieces
    rows = [(i, 1, 3, 7, 45, 1.0, 0.0, "x", datetime(2024, 3, 1), "a", "b", "c") for i in range(3000)] + sales(300, 4)
    got = ranking.rank_sale_lines(spark.createDataFrame(rows, LINES).repartition(6), slice_lines=20, light=32, small_pair=50)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_picked_before_the_shuffle(spark, capsys):
    lines = spark.createDataFrame([(k % 5, k % 700, k) for k in range(2000)], "g long, p long, k long")
    seen = []

    class Seen(ranking.Workspace):
        def settle(self, df, label):
            df.explain()
            seen.append((label, capsys.readouterr().out))
            return super().settle(df, label)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ranking, "Workspace", Seen)
        ranking.top_places(lines, group=["g"], pair=["p"], order=["k"]).count()
    plan = dict(seen)["slots"]
    assert "WindowGroupLimit" in plan and "Partial" in plan and not any("Broadcast" in text for _, text in seen)


def test_fewer_places_and_empty_table(spark):
    rows = sales(200, 3)
    assert sorted(map(tuple, ranking.rank_sale_lines(spark.createDataFrame(rows, LINES), places=1).collect()), key=str) == brute(rows, 1)
    assert ranking.rank_sale_lines(spark.createDataFrame([], LINES)).count() == 0


def test_own_columns(spark):
    rows = spark.createDataFrame([("a", None, 1), ("b", 2, None), ("c", 2, 3), ("d", 2, 3)], "name string, kind int, n int")
    ranked = ranking.top_places(rows.selectExpr("name", "kind", "n", "n as at"), group=["kind"], pair=["n"], order=["at"])
    assert sorted((r["kind"] or 0, r["pos"], r["place"], r["tied"]) for r in ranked.collect()) == [(0, 1, 1, 1), (2, 1, 1, 1), (2, 2, 2, 2), (2, 3, 2, 2)]
