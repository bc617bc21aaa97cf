"""Orders of many rows against plain sorting: outliers, ties, null keys and values, uneven lengths."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.operators import curves, frames, linkage, ordering


def test_running_sums_with_an_outlier_and_ties(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([1.0, 1.0, r.random(), None]), i, float(r.randint(0, 5))) for i in range(3000)] + [("a", 1e9, -1, 2.0)]
    got = ordering.running(spark.createDataFrame(rows, "k string, v double, i int, x double").repartition(5), ["k"], ["v", "i"], {"upto": "x", "n": F.lit(1)}, totals={"upto": "all"})
    want, sums = {}, defaultdict(float)
    for k, v, i, x in sorted(rows, key=lambda t: (t[0] or "", t[1] is not None, t[1] or 0, t[2])):
        sums[k] += x
        want[i] = (sums[k],)
    seen = {row["i"]: row for row in got.collect()}
    assert {i: (row["upto"],) for i, row in seen.items()} == want
    assert all(row["all"] == sums[row["k"]] for row in seen.values())


def test_pieces_stay_even_with_an_outlier(spark):
    rows = spark.range(20_000).select((F.col("id") % 7).cast("double").alias("v"), "id").union(spark.sql("select 1e9D, -1L"))
    pieces = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(8, "v", "tie").groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in pieces.collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 20_001 / 8
    placed = frames.duration_curve(rows.withColumnRenamed("v", "value"), "value", ["id"])
    assert sorted(r["position"] for r in placed.collect()) == list(range(1, 20_002))
    assert placed.filter("position = 1").first()["value"] == 1e9


def test_quantiles_equal_the_whole_sort(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([r.gauss(0, 1), 0.5, None])) for _ in range(2000)] + [("one", 3.0), ("none", None)]
    parts = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {row["k"]: (row["n"], row["q"]) for row in ordering.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", parts).collect()}
    for k in ("a", "b", None, "one"):
        held = [v for key, v in rows if key == k and v is not None]
        assert got[k][0] == len(held)
        assert got[k][1] == pytest.approx(np.quantile(held, parts).tolist(), abs=1e-12)
    assert "none" not in got


def test_side_by_side(spark):
    left, right = spark.createDataFrame([(3,), (1,), (2,)], "a int"), spark.createDataFrame([("x",), ("y",)], "b string")
    got = ordering.side_by_side(left, right, ["a"], [F.desc("b")])
    assert sorted(map(tuple, got.collect())) == [(1, 1, "y"), (2, 2, "x"), (3, 3, None)]
    with pytest.raises(Exception, match="differ in length"):
        ordering.side_by_side(left, right, ["a"], ["b"], pad=False).collect()


def greedy(pairs):
    done, taken = {}, set()
    for s, a, b in sorted((-s, a, b) for a, b, s in pairs):
        if s < 0 and a not in done and b not in taken:
            done[a] = b
            taken.add(b)
    return done


@pytest.mark.parametrize("scores", [range(-1, 3), range(1, 2), range(1000)])
def test_greedy_pairs_in_rounds(spark, scores):
    r = random.Random(len(scores))
    pairs = [(g, a, b, r.choice(scores)) for g, n, m in (("p", 12, 9), ("q", 1, 5), ("r", 20, 25)) for a in range(n) for b in range(m) if r.random() < 0.9]
    frame = spark.createDataFrame(pairs, "g string, a int, b int, s int")
    got = defaultdict(dict)
    for row in linkage.greedy_pairs(frame, "g", "a", "b", "s").collect():
        assert row["a"] not in got[row["g"]]
        got[row["g"]][row["a"]] = row["b"]
    for g in "pqr":
        assert got[g] == greedy([x[1:] for x in pairs if x[0] == g])


def test_one_hot_plant_of_equal_scores_takes_one_round(spark):
    side = spark.range(300)
    pairs = side.select(F.lit("p").alias("g"), F.col("id").alias("a")).crossJoin(side.select(F.col("id").alias("b"))).withColumns({"s": F.lit(5), "base": F.col("b").cast("double")})
    got = linkage.assign_one_to_one(pairs, "g", "a", "b", "s", "base")
    assert [(r["a"], r["b"], r["method"]) for r in got.orderBy("a").collect()] == [(i, i, "token") for i in range(300)]


def test_leftovers_take_base_points(spark):
    pairs = [("p", "u1", "x", 5, 1.0), ("p", "u1", "y", 0, 9.0), ("p", "u1", "z", 0, None), ("p", "u2", "x", 4, 1.0), ("p", "u2", "y", 0, 9.0), ("p", "u2", "z", 0, None), ("q", "v1", "x", 0, 2.0), ("q", "v2", "x", 0, 2.0), ("n", "w", "x", 0, None), ("n", "w", "y", 0, None)]
    got = linkage.assign_one_to_one(spark.createDataFrame(pairs, "g string, a string, b string, s int, base double"), "g", "a", "b", "s", "base")
    assert sorted((r["g"], r["a"], r["b"], r["method"], r["score"]) for r in got.collect()) == [
        ("n", "w", "y", "highest_basepoint_unit", 0), ("p", "u1", "x", "token", 5), ("p", "u2", "y", "highest_basepoint_unit", 0), ("q", "v1", "x", "highest_basepoint_reuse", 0), ("q", "v2", "x", "highest_basepoint_reuse", 0),
    ]


def test_marginal_unit_with_an_outlier(spark):
    rows = [("GAS", f"u{i:05d}", 0, 1, 1.0, 10.0 if i else 1e9, 1.0, 0.5) for i in range(400)]
    got = curves.marginal_unit(spark.createDataFrame(rows, "resource_type string, resource_name string, ts int, step int, mw double, price double, hsl double, bp double")).first()
    assert (got["resource_name"], got["price"], got["cumulative_before"]) == ("u00201", 10.0, 200.0)
