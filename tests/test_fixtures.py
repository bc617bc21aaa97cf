"""Cases computed by hand."""

import datetime as dt
import difflib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from voltloom.functions import names, similarity, values
from voltloom.operators import curves, descriptive, frames, linkage, prices, summaries


def at(hour, minute=0, day=1, month=1):
    return dt.datetime(2024, month, day, hour, minute)


def offers(spark, idle_b=False):
    b = 0.0 if idle_b else 10.0
    rows = [("A", 1, 50.0, 20.0, 120.0, 80.0), ("A", 2, 100.0, 30.0, 120.0, 80.0), ("B", 1, 20.0, 15.0, 50.0, b), ("B", 2, 40.0, 25.0, 50.0, b)]
    df = spark.createDataFrame([("GAS", n, at(0, 5), s, mw, p, hsl, bp) for n, s, mw, p, hsl, bp in rows], "resource_type string, resource_name string, ts timestamp_ntz, step int, mw double, price double, hsl double, bp double")
    return df


def test_representative_quantities(spark):
    got = {r["step"]: r for r in curves.representative_quantities(offers(spark)).collect()}
    assert [got[k]["mw"] for k in (1, 2)] == pytest.approx([35, 70])
    assert got[1]["bp"] == pytest.approx(36.75) and got[1]["hsl"] == pytest.approx(85.75)
    got = {r["step"]: r for r in curves.representative_quantities(offers(spark, True), masked=True).collect()}
    assert [got[k]["mw"] for k in (1, 2)] == pytest.approx([50, 100])
    assert got[1]["bp"] == pytest.approx(80) and got[1]["hsl"] == pytest.approx(120)


def test_marginal_unit(spark):
    row = curves.marginal_unit(offers(spark)).first()
    assert (row["total_bp"], row["step"], row["resource_name"], row["price"], row["mw"], row["cumulative_before"]) == (90, 2, "B", 25, 40, 70)


def test_hourly_supply(spark):
    got = {r["step"]: (r["hour"], r["mw"], r["price"]) for r in curves.hourly_supply(offers(spark)).collect()}
    assert got[1] == (1, 70, pytest.approx(1300 / 70)) and got[2] == (1, 210, pytest.approx(6000 / 210))


def test_hourly_modes(spark):
    df = spark.createDataFrame([("GAS", at(3, 5 * k), 60.0) for k in range(12)], "resource_type string, ts timestamp_ntz, value double")
    assert curves.hourly_by_type(df).first()["mw"] == 60
    assert curves.hourly_by_type(df, mode="mwh").first()["mwh"] == 60


def test_mean_of_means(spark):
    rows = [("N", at(0, 15 * k), p) for k, p in enumerate((10.0, 20.0, 30.0, 40.0))] + [("N", at(0, day=2), 5.0)]
    df = spark.createDataFrame(rows, "node string, ts timestamp_ntz, price double")
    assert prices.month_hour_means(df).first()["price"] == 15


def test_errors(spark):
    rows = [("L", dt.date(2024, 1, 1), 30.0), ("R", dt.date(2024, 1, 1), 25.0), ("L", dt.date(2024, 2, 1), 30.0), ("R", dt.date(2024, 2, 1), 0.0)]
    got = prices.monthly_errors(spark.createDataFrame(rows, "node string, month date, price double"), "L", "R").orderBy("month").collect()
    assert [(r["mae"], r["mape"]) for r in got] == [(5, 20), (30, None)]


@pytest.mark.parametrize(("policy", "want"), [("skip", 5), ("overwrite", 7)])
def test_conflicts(spark, policy, want):
    rows = [("A", 1, 0, 0, None), ("A", 1, 0, 1, 5.0), ("A", 1, 0, 2, 6.0), ("A", 1, 1, 0, 7.0)]
    df = spark.createDataFrame(rows, "name string, ts int, file_ord int, row_ord int, value double")
    assert summaries.resolve_files(df, ["name", "ts"], "value", policy=policy).first()["value"] == want
    assert summaries.mean_then_last(df, ["name", "ts"], "value").first()["value"] == 7
    assert summaries.mean_then_last(df.filter("file_ord = 0"), ["name", "ts"], "value").first()["value"] == 5.5


def test_summaries_merge(spark):
    df = spark.createDataFrame([("A", "GAS", at(1), 4.0), ("A", "GAS", at(2), 6.0), ("A", "GAS", at(3), 5.0), ("B", "GAS", at(3), None)], "resource_name string, resource_type string, ts timestamp_ntz, value double")
    parts = summaries.partial_summary(df.limit(2), ["value"]).unionByName(summaries.partial_summary(df.subtract(df.limit(2)), ["value"]))
    got = {r["resource_name"]: r for r in summaries.finish_summary(summaries.merge_summaries(parts, ["value"]), ["value"]).collect()}
    assert (got["A"]["value_avg"], got["A"]["value_min"], got["A"]["row_count"]) == (5, 4, 3) and got["B"]["value_avg"] is None


def test_off_peak(spark):
    df = spark.createDataFrame([("A", at(h)) for h in (12, 18, 19, 20)], "resource_name string, ts timestamp_ntz")
    kept = descriptive.off_peak(df)
    assert sorted(r["ts"].hour for r in kept.collect()) == [18, 19, 20]
    assert [r["ts"].hour for r in descriptive.supported(kept, "resource_name").collect()] == [19]


def test_recode_last_pattern(spark):
    rows = [("Base Expansion", "Wind gas"), ("Base Expansion", "New Hybrid PV-BESS"), ("Other", "Wind")]
    got = [r["c"] for r in descriptive.recode(spark.createDataFrame(rows, "c string, n string"), "c", "n").collect()]
    assert got == ["OtherTech_NG", "PVGR-BESS", "Other"]


def test_heat_rate(spark):
    columns = [f"{f} {m}" for f in ("Elec_MMBtu", "Netgen") for m in descriptive.MONTHS]
    df = spark.createDataFrame([("GAS", *[10.0] * 12, 2.0, *[0.0] * 11)], "fuel string, " + ", ".join(f"`{c}` double" for c in columns))
    got = {r["month"]: r["heat_rate"] for r in descriptive.heat_rates(df, ["fuel"]).collect()}
    assert got[1] == 0.005 and got[2] is None


def test_names(spark):
    df = spark.createDataFrame([(" a-b_1 ", "ABC_U1", "P_Q_UNIT1", "Foo Energy LLC Unit II", "ALPHA_BESS1")], "a string, b string, c string, d string, e string")
    r = df.select(names.key("a").alias("a"), names.family("b").alias("b"), names.plant_id("c").alias("c"), names.plant_base("d").alias("d"), names.unit_numbers("d").alias("n"), names.stems("e").alias("e"), names.plant_and_unit("b").alias("pu"), names.fuel(F.lit("Natural Gas")).alias("f"), names.fuel(F.lit("battery storage"), names.RESOURCE_FUELS).alias("g"), names.unit_tokens("b").alias("t")).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["n"]) == ("AB1", "ABC", "P_Q", "FOO", [2])
    assert r["e"] == ["ALPHA_BESS1", "ALPHA"] and tuple(r["pu"]) == ("ABC", "U1") and (r["f"], r["g"]) == ("GAS", "BESS")
    assert {"1", "U1", "UNIT1"} <= set(r["t"])
    whole = {
        "Base (U2) (ERCOT)": ("BASE", "U2"), "Plant CT 3": ("PLANT", "CT3"), "Alpha Beta (ERCOT)": ("ALPHA BETA", ""), "Alpha (West)": ("ALPHA (WEST)", ""), "Alpha (West) (B1)": ("ALPHA (WEST)", "B1"),
        "Alpha (GT-4A)": ("ALPHA", "GT-4A"), "Alpha (U1) (X)": ("ALPHA", "X"), "Plant 12": ("PLANT", "12"), "Plant": ("PLANT", ""), "": ("", ""), "  Two  Words unit-7 ": ("TWO WORDS", "UNIT-7"),
    }
    got = spark.createDataFrame([(k,) for k in whole], "t string").select("t", names.model_name_parts("t").alias("p")).collect()
    assert {r["t"]: (r["p"]["base"], r["p"]["unit_hint"]) for r in got} == whole


def test_similarity(spark):
    random.seed(1)
    pairs = [("ABC_1", "ABC1"), ("", "X"), (None, "X")] + [("".join(random.choices("ABC_1", k=8)), "".join(random.choices("ABC_1", k=8))) for _ in range(50)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.gestalt_ratio("a", "b").alias("r")).collect()
    assert got[0]["r"] == pytest.approx(8 / 9)
    assert all(r["r"] == (difflib.SequenceMatcher(None, r["a"], r["b"]).ratio() if r["a"] and r["b"] else 0) for r in got)
    assert similarity.token_set("FOO BAR", "BAR FOO BAZ") == 100


def test_values(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("x",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(values.number("t")).collect()] == [1.5, None, None, None, None]
    t = spark.range(1).select(values.timestamp(F.lit("01/02/2024 03:04")).alias("a"), values.timestamp(F.lit("01/02/2024 03:04:05")).alias("b"), values.timestamp(F.lit("2024")).alias("c")).first()
    assert (t["a"], t["b"], t["c"]) == (dt.datetime(2024, 1, 2, 3, 4), dt.datetime(2024, 1, 2, 3, 4, 5), None)


def test_distinct_texts(spark):
    df = spark.createDataFrame([("a", *r) for r in enumerate(["x", None, " ", "y", "x", " z "])] + [("b", 1, None)] + [("c", k, "same") for k in range(5000)], "k string, o int, v string")
    got = {limit: {r["k"]: r["t"] for r in frames.distinct_texts(df, ["k"], "v", "o", "t", limit=limit).collect()} for limit in (None, 2)}
    assert got == {None: {"a": "x | y | z", "b": "", "c": "same"}, 2: {"a": "x | y", "b": "", "c": "same"}}


def test_ambiguity(spark):
    df = spark.createDataFrame([("k", "n1", 200), ("k", "n2", 200), ("k", "n3", 150)], "k string, name string, score int")
    r = linkage.decide(df, ["k"], "name").first()
    assert (r["status"], r["candidate_count"], r["name"], r["alternatives"]) == ("ambiguous", 3, "n2", "n1 | n3")


def test_assignment(spark):
    rows = [("p", "a1", "b1", 5, 1.0), ("p", "a1", "b2", 9, 2.0), ("p", "a2", "b2", 8, 2.0), ("p", "a2", "b1", 0, 1.0)]
    df = spark.createDataFrame(rows, "plant string, l string, r string, s int, base double")
    got = {r["l"]: (r["r"], r["method"]) for r in linkage.assign_one_to_one(df, "plant", "l", "r", "s", "base").collect()}
    assert got == {"a1": ("b2", "token"), "a2": ("b1", "highest_basepoint_unit")}


def test_bands_are_complete(spark):
    df = spark.createDataFrame([("GAS", 230)] * 4, "fuel string, score int")
    got = {r["band"]: (r["n"], r["share"]) for r in linkage.banded_counts(df, "fuel", "score").collect()}
    assert got == {"High": (4, 1.0), "Medium": (0, 0.0), "Low": (0, 0.0), "Unmatched": (0, 0.0)}


def test_staged_mapping(spark):
    records = spark.createDataFrame([("Foo Power Unit 2",), ("BAR1",), ("Manual",), ("Nothing alike",)], "name string")
    units = spark.createDataFrame([("FOO_U2", "Foo Energy U2"), ("BAR_1", "Bar 1")], "code string, label string")
    other = spark.createDataFrame([("W1", "Windy Ridge")], "code string, label string")
    manual = spark.createDataFrame([("Manual", "M1")], "name string, match string")
    got = {r["name"]: (r["match"], r["stage"]) for r in linkage.map_units(records, units, manual=manual, other=other)["tracker"].collect()}
    assert got["Manual"] == ("M1", "manual") and got["BAR1"] == ("BAR_1", "exact_code") and got["Nothing alike"][1] == "no_match"
    assert got["Foo Power Unit 2"][0] == "FOO_U2"


def test_group_spread_and_fallback(spark):
    df = spark.createDataFrame([("r1", "s", "n1", 200, "matched"), ("r2", "s", None, None, "unmatched"), ("r3", "", None, None, "unmatched")], "rec string, station string, name string, score int, status string")
    got = {r["rec"]: (r["name"], r["status"]) for r in linkage.spread_in_group(df, "station", ["name"]).collect()}
    assert got == {"r1": ("n1", "matched"), "r2": ("n1", "matched"), "r3": (None, "unmatched")}
    later = spark.createDataFrame([("r3", "n9", 50, "matched")], "rec string, name string, score int, status string")
    got = {r["rec"]: r["name"] for r in linkage.fall_back(df, later, ["rec"], ["name", "score", "status"]).collect()}
    assert got == {"r1": "n1", "r2": None, "r3": "n9"}


def test_checked_join(spark):
    once, twice = spark.createDataFrame([(1, 0), (2, 0), (None, 0), (None, 1)], "k int, a int"), spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "k int, v int")
    for left, right, kind in ((once, twice, "many_to_one"), (twice, once, "one_to_many"), (once, twice, "one_to_one"), (twice, once, "one_to_one")):
        met = frames.checked_join(left, right, ["k"], validate=kind)
        with pytest.raises(Exception, match="not unique"):
            met.select("v").collect()
    assert frames.checked_join(twice, once, ["k"]).count() == 3
    met = frames.checked_join(once, twice, ["k"], "full", validate="one_to_many", indicator="_merge")
    assert sorted((r["k"] or 0, r["_merge"]) for r in met.collect()) == [(0, "left_only"), (0, "left_only"), (1, "both"), (1, "both"), (2, "left_only"), (3, "right_only")]


def test_wide_matrix(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("b", 2, 5.0)], "r string, c int, v double")
    got = {r["r"]: (r["1"], r["2"]) for r in summaries.type_matrix(df, [1, 2], ["r"], "c", "v").collect()}
    assert got == {"a": (2.0, None), "b": (None, 5.0)}


def test_resolve_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["Resource  Name", "x"])
    assert frames.resolve_columns(df, {"name": ["resource name"]}).columns == ["name", "x"]
    with pytest.raises(ValueError, match="missing columns"):
        frames.resolve_columns(df, {"price": []})


def test_nested_archives(spark, tmp_path):
    from voltloom.sources import archives

    inner = tmp_path / "inner.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("sced_1.csv", "Resource Name|Value\nA|1\n\nB|2\n")
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.write(inner, "inner.zip")
        z.writestr("top.csv", "Resource Name,Value\nC,3\n")
    inner.unlink()
    lines = archives.zipped_lines(spark, str(tmp_path), min_depth=2, max_depth=2)
    assert lines.count() == 3
    got = archives.zipped_table(archives.zipped_lines(spark, str(tmp_path)), ["Resource Name", "Value", "Absent"]).collect()
    assert sorted((r["Resource Name"], r["Value"], r["Absent"]) for r in got) == [("A", "1", None), ("B", "2", None), ("C", "3", None)]


def test_quoted_cells_in_archives(spark, tmp_path):
    from voltloom.sources import archives

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("q.csv", 'Resource Name,"Fuel, type",MW\n"X, LLC",GAS,5\n"say ""hi""",WIND,\n')
        z.writestr("p.csv", 'MW|Resource Name\n7|"Y|Z"\n')
    got = archives.zipped_table(archives.zipped_lines(spark, str(tmp_path)), ["Resource Name", "Fuel, type", "MW"]).collect()
    assert sorted((r[0], r[1] or "", r[2] or "") for r in got) == [("X, LLC", "GAS", "5"), ("Y|Z", "", "7"), ('say "hi"', "WIND", "")]


def test_csv_sources(spark, tmp_path):
    from voltloom.sources import tables

    (tmp_path / "a.csv").write_text("Name;V\nx;1\n")
    assert tables.read_csv(spark, str(tmp_path / "a.csv"), required={"name": []}).first()["name"] == "x"
    (tmp_path / "l.csv").write_bytes("Name,V\nCafé,1\n".encode("latin-1"))
    assert tables.read_csv_any_encoding(spark, str(tmp_path / "l.csv")).first()["Name"] == "Café"
    (tmp_path / "aggregation_SCED1_Curve-MW3.csv").write_text("Resource Name,Resource Type,2024-01-01 00:00:00,note\nA,GAS,5,x\nB,GAS,,y\n")
    r = tables.wide_to_long(spark, str(tmp_path / "aggregation_SCED1_Curve-MW3.csv")).collect()
    assert [(x["resource_name"], x["ts"], x["metric"], x["step"], x["value"]) for x in r] == [("A", at(0), "MW", 3, 5.0)]


def test_map_tables(spark, tmp_path):
    from voltloom.sources import tables

    (tmp_path / "m.tab").write_text('!table\n!version 300\n!charset "Neutral"\n\nDefinition Table\n  Type NATIVE Charset "Neutral"\n  Fields 2\n    ID Integer ;\n    NAME Char (10) ;\n')
    for kind in ("dat", "id", "map"):
        (tmp_path / f"m.{kind}").write_text("x")
    r = tables.read_map_tables(spark, str(tmp_path)).first()
    assert (r["version"], r["charset"], r["type"], r["complete"]) == ("300", "Neutral", "NATIVE", True)
    assert [tuple(f) for f in r["fields"]] == [("ID", "Integer"), ("NAME", "Char (10)")]


def test_merge_and_save(spark, tmp_path):
    from voltloom.sources import sinks

    old = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    new = spark.createDataFrame([("a", 9.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    assert sinks.merge_and_save(old, str(tmp_path / "t"), ["k"], "v") == 0
    assert sinks.merge_and_save(new, str(tmp_path / "t"), ["k"], "v") == 1
    assert dict(spark.read.parquet(str(tmp_path / "t/v1")).collect()) == {"a": 1.0, "b": 2.0, "c": 3.0}


def test_streaming_refresh(spark, tmp_path):
    from voltloom.streaming.refresh import refresh_summaries, summary_store

    schema = "resource_name string, resource_type string, ts timestamp_ntz, value double"
    for k in range(2):
        spark.createDataFrame([("A", "GAS", at(k), float(k + 1))], schema).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        refresh_summaries(spark, rows, str(tmp_path / "store"), str(tmp_path / "check"), ["value"]).awaitTermination()
    r = summary_store(spark, str(tmp_path / "store"), ["value"]).read().first()
    assert (r["row_count"], r["value_sum"]) == (2, 3.0)


def test_yearly_files_and_counts(spark, tmp_path):
    from voltloom.sources import sinks, tables

    for year in (2023, 2024):
        (tmp_path / f"{year}.csv").write_text(f"DATETIME,AVGVALUE\n{year}-01-02 03:00:00,{year - 2000}.5\n")
    rows = tables.read_by_year(spark, {y: str(tmp_path / f"{y}.csv") for y in (2023, 2024)}, "DATETIME", "AVGVALUE")
    counted, seen = sinks.observed(rows, "n", large="value > 24")
    sinks.write(counted, str(tmp_path / "out"))
    assert seen.get == {"rows": 2, "large": 1} and spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_bundle(spark, {"a": str(tmp_path / "2023.csv")}, {"a": {"PRICE": []}})


def test_files_of_other_column_order(spark, tmp_path):
    from voltloom.sources import tables

    (tmp_path / "a.csv").write_text("Name,MW\nx,1\n")
    (tmp_path / "b.csv").write_bytes('MW,Other,Name\n2,"o, p",Café\n3\n'.encode("latin-1"))
    (tmp_path / "c.csv").write_text("")
    got = sorted(tuple(r) for r in tables.read_csv_any_encoding(spark, str(tmp_path / "*.csv")).fillna("none").collect())
    assert got == [("Café", "2"), ("none", "3"), ("x", "1")]


def test_wide_files_with_quotes_and_other_columns(spark, tmp_path):
    from voltloom.sources import tables

    (tmp_path / "agg_HSL_1.csv").write_text('"Resource Name","Resource Type",note,2024-01-01 00:00:00,2024-01-01 00:05:00\n"A, LLC",GAS,7,1.5,\nB,WIND,8,,x\n')
    (tmp_path / "agg_HSL_2.csv").write_text("Resource Name,2024-01-02 00:00:00,Resource Type\nC,9,SOLAR\n")
    got = {(r["resource_name"], r["resource_type"], str(r["ts"]), r["metric"], r["value"]) for r in tables.wide_to_long(spark, str(tmp_path / "agg_HSL*.csv")).collect()}
    assert got == {("A, LLC", "GAS", "2024-01-01 00:00:00", "HSL", 1.5), ("C", "SOLAR", "2024-01-02 00:00:00", "HSL", 9.0)}


def test_partitioned_write(spark, tmp_path):
    from voltloom.sources import sinks

    df = spark.range(1000).selectExpr("id", "if(id < 900, 'hot', cast(id as string)) as kind")
    sinks.write(df, str(tmp_path / "t"), by=["kind"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 1000 and back.filter("kind = 'hot'").count() == 900
