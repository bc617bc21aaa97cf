"""The composed linkages on small hand-made lists."""

from voltloom.operators import linkage, matching

RESOURCE = "resource_name string, fuel_type string, station_code string, station_desc string, generator_type string, capacity_mw double"


def test_price_nodes(spark):
    resources = spark.createDataFrame([("ALPHA_U1", "GAS", "ALPHA", "Alpha Station", "GAS", 100.0), ("BETA_1", "WIND", "BETA", "Beta Farm", "WIND", 50.0), ("ALPHA_U2", "GAS", "ALPHA", None, "GAS", 10.0), ("ZETA_9", "SOLAR", None, "Gamma Solar", "SOLAR", 20.0), ("QQQ", "GAS", None, None, None, None)], RESOURCE)
    listed = spark.createDataFrame([("GAMMA SOLAR", "GAMMA_RN", "SOLAR", 20.5), ("BETA FARM", "BETA_RN", "WIND", 51.0)], "plantname string, nodename string, primaryfuel string, capacity double")
    nodes = spark.createDataFrame([("ALPHA",), ("BETA_RN",), ("GAMMA_RN",)], "rtlmp_name string")
    mapping = spark.createDataFrame([("BETA_RN", "BETA", "1")], "resource_node string, unit_substation string, unit_name string")
    got = {r["resource_name"]: r for r in matching.match_price_nodes(resources, listed, nodes, mapping, nodes).collect()}
    assert {k: r["rtlmp_name"] for k, r in got.items()} == {"ALPHA_U1": "ALPHA", "ALPHA_U2": "ALPHA", "BETA_1": "BETA_RN", "ZETA_9": "GAMMA_RN", "QQQ": None}
    assert got["ALPHA_U1"]["score"] == 180 and got["BETA_1"]["score"] == 160 and got["ZETA_9"]["score"] == 95 + 10 + 5 + 8 and got["QQQ"]["status"] == "unmatched"


def test_model_units(spark):
    model = spark.createDataFrame([(1, "Alpha (U1)", "", "ALPHA_U1", "Bell", "GAS"), (2, "Beta CT 2", "", "", "", "GAS"), (3, "Nowhere", "", "", "", "")], "unit_id int, name string, cdr_name string, unit_code string, county string, fuel string")
    resources = spark.createDataFrame([("ALPHA_U1", "Alpha", "", "GAS", "Bell", "N1"), ("BETA_CT1", "Beta", "", "GAS", "", ""), ("BETA_CT2", "Beta", "", "GAS", "", "")], "resource_name string, station_desc string, cdr_unit_name string, fuel_type string, county string, price_code string")
    got = {r["unit_id"]: (r["resource_name"], r["status"]) for r in matching.match_model_units(model, resources).collect()}
    assert got == {1: ("ALPHA_U1", "matched"), 2: ("BETA_CT2", "matched"), 3: (None, "unmatched")}


def test_model_units_by_listed_plants_and_registry(spark):
    model = spark.createDataFrame(
        [(1, "Alpha (U1)", "", "ALPHA_U1", "Bell", "GAS"), (2, "Gamma Ridge Wind", "", "", "", "WIND"), (3, "Omega Storage", "", "QZ-77", "", ""), (4, "Kappa Solar", "", "", "Hill", "SOLAR"), (5, "Kappa Solar", "", "", "Elsewhere", ""), (6, "Gamma Ridge Wint", "", "", "", "")],
        "unit_id int, name string, cdr_name string, unit_code string, county string, fuel string",
    )
    resources = spark.createDataFrame(
        [("ALPHA_U1", "Alpha", "", "GAS", "Bell", "N1"), ("GRW_1", "Plain A", "", "WIND", "", "GRW_RN"), ("OMG_1", "Plain B", "", "", "", ""), ("KAP_1", "Plain C", "", "SOLAR", "", None)],
        "resource_name string, station_desc string, cdr_unit_name string, fuel_type string, county string, price_code string",
    )
    listed = spark.createDataFrame([("Gamma Ridge Wind", "GRW_RN"), ("Gamma Ridge Wind", "ZZZ"), (None, "GRW_RN"), ("Omega Storage", None)], "plantname string, nodename string")
    registry = spark.createDataFrame([("QZ77", "other", None, None, "OMG_1", "matched"), ("", "Kappa Solar", "Hill", "", "KAP_1", "matched"), ("", "Omega Storage", "", "", "GRW_1", "unmatched")], "unit_code string, unit_name string, county string, fuel string, resource_name string, status string")
    got = {r["unit_id"]: r for r in matching.match_model_units(model, resources, listed, registry).collect()}
    assert {k: (r["resource_name"], r["method"]) for k, r in got.items()} == {
        1: ("ALPHA_U1", "ercot_unitcode_exact"),
        2: ("GRW_1", "yes_name_base_exact_price_exact"),
        3: ("OMG_1", "sb_cdr_unit_code_key_exact"),
        4: ("KAP_1", "sb_unit_name_exact"),
        5: (None, None),
        6: ("GRW_1", "yes_name_base_fuzzy_price_exact"),
    }
    assert got[5]["status"] == "unmatched" and got[2]["score"] >= 145 + 20 + 10 + 5 and got[4]["candidate_count"] == 1
    first = {r["unit_id"]: r["resource_name"] for r in matching.match_model_units(model, resources).collect()}
    assert first == {1: "ALPHA_U1", 2: None, 3: None, 4: None, 5: None, 6: None}


def test_registry_units(spark):
    registry = spark.createDataFrame([(1, "Alpha 1", ["ALPHA_U1"], "GAS", 100.0), (2, "Gamma", ["GAMMA_X"], "WIND", 50.0), (3, "Gamma", ["GAMMA_Y"], "WIND", 20.0), (4, "Zzz", [], "SOLAR", 1.0)], "unit_id int, unit_name string, codes array<string>, fuel string, capacity double")
    resources = spark.createDataFrame([("ALPHA_U1", "GAS", 90.0), ("GAMMA_G1", "WIND", 49.0), ("GAMMA_G2", "WIND", 19.0)], "resource_name string, resource_type string, avg_base_point double")
    got = {r["unit_id"]: (r["resource_name"], r["status"]) for r in matching.match_registry_units(registry, resources).collect()}
    assert got == {1: ("ALPHA_U1", "matched"), 2: ("GAMMA_G1", "matched"), 3: ("GAMMA_G2", "matched"), 4: (None, "unmatched")}


def test_plants_are_chosen_by_fuel_and_unit_codes(spark):
    registry = spark.createDataFrame(
        [(1, "Cedar Hills 1", ["CEDARHILLS_X1"], "GAS", 10.0), (2, "x", ["OAKRIDGE_Q7", "b"], "WIND", 10.0), (3, "y", ["OAKRIDGE_Q8"], "WIND", 10.0), (4, "z", ["PINE_1"], "SOLAR", 10.0)],
        "unit_id int, unit_name string, codes array<string>, fuel string, capacity double",
    )
    resources = spark.createDataFrame(
        [("CEDARHILLA_A1", "WIND", 1.0), ("CEDARHILLZ_B1", "GAS", 1.0), ("OAKRIDGEA_1", "WIND", 1.0), ("OAKRIDGE_Z", "GAS", 1.0), ("PINE_2", "SOLAR", 3.0)],
        "resource_name string, resource_type string, avg_base_point double",
    )
    got = {r["unit_id"]: (r["resource_name"], r["method"], r["status"]) for r in matching.match_registry_units(registry, resources).collect()}
    # the common fuel lifts the second closest plant
    assert got[1][0] == "CEDARHILLZ_B1" and got[1][1].startswith("plant_descriptor_fuzzy:")
    # the same descriptor wins over a close one with the fuel (180 over 155)
    assert {got[2][0], got[3][0]} == {"OAKRIDGE_Z"} and got[2][1].startswith("plant_descriptor_exact:")
    assert got[4][0] == "PINE_2"


def test_unit_codes_choose_the_second_closest_plant(spark):
    units = spark.createDataFrame([(1, "ALPHABETA", "GAS", "K1"), (2, "ALPHABETA", "GAS", "K2"), (3, "LONE", "", "")], "unit_id int, s_plant string, s_fuel string, s_code_key string")
    resources = spark.createDataFrame([("ALPHABETA", "WIND", "N1"), ("ALPHABETB", "COAL", "K1"), ("ALPHABETB", "COAL", "K2"), ("ALPHABETC", "GAS", "K3"), ("", "GAS", "")], "r_plant string, r_fuel string, r_key string")
    got = [tuple(r) for r in matching.choose_plants(units, resources).collect()]
    assert got == [("ALPHABETA", "ALPHABETB", "plant_descriptor_fuzzy", 205)]


def test_close_names_of_other_beginnings(spark):
    left = spark.createDataFrame([("CEDAR CREEK",), ("",), ("XLPHA STATION",)], "a string")
    right = spark.createDataFrame([("ALPHA STATION",), ("KEDAR CREEK",), ("BETA",), ("",), (None,)], "b string")
    got = {(r["__a"], r["__b"]) for r in linkage.close_matches(left, right, "a", "b", least=0.8, top=5).collect()}
    assert got == {("CEDAR CREEK", "KEDAR CREEK"), ("XLPHA STATION", "ALPHA STATION")}


def test_mapping_compares_whole_lists(spark):
    records = spark.createDataFrame([("CREEK CEDAR",), ("FARM WINDY",)], "name string")
    units = spark.createDataFrame([("C1", "CEDAR CREEK"), ("W9", "FARM WINDX")], "code string, label string")
    other = spark.createDataFrame([("W1", "WINDY FARM")], "code string, label string")
    manual = spark.createDataFrame([], "name string, match string")
    got = {r["name"]: (r["match"], r["vetoed"]) for r in linkage.map_units(records, units, manual=manual, other=other)["tracker"].collect()}
    assert got == {"CREEK CEDAR": ("C1", False), "FARM WINDY": (None, True)}


def test_what_matching_leaves_behind(spark):
    from voltloom.operators import coverage

    matches = spark.createDataFrame(
        [("A_U1", "GAS", "A", "Alpha", "GAS", None, "N_1", "listed", "matched", 7.0), ("B_U1", None, "B", None, "WIND", 3.0, "N_2", "listed", "unmatched", 9.0), ("C_1", "", "C", "", "SOLAR", 4.0, "N-3", "map", "ambiguous", None)],
        "resource_name string, fuel_type string, station_code string, station_desc string, generator_type string, capacity_mw double, rtlmp_name string, price_node_source string, status string, yes_capacity_mw double",
    )
    simple = coverage.simple_matches(matches)
    assert {r["resource_name"]: (r["price_code"], r["price_node_source"], r["capacity_mw"]) for r in simple.collect()} == {"A_U1": ("N_1", "listed", 7.0), "B_U1": ("", "", 3.0), "C_1": ("N-3", "map", 4.0)}
    units = spark.createDataFrame([(" a_u1 ", "County"), ("", "none")], "unit_code string, county string")
    got = {r["resource_name"]: r for r in coverage.reference_frame(matches, simple, units).collect()}
    assert got["A_U1"]["county"] == "County" and got["A_U1"]["capacity_mw"] == 7.0 and got["C_1"]["price_code_key"] == "N3" and got["B_U1"]["fuel_norm"] == "WIND" and got["C_1"]["county"] is None
    model = spark.createDataFrame([("m1", "A_U1", "unmatched", "x"), ("m2", "A_U1", "matched", "A_U1"), ("m3", None, "unmatched", "Zeta 9"), ("m4", "C_1", "unmatched", "none")], "Name string, node string, status string, code string")
    resources = spark.createDataFrame([("A_U2", 2.0), ("A_U1", 1.5), ("A_U1", 1.5), ("C_1", None)], "resource_name string, avg_base_point double")
    assert {r["Name"]: r["plant_units"] for r in coverage.plant_unit_lists(model, resources, node="node").collect()} == {"m1": "A_U1 | A_U2", "m2": "A_U1 | A_U2", "m3": "", "m4": "C_1"}
    assert {r["Name"]: r["node_note"] for r in coverage.repeated_node_notes(model, resources, node="node").collect()} == {"m1": "A_U1 | avg_base_point=1.500000", "m2": "A_U1 | avg_base_point=1.500000", "m3": "", "m4": ""}
    listed = spark.createDataFrame([(2, "ZETA9", "other"), (1, "Zeta-9", "m1"), (3, "CODE4", "M-4")], "row int, unit_code string, unit_name string")
    codes = coverage.reference_codes(model, listed, status="status", code="code", name="Name", listed_code="unit_code", listed_name="unit_name", order="row")
    assert {r["Name"]: r["reference_code"] for r in codes.collect()} == {"m1": "Zeta-9", "m2": "", "m3": "Zeta-9", "m4": "CODE4"}
    assert [r["k"] for r in coverage.total_first(spark.createDataFrame([("b",), ("ALL",), ("a",)], "k string"), "k").collect()] == ["ALL", "a", "b"]


def test_bounds_lose_no_close_text():
    import difflib
    import random

    r = random.Random(3)
    words = ["ALPHA", "BETA", "CEDAR", "CREEK", "WIND", "SOLAR", "RIDGE", "UNIT", "NORTH", "É"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 4))) + str(r.randint(0, 99)) for _ in range(120)] + ["", "A", "AAAA", "AAB"]
    mine = ["".join(c for c in t if r.random() > 0.15) for t in texts[:60]]
    for least in (0.6, 0.82, 0.94):
        want = {(x, y) for x in mine for y in texts if x and y and difflib.SequenceMatcher(None, y, x).ratio() >= least}
        assert {(x, y) for x, y, _ in linkage.close_texts([m for m in mine if m], [t for t in texts if t], least)} == want
        best = {(x, y) for x in mine if x for y in difflib.get_close_matches(x, [t for t in texts if t], n=3, cutoff=least)}
        assert {(x, y) for x, y, _ in linkage.close_texts(sorted({m for m in mine if m}), sorted({t for t in texts if t}), least, 3)} == best


def test_few_pairs_reach_the_ratio(spark, monkeypatch):
    from pyspark.sql import functions as F

    from voltloom.functions import names
    from voltloom.plans import catalog

    part = catalog.table(spark, "/root/testdata/sf0.01", "part").select(names.clean("p_name").alias("t")).distinct()
    texts = sorted(r["t"] for r in part.collect())
    asked = []
    monkeypatch.setattr(linkage, "gestalt", lambda a, b: asked.append(1) or 0.0)
    list(linkage.close_texts(texts[:300], texts, 0.82))
    assert len(asked) < 0.1 * 300 * len(texts)
    monkeypatch.undo()
    # bands meet all lengths within reach of the cutoff
    left, right = (spark.createDataFrame([("x" * n,) for n in range(1, 40)], f"{c} string") for c in "ab")
    got = {(len(r["__a"]), len(r["__b"])) for r in linkage._close_in_blocks(left, right, "a", "b", 0.82).filter(F.col("ratio") >= 0.82).collect()}
    assert got == {(a, b) for a in range(1, 40) for b in range(1, 40) if 2 * min(a, b) / (a + b) >= 0.82}
