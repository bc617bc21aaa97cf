"""Findings of round 4: comparisons of names that do less for each pair, against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from voltloom.functions import similarity
from voltloom.operators import linkage, matching

PARTS = ["AN", "EL", "JO", "STR", "M", "BER", "LOKE", "É", "5", "U19"]


def made_up(r, n, most=4):
    return ["".join(r.choice(PARTS) for _ in range(r.randint(1, most))) for _ in range(n)]


def test_ratios_of_many_pairs_at_once():
    r = random.Random(2)
    left = [*[" ".join(made_up(r, 3)) for _ in range(400)], "", "A", "", "\U0001f600a", "aaab", "ab" * 120, "x" * 199, "ab" * 99 + "c", "\U0010ffffa"]
    right = [*[" ".join(made_up(r, 3)) for _ in range(400)], "A", "", "", "a\U0001f600", "abaa", "ba" * 140, "x" * 7, "c" + "ba" * 99, "\U0010ffffb"]
    assert similarity.gestalts(left, right).tolist() == [similarity.gestalt(a, b) for a, b in zip(left, right, strict=True)]
    for least in (0, 70, 90):
        assert similarity.token_sets(left, right, least).tolist() == [similarity.token_set(a, b, least) for a, b in zip(left, right, strict=True)]
    assert len(similarity.gestalts([], [])) == len(similarity.token_sets([], [])) == 0


def test_labels_meet_by_rare_words_and_letters(spark):
    """Against all pairs, with words that most labels have, texts of over 200 letters, words in another order, and codes that share a label."""
    r = random.Random(6)
    mine = [*{" ".join(["UNIT", *made_up(r, 2, 3)]) for _ in range(60)}, "", "UNIT", "AB CDE", "Q" * 150 + " " + "RS" * 40]
    units = [(str(k), t) for k, t in enumerate([*[" ".join(["UNIT", *made_up(r, 2, 3)]) for _ in range(60)], "CDE AB", "", "UNIT", "UNIT", "Q" * 150 + " " + "RS" * 39, "Q" * 150 + " T"])]
    asked = spark.createDataFrame([(m,) for m in mine], "__label string")
    corpus = spark.createDataFrame(units, "code string, __label string")
    for least in (60, 90):
        want = {m: min(found) for m in mine if (found := [(-q, c) for c, t in units if (q := similarity.token_set(m, t)) >= least])}
        got = {row["__label"]: (-row["similarity"], row["code"]) for row in linkage.closest_labels(asked, corpus, least).collect()}
        assert got == want and len(got) > 3

    # what all labels have is no reason to meet
    def words(rows, name):
        return spark.createDataFrame([(t, t.split(), len(t)) for t in rows], f"{name} string, words array<string>, size int").withColumn("word", F.explode("words"))

    many = [f"UNIT NAME{k} M" for k in range(50)]
    kept = [row["word"] for row in linkage._rarest(words(many, "a"), words(many, "b"), "a", 90).collect()]
    assert sorted(kept) == sorted(t.split()[1] for t in many)


def test_search_by_leaves_and_by_rows_agree(monkeypatch):
    r = random.Random(8)
    texts = sorted({" ".join(made_up(r, 2, 5)) for _ in range(700)})
    for least in (0.72, 0.9):
        want = {(x, y, q) for x in texts[:90] for y in texts if (q := linkage.gestalt(y, x)) >= least}
        for sparse in (0, 2):
            monkeypatch.setattr(linkage, "SPARSE", sparse)
            monkeypatch.setattr(linkage, "ROW", 64)
            monkeypatch.setattr(linkage, "BOUNDED", 16)
            assert set(linkage.close_texts(texts[:90], texts, least)) == want
    telling = linkage.telling_counts(texts)
    marked, counts = linkage.marks(texts, telling), linkage.letter_counts(texts)
    apart = np.abs(counts[:, None] - counts[None]).sum(axis=2)
    assert (np.bitwise_count(marked[:, None] ^ marked) <= apart).all()


def seen_by_rules(monkeypatch):
    """What each call of ``candidates`` is asked: the number of left rows and the methods."""
    asked, whole = [], linkage.candidates
    monkeypatch.setattr(linkage, "candidates", lambda left, right, rules: asked.append((left.count(), {q.method for q in rules})) or whole(left, right, rules))
    return asked


def test_model_units_that_are_alike_are_looked_up_once(spark, monkeypatch):
    """Copies of a unit get the same answer from one look, and the late look at codes is for those without a code."""
    asked = seen_by_rules(monkeypatch)
    model = spark.createDataFrame([*[(k, "ALPHA RIDGE", "ALPHA RIDGE", "AR_U1", "X", "WIND") for k in (1, 2, 3)], (4, "BETA", "BETA", "QQQ_WWWW", "X", "GAS"), (5, "NONE", "NONE", "", "", "")], "unit_id int, name string, cdr_name string, unit_code string, county string, fuel string")
    resources = spark.createDataFrame([("AR_U1", "ALPHA RIDGE", "ALPHA RIDGE", "WIND", "X", "P"), ("QQQ_WXYW", "BETB", "BETB", "GAS", "X", None)], "resource_name string, station_desc string, cdr_unit_name string, fuel_type string, county string, price_code string")
    got = {row["unit_id"]: (row["resource_name"], row["score"], row["method"]) for row in matching.match_model_units(model, resources).collect()}
    assert got[1] == got[2] == got[3] and got[1][0] == "AR_U1" and got[4][0] == "QQQ_WXYW" and got[4][2] == "ercot_unitcode_fuzzy_late" and got[5][0] is None
    assert [n for n, _ in asked] == [3, 2] and asked[1][1] == {"ercot_unitcode_fuzzy_late"}
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "a", None), (4, "a", None), (5, "b", 1.0), (5, "a", 1.0), (None, "a", 1.0)], "k int, t string, v double")
    alone, members = linkage.stand_ins(rows, "k")
    assert sorted(tuple(x) for x in members.collect() if x["k"]) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]
    assert sorted(tuple(x)[:2] for x in alone.collect()) == [(1, "a"), (3, "a"), (5, "a"), (5, "b")]
    assert linkage._twins(rows.withColumns({"u": F.col("t"), "w": F.lit("a")}), ["t", "u", "w"]) == {"t": "t", "u": "t", "w": "w"}


def test_registry_units_that_are_alike_are_looked_up_once(spark, monkeypatch):
    asked = seen_by_rules(monkeypatch)
    registry = spark.createDataFrame([*[(k, "ALPHA U1", ["ALP_U1", "x"], "WIND", 5.0) for k in (1, 2, 3)], (4, "BETA", ["", "BET_U2"], "GAS", None)], "unit_id int, unit_name string, codes array<string>, fuel string, capacity double")
    resources = spark.createDataFrame([("ALP_U1", "WIND", 5.0), ("BET_U2", "GAS", 1.0)], "resource_name string, resource_type string, avg_base_point double")
    got = {row["unit_id"]: tuple(row)[1:] for row in matching.match_registry_units(registry, resources).collect()}
    assert got[1] == got[2] == got[3] and got[1][:2] == ("ALP_U1", "code_exact") and got[4][:2] == ("BET_U2", "code_exact")
    assert [n for n, _ in asked] == [2]
