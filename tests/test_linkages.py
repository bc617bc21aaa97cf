"""The linkages as wholes on the tables, against loops over all pairs.

The forms of names come from the library (they have tests of their own); the
candidates, bonuses, stages and choices are worked out anew.
"""

import difflib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voltloom.functions import names, similarity
from voltloom.plans import catalog

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@pytest.fixture(scope="module")
def clients(spark):
    rows = catalog.table(spark, SF, "clients").withColumn("handle", F.substring_index("email", "@", 1))
    made = rows.select(
        "client_id", "source", "balance", names.clean("handle").alias("code"), names.key("handle").alias("key"), names.clean("name").alias("name"), names.model_name_parts("name").alias("parts"),
        names.fuel("segment").alias("fuel"), names.clean("city").alias("county"), names.unit_tokens("handle").alias("tokens"), F.col("handle").alias("raw"),
    )
    return [r.asDict() for r in made.collect()]


def test_model_units_against_all_pairs(spark, clients):
    resources = [r for r in clients if r["source"] == "crm"]
    fields = {"code": "code", "key": "key", "name": "name"}
    rules = [("code", "code", 220, None, 0), ("key", "key", 210, None, 0), ("code", "code", 165, 0.82, 5), ("code", "code", 135, 0.72, 8), ("base", "name", 185, None, 0), ("base", "name", 150, 0.84, 5), ("base", "name", 180, None, 0), ("base", "name", 145, 0.82, 5), ("name", "name", 150, None, 0), ("name", "name", 125, 0.86, 5)]
    group = defaultdict(int)
    for r in resources:
        group[r["name"]] += 1
    texts = {f: sorted({r[f] for r in resources} - {""}) for f in fields}
    want = {}
    for m in (r for r in clients if r["source"] != "crm"):
        mine = {"code": m["code"], "key": m["key"], "name": m["name"], "base": m["parts"]["base"]}
        assert m["parts"]["unit_hint"] == ""  # hints have tests of their own; here only groups of one count
        found = []
        for k, (left, right, points, least, top) in enumerate(rules):
            text = mine[left]
            close = set() if not text else {text} if least is None else set(difflib.get_close_matches(text, texts[right], n=top, cutoff=least))
            found += [(k, points, r) for r in resources if r[right] in close]
        if any(k < 3 for k, _, _ in found):
            found = [f for f in found if f[0] != 3]
        scored = []
        for k, points, r in found:
            if not r["raw"]:
                continue
            points += 10 if k > 3 and group[r["name"]] == 1 else 0
            points += (10 if m["fuel"] and m["fuel"] == r["fuel"] else 0) + (12 if m["county"] and m["county"] == r["county"] else 0) + (5 if r["balance"] is not None and r["balance"] >= 0 else 0)
            points += int(20 * ratio(m["code"], r["code"])) + int(12 * ratio(m["name"], r["name"])) + int(8 * ratio(m["name"], r["name"])) + int(14 * ratio(mine["base"], r["name"]))
            scored.append((points, r["raw"]))
        top = max(scored, default=None)
        status = "unmatched" if top is None else "ambiguous" if len({n for p, n in scored if p == top[0]}) > 1 else "matched"
        want[m["client_id"]] = (top and top[1], top and top[0], status, len({n for _, n in scored}))
    got = {r["unit_id"]: tuple(r)[1:] for r in catalog.QUERIES["linked_model_units"](spark, SF).collect()}
    assert got == want
    assert {"matched", "unmatched"} <= {w[2] for w in want.values()}


def token_set(a, b):
    a, b = set(a.split()), set(b.split())
    if not a or not b:
        return 0.0
    both, one, two = (sorted(s) for s in (a & b, a - b, b - a))
    if both and (not one or not two):
        return 100.0
    forms = [" ".join(both), " ".join(both + one), " ".join(both + two)]
    return 100.0 * max(ratio(forms[x], forms[y]) for x, y in ((0, 1), (0, 2), (1, 2)))


def test_bound_of_word_sets_loses_nothing():
    r = random.Random(5)
    words = ["ALPHA", "BETA", "CEDAR", "CREEK", "WIND", "U1", "U12", "U2", "RIDGE", "A" * 90, "É"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 5))) for _ in range(90)]
    for least in (0, 50, 70, 88, 90, 100):
        for a in texts:
            for b in texts:
                whole = similarity.token_set(a, b)
                assert whole == pytest.approx(token_set(a, b))
                assert whole < least or similarity.token_set(a, b, least) == whole


def test_mapped_units_against_all_pairs(spark):
    given = catalog.mapping_inputs(spark, SF)

    def described(df, text):
        forms = df.select("*", names.company_free(text).alias("free"), names.plant_base(text).alias("base"), names.unit_numbers(text).alias("numbers"), names.key(text).alias("key"))
        return [r.asDict() for r in forms.withColumn("aliases", names.unit_aliases("base", F.when(F.size("numbers") > 0, F.col("numbers")).otherwise(F.expr("array(1, 2, 3, 4)")))).collect()]

    records, units, other = described(given["records"], "name"), described(given["units"], "label"), described(given["other"], "label")
    by_hand = {r["name"]: r["match"] for r in given["manual"].collect()}
    owners = defaultdict(set)
    for u in units:
        for a in u["aliases"]:
            owners[a].add(u["code"])
    want = {}
    for r in records:
        vetoed = any(r["free"] == o["free"] or token_set(r["free"], o["free"]) >= 88 for o in other)
        numbered = {u["code"] for u in units if r["base"] == u["base"] and set(r["numbers"]) & set(u["numbers"])}
        close = sorted((-token_set(r["free"], u["free"]), u["code"]) for u in units)
        stages = [
            ("manual", by_hand.get(r["name"])),
            ("exact_code", min((u["code"] for u in units if u["code"] == r["key"]), default=None)),
            ("exact_alias", min(owners[r["free"]]) if len(owners.get(r["free"], ())) == 1 else None),
            ("plant_and_number", min(numbered) if len(numbered) == 1 else None),
            ("similar", close[0][1] if not vetoed and -close[0][0] >= 90 else None),
        ]
        stage, match = next(((s, m) for s, m in stages if m is not None), ("no_match", None))
        want[r["name"]] = (match, stage, vetoed)
    got = {r["name"]: tuple(r)[1:] for r in catalog.QUERIES["mapped_units"](spark, SF).collect()}
    assert got == want
    assert {"manual", "exact_alias", "similar", "no_match"} <= {w[1] for w in want.values()}


def near(capacity, base, steps):
    if capacity is None or base is None or capacity <= 0:
        return 0
    return next((points for most, points in steps if abs(capacity - base) / capacity <= most), 0)


def test_registry_units_against_all_pairs(spark):
    registry, resources = catalog.registry_inputs(spark, SF)
    first = F.coalesce(F.get("codes", F.lit(0)), F.lit(""))
    s = registry.select(
        "unit_id", names.clean("unit_name").alias("name"), names.key("unit_name").alias("name_key"), names.clean(first).alias("code"), names.key(first).alias("code_key"), F.transform("codes", names.clean).alias("codes"), F.transform("codes", names.key).alias("keys"),
        F.transform("codes", names.family).alias("families"), names.fuel("fuel", names.RESOURCE_FUELS).alias("fuel"), F.col("capacity").cast("double").alias("capacity"), F.concat(names.unit_tokens("unit_name"), names.unit_tokens(first)).alias("tokens"),
        names.key(names.plant_and_unit(F.when(first != "", first).otherwise(F.col("unit_name")))["plant"]).alias("plant"),
    )
    r = resources.select(
        F.col("resource_name").alias("raw"), names.clean("resource_name").alias("name"), names.key("resource_name").alias("key"), names.family("resource_name").alias("family"), names.fuel("resource_type", names.RESOURCE_FUELS).alias("fuel"),
        F.col("avg_base_point").cast("double").alias("base"), names.unit_tokens("resource_name").alias("tokens"), names.key(names.plant_and_unit("resource_name")["plant"]).alias("plant"),
    )
    s, r = ([x.asDict() for x in df.collect()] for df in (s, r))
    texts = sorted({x["name"] for x in r} - {""})

    def close(text, least, top):
        return set(difflib.get_close_matches(text, texts, n=top, cutoff=least)) if text else set()

    best, strong = {}, set()
    for u in s:
        sets = [("code_exact", 230, "name", set(u["codes"])), ("code_key_exact", 220, "key", set(u["keys"])), ("unit_name_key_exact", 205, "key", {u["name_key"]}), ("resource_family", 120, "family", set(u["families"]))]
        sets += [("cdr_unit_code_fuzzy", 165, "name", close(u["code"], 0.82, 5)), ("unit_name_fuzzy", 135, "name", close(u["name"], 0.82, 5)), ("unit_name_strong_fuzzy", 190, "name", close(u["name"], 0.94, 3))]
        found = []
        for method, points, column, wanted in sets:
            for x in r:
                if x[column] and x[column] in wanted:
                    bonus = (12 if u["fuel"] and u["fuel"] == x["fuel"] else 0) + (15 if set(u["tokens"]) & set(x["tokens"]) else 0) + near(u["capacity"], x["base"], ((0.10, 8), (0.25, 4)))
                    found.append((points + bonus + int(18 * ratio(u["code"], x["name"])) + int(10 * ratio(u["name"], x["name"])), x["raw"], method))
        if found:
            score, name, method = max(found)
            best[u["unit_id"]] = (name, method, score, "ambiguous" if len({n for p, n, _ in found if p == score}) > 1 else "matched")
            if method.endswith("_exact") or (method == "unit_name_strong_fuzzy" and score >= 205):
                strong.add(u["unit_id"])
    groups, plants = defaultdict(list), defaultdict(list)
    for u in s:
        if u["unit_id"] not in strong and u["plant"]:
            groups[u["plant"]].append(u)
    for x in r:
        plants[x["plant"]].append(x)
    assigned = {}
    for plant, units in groups.items():
        options = [(180, 1.0, plant, "exact")] if plant in plants else []
        options += [(145, ratio(p, plant), p, "fuzzy") for p in difflib.get_close_matches(plant, sorted(set(plants) - {""}), n=3, cutoff=0.88) if p != plant]
        ranked = []
        for points, likeness, p, kind in options:
            fuels = ({u["fuel"] for u in units} & {x["fuel"] for x in plants[p]}) - {""}
            coded = sum(bool(u["code_key"]) and u["code_key"] in {x["key"] for x in plants[p]} for u in units)
            ranked.append((points + (10 if fuels else 0) + 30 * coded, points, likeness, p, kind))
        if not ranked:
            continue
        total, _, _, p, kind = max(ranked)
        score = {}
        for u in units:
            for x in plants[p]:
                points = (80 if set(u["tokens"]) & set(x["tokens"]) else 0) + (120 if u["code_key"] and u["code_key"] == x["key"] else 0) + (15 if u["fuel"] and u["fuel"] == x["fuel"] else 0)
                score[u["unit_id"], x["raw"]] = points + int(20 * ratio(u["code"], x["name"])) + near(u["capacity"], x["base"], ((0.10, 10), (0.25, 5)))
        taken, done = set(), {}
        for (unit, name), points in sorted(score.items(), key=lambda kv: (-kv[1], kv[0])):
            if points > 0 and unit not in done and name not in taken:
                done[unit] = (name, "distinct_unit_token_match")
                taken.add(name)
        rest = sorted({u["unit_id"] for u in units} - set(done))
        largest = [x["raw"] for x in sorted(plants[p], key=lambda x: (x["base"] is not None, x["base"] or 0, x["raw"]), reverse=True)]
        free = [n for n in largest if n not in taken]
        for k, unit in enumerate(rest):
            done[unit] = (largest[0], "highest_basepoint_reuse") if len(rest) > len(free) else (free[k], "highest_basepoint_unit")
        for unit, (name, method) in done.items():
            assigned[unit] = (name, f"plant_descriptor_{kind}:{method}", score[unit, name] + total, "matched")
    want = {}
    for u in s:
        k = u["unit_id"]
        want[k] = best[k] if k in strong else assigned.get(k) or best.get(k) or (None, None, None, "unmatched")
    got = {x["unit_id"]: tuple(x)[1:] for x in catalog.QUERIES["linked_registry_units"](spark, SF).collect()}
    assert got == want
    methods = {str(w[1]).split(":")[0] for w in want.values()}
    assert {"code_exact", "plant_descriptor_exact", "None"} <= methods, methods
