"""The three linkages of generating units, each a set of rules, bonuses and a decision.

Rules say which columns must be equal (or close) and what that is worth; the
joins, the deduplication and the choice are those of ``linkage``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltloom.functions import names
from voltloom.functions.values import first_rule
from voltloom.operators import linkage
from voltloom.operators.frames import first_by, top_k
from voltloom.operators.linkage import Rule
from voltloom.sources.folders import Workspace

# What each way of meeting is worth, and from which similarity texts are close.
STATION_NODE = {"exact": 180, "key": 170, "substring": 150, "prefix": 145, "reverse_prefix": 140, "family": 135, "fuzzy": 125}
BRIDGED_NODE = {"exact": 160, "key": 155, "substring": 150, "prefix": 145, "reverse_prefix": 140, "family": 130, "fuzzy": 120}
LISTED_NODE = {"desc_exact": (95, 70), "desc_fuzzy": (70, 50), "node_exact": (85, 60), "node_family": (55, 40)}
FALLBACK_NODE = {"unmatched_desc_exact": (90, 70), "unmatched_desc_fuzzy": (75, 55)}
NODE_CLOSE, PLANT_CLOSE, LATE_PLANT_CLOSE = 0.70, 0.88, 0.82
FAMILY_ROWS = 20
LATE_RULE = Rule("ercot_unitcode_fuzzy_late", 135, "m_code", "r_name", 0.72, 8)
MODEL_RULES = [
    Rule("ercot_unitcode_exact", 220, "m_code", "r_name"), Rule("ercot_unitcode_key_exact", 210, "m_key", "r_key"), Rule("ercot_unitcode_fuzzy", 165, "m_code", "r_name", 0.82, 5),
    LATE_RULE, Rule("cdr_unit_name_exact", 185, "m_base", "r_cdr"), Rule("cdr_unit_name_fuzzy", 150, "m_base", "r_cdr", 0.84, 5),
    Rule("name_base_exact_station_desc", 180, "m_base", "r_desc"), Rule("name_base_fuzzy_station_desc", 145, "m_base", "r_desc", 0.82, 5),
    Rule("cdr_name_exact_station_desc", 150, "m_cdr", "r_desc"), Rule("cdr_name_fuzzy_station_desc", 125, "m_cdr", "r_desc", 0.86, 5),
]
LISTED_PLANT_RULES = [
    Rule("yes_name_base_exact", 145, "m_base", "plant"), Rule("yes_name_base_fuzzy", 125, "m_base", "plant", 0.84, 5),
    Rule("yes_cdr_name_exact", 135, "m_cdr", "plant"), Rule("yes_cdr_name_fuzzy", 115, "m_cdr", "plant", 0.84, 5),
]
REGISTRY_RULES = [
    Rule("sb_cdr_unit_code_exact", 205, "m_code", "s_code"), Rule("sb_cdr_unit_code_key_exact", 198, "m_key", "s_key"),
    Rule("sb_unit_name_exact", 185, "m_name", "s_name"), Rule("sb_unit_name_key_exact", 178, "m_name_key", "s_name_key"),
]


def _by_family(asked: DataFrame, nodes: DataFrame, text: str, stage: str, worth: dict[str, int], top: int) -> DataFrame:
    """Candidates of ``asked`` (``resource_name`` and a name in ``text``) among price nodes: equal names, then kinds of kinship within the family, then closeness."""
    a = asked.select("resource_name", F.col(text).alias("__t"), names.key(text).alias("__k"), names.family(text).alias("__f")).filter("__t <> ''").distinct()
    n = nodes.select("rtlmp_name", names.clean("rtlmp_name").alias("__n"), names.key("rtlmp_name").alias("__nk"), names.family("rtlmp_name").alias("__nf"))
    exact = a.join(n, F.col("__t") == F.col("__n")).withColumn("kind", F.lit("exact"))
    key = a.join(n, F.col("__k") == F.col("__nk")).filter("__k <> ''").withColumn("kind", F.lit("key"))
    few = n.withColumn("__r", F.row_number().over(W.partitionBy("__nf").orderBy("rtlmp_name"))).filter(F.col("__r") <= FAMILY_ROWS).drop("__r")
    kin = first_rule(
        (F.col("__n").contains(F.col("__t")) | F.col("__t").contains(F.col("__n")), "substring"), ((F.col("__k") != "") & F.col("__nk").startswith(F.col("__k")), "prefix"),
        ((F.col("__k") != "") & F.col("__k").startswith(F.col("__nk")), "reverse_prefix"), otherwise="family",
    )
    family = a.join(few, F.col("__f") == F.col("__nf")).filter("__f <> ''").withColumn("kind", kin)
    close = linkage.close_matches(a.withColumn("__p", linkage.prefixes("__t")), n.withColumn("__p", linkage.prefixes("__n")), "__t", "__n", least=NODE_CLOSE, top=top, block=("__p", "__p"))
    fuzzy = a.join(close, F.col("__t") == F.col("__a")).join(n, F.col("__b") == F.col("__n")).drop("__a", "__b", "ratio").withColumn("kind", F.lit("fuzzy"))
    made = exact.unionByName(key).unionByName(family).unionByName(fuzzy)
    score = first_rule(*[(F.col("kind") == k, F.lit(v)) for k, v in worth.items()])
    return made.select("resource_name", "rtlmp_name", F.lit(None).cast("string").alias("yes_nodename"), F.concat_ws("_", F.lit(stage), "kind").alias("method"), score.alias("score"), F.lit("").alias("yes_fuel"), F.lit(None).cast("double").alias("yes_capacity"))


def _by_listing(pairs: DataFrame, nodes: DataFrame, method: Column, exact: Column, family: Column) -> DataFrame:
    """Price nodes of listed units (``resource_name, yes_nodename, yes_fuel, yes_capacity``) by the node they name."""
    p = pairs.withColumns({"__m": method, "__e": exact, "__s": family, "__y": names.clean("yes_nodename")})
    n = nodes.select("rtlmp_name", names.clean("rtlmp_name").alias("__n"), names.key("rtlmp_name").alias("__nk"), names.family("rtlmp_name").alias("__nf"))
    few = n.withColumn("__r", F.row_number().over(W.partitionBy("__nf").orderBy("rtlmp_name"))).filter(F.col("__r") <= FAMILY_ROWS).drop("__r")
    parts = [
        p.join(n, F.col("__y") == F.col("__n")).withColumns({"method": F.col("__m"), "score": F.col("__e")}),
        p.join(n, names.key("yes_nodename") == F.col("__nk")).withColumns({"method": F.concat("__m", F.lit("_key")), "score": F.col("__e") - 5}),
        p.join(few, names.family("yes_nodename") == F.col("__nf")).withColumns({"method": F.concat("__m", F.lit("_family")), "score": F.col("__s")}),
    ]
    made = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("__y <> ''")
    return made.select("resource_name", "rtlmp_name", "yes_nodename", "method", "score", "yes_fuel", "yes_capacity")


def price_node_candidates(resources: DataFrame, listed: DataFrame, nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """All price nodes that a resource may stand for, with method and score.

    ``resources``: resource_name, fuel_type, station_code, station_desc,
    generator_type, capacity_mw; ``listed``: plantname, nodename, primaryfuel,
    capacity; ``nodes``: rtlmp_name; ``mapping``: resource_node, unit_substation,
    unit_name. Equal fuels and near capacities add to the score of listed units.
    """
    res = resources.withColumns({"code": names.clean("station_code"), "desc": names.clean("station_desc"), "name": names.clean("resource_name"), "stems": names.stems("resource_name")})
    bridge = mapping.select(names.clean(F.concat_ws("_", "unit_substation", "unit_name")).alias("__key"), names.clean("resource_node").alias("node"))
    station = _by_family(res, nodes, "code", "station_code", STATION_NODE, 8)
    bridged = _by_family(res.join(bridge, F.col("name") == F.col("__key")).select("resource_name", "node"), nodes, "node", "resource_node", BRIDGED_NODE, 5)
    yes = listed.select(names.clean("plantname").alias("plant"), F.col("nodename").alias("yes_nodename"), names.fuel("primaryfuel").alias("yes_fuel"), F.col("capacity").cast("double").alias("yes_capacity"), names.clean("nodename").alias("__node"), names.family("nodename").alias("__family"))
    keep = ["resource_name", "yes_nodename", "yes_fuel", "yes_capacity"]
    by_desc = res.join(yes, F.col("desc") == F.col("plant")).filter("desc <> ''").select(*keep, F.lit("desc_exact").alias("way"))
    close = linkage.close_matches(res, yes, "desc", "plant", least=PLANT_CLOSE, top=3).filter("__a <> __b")
    by_close = res.join(close, F.col("desc") == F.col("__a")).join(yes, F.col("__b") == F.col("plant")).select(*keep, F.lit("desc_fuzzy").alias("way"))
    forms = F.flatten(F.transform(F.concat(F.array("code"), "stems"), lambda x: F.array(x, F.concat(x, F.lit("_ALL")), F.concat(x, F.lit("_RN")))))
    patterns = res.select("resource_name", F.explode(F.array_distinct(forms)).alias("pattern")).filter("pattern not in ('', '_ALL', '_RN')")
    by_node = patterns.join(yes, F.col("pattern") == F.col("__node")).select(*keep, F.lit("node_exact").alias("way"))
    families = patterns.select("resource_name", names.family("pattern").alias("__f")).distinct()
    few = top_k(yes, ["__family"], [F.asc("yes_nodename")], 12, "__r").drop("__r")
    by_family = families.join(few, F.col("__f") == F.col("__family")).select(*keep, F.lit("node_family").alias("way"))
    pairs = by_desc.unionByName(by_close).unionByName(by_node).unionByName(by_family).distinct()
    worth = {k: first_rule(*[(F.col("way") == w, F.lit(v[k])) for w, v in LISTED_NODE.items()]) for k in (0, 1)}
    found = station.unionByName(bridged).unionByName(_by_listing(pairs, nodes, F.concat("way", F.lit("_to_yes_node")), worth[0], worth[1]))
    found = found.dropDuplicates(["resource_name", "method", "yes_nodename", "rtlmp_name"]).join(res.select("resource_name", names.fuel("fuel_type").alias("fuel"), names.clean("generator_type").alias("kind"), "capacity_mw").dropDuplicates(["resource_name"]), "resource_name")
    total = F.col("score") + linkage.fuel_bonus("fuel", "yes_fuel", kind="kind") + F.when(F.col("yes_capacity").isNotNull(), linkage.capacity_bonus("capacity_mw", "yes_capacity")).otherwise(0)
    return found.withColumn("score", total).drop("fuel", "kind", "capacity_mw")


def match_price_nodes(resources: DataFrame, listed: DataFrame, nodes: DataFrame, mapping: DataFrame, second_nodes: DataFrame | None = None) -> DataFrame:
    """Each resource's price node: best candidate, then a looser look at its description, then another list of nodes, then its station's best."""
    key = ["resource_name"]

    def decided(found: DataFrame) -> DataFrame:
        return linkage.with_unmatched(resources, linkage.decide(found, key, "rtlmp_name", ties=["yes_nodename"]), key)

    columns = ["rtlmp_name", "yes_nodename", "method", "score", "status", "candidate_count", "alternatives"]
    best = decided(price_node_candidates(resources, listed, nodes, mapping))
    asked = resources.select("resource_name", names.clean("station_desc").alias("desc"))
    yes = listed.select(names.clean("plantname").alias("plant"), F.col("nodename").alias("yes_nodename"), names.fuel("primaryfuel").alias("yes_fuel"), F.col("capacity").cast("double").alias("yes_capacity"))
    close = linkage.close_matches(asked, yes, "desc", "plant", least=LATE_PLANT_CLOSE, top=3)
    pairs = asked.join(close, F.col("desc") == F.col("__a")).join(yes, F.col("__b") == F.col("plant")).withColumn("way", F.when(F.col("desc") == F.col("plant"), "unmatched_desc_exact").otherwise("unmatched_desc_fuzzy"))
    worth = {k: first_rule(*[(F.col("way") == w, F.lit(v[k])) for w, v in FALLBACK_NODE.items()]) for k in (0, 1)}
    best = linkage.fall_back(best, decided(_by_listing(pairs, nodes, F.col("way"), worth[0], worth[1])), key, columns)
    if second_nodes is not None:
        best = linkage.fall_back(best, decided(price_node_candidates(resources, listed, second_nodes, mapping)), key, columns)
    best = best.join(resources.select("resource_name", names.clean("station_code").alias("station")).dropDuplicates(key), key)
    return linkage.spread_in_group(best, "station", ["rtlmp_name", "yes_nodename", "method"], tie="rtlmp_name")


def match_model_units(model: DataFrame, resources: DataFrame, listed: DataFrame | None = None, registry_matches: DataFrame | None = None, *, listed_order: str = "nodename") -> DataFrame:
    """Production-model units (``unit_id, name, cdr_name, unit_code, county, fuel``) to resources.

    ``resources``: resource_name, station_desc, cdr_unit_name, fuel_type, county,
    price_code. Codes come first, then names of units and stations, exact and
    close, with bonuses for fuel, county, price node, similarity and unit hints.
    Units without a match then go by way of ``listed`` plants (plantname,
    nodename; of a plant's nodes the first in ``listed_order``) to the resources
    of the plant's price node, and last by way of ``registry_matches``
    (unit_code, unit_name, county, fuel, resource_name, status) to the resource
    that the registry's unit has.
    """
    key = ["unit_id"]
    parts = names.model_name_parts("name")
    m = model.withColumn("__parts", parts).select("unit_id", names.clean("unit_code").alias("m_code"), names.key("unit_code").alias("m_key"), names.clean("cdr_name").alias("m_cdr"), F.col("__parts.base").alias("m_base"), F.col("__parts.unit_hint").alias("m_hint"), names.clean("name").alias("m_name"), names.key("name").alias("m_name_key"), names.fuel("fuel").alias("m_fuel"), names.clean("county").alias("m_county"))
    r = resources.select("resource_name", names.clean("resource_name").alias("r_name"), names.key("resource_name").alias("r_key"), names.clean("station_desc").alias("r_desc"), names.clean("cdr_unit_name").alias("r_cdr"), names.fuel("fuel_type").alias("r_fuel"), names.clean("county").alias("r_county"), "price_code", names.unit_tokens("resource_name").alias("r_tokens"))
    # the forms of names are worked out once, not in each rule
    space = Workspace(model.sparkSession, "model-units")
    m, r = space.settle(m, "units"), space.settle(r, "resources")
    # units that differ in nothing but their name here are looked up once
    m, members = (space.settle(df, part) for df, part in zip(linkage.stand_ins(m, "unit_id"), ("asking", "members"), strict=True))
    grouped = space.settle(r.withColumn("r_group", F.count("*").over(W.partitionBy("r_desc"))), "grouped")
    found = linkage.candidates(m, grouped, [q for q in MODEL_RULES if q is not LATE_RULE])
    # the late look at codes counts only where no other code rule found anything
    coded = space.settle(found.filter(F.col("method").startswith("ercot_unitcode")).select("unit_id").distinct(), "coded")
    found = found.unionByName(linkage.candidates(m.join(coded, "unit_id", "left_anti"), grouped, [LATE_RULE]))
    by_code = F.col("method").startswith("ercot_unitcode")

    def decided(found: DataFrame) -> DataFrame:
        return members.join(_decided(found).withColumnRenamed("unit_id", "__first"), "__first").drop("__first")

    best = linkage.with_unmatched(model, decided(found.withColumn("r_group", F.when(~by_code, F.col("r_group")))), key)
    columns = ["resource_name", "price_code", "method", "score", "status", "candidate_count", "alternatives"]
    if listed is not None:
        best = linkage.fall_back(best, decided(_by_listed_plant(m, r, listed, listed_order)), key, columns)
    if registry_matches is not None:
        best = linkage.fall_back(best, decided(_by_registry(m, r, registry_matches)), key, columns)
    return best


def _decided(found: DataFrame) -> DataFrame:
    """The best candidate of each model unit; a unit hint counts where ``r_group``, the size of the resource's group, is known."""
    spark = found.sparkSession
    # a set number of tasks shares the comparison of texts, and its result is read several times
    found = found.repartition(max(1, 4 * spark.sparkContext.defaultParallelism))
    hint = F.when(F.col("r_group").isNotNull(), linkage.unit_hint_bonus("m_hint", "r_tokens", F.col("r_group"))).otherwise(0)
    bonus = F.when((F.col("m_fuel") != "") & (F.col("m_fuel") == F.col("r_fuel")), 10).otherwise(0) + F.when((F.col("m_county") != "") & (F.col("m_county") == F.col("r_county")), 12).otherwise(0) + F.when(F.coalesce("price_code", F.lit("")) != "", 5).otherwise(0)
    close = linkage.similarity_bonuses(("m_code", "r_name", 20), ("m_cdr", "r_desc", 12), ("m_name", "r_desc", 8), ("m_base", "r_cdr", 14))
    scored = found.select("unit_id", "resource_name", "price_code", "method", (F.col("score") + hint + bonus + close).alias("score"))
    return linkage.decide(Workspace(spark, "scored").settle(scored, "scored"), ["unit_id"], "resource_name")


def _by_listed_plant(m: DataFrame, r: DataFrame, listed: DataFrame, order: str) -> DataFrame:
    """Candidates through plants of the unit's names: the resources whose price code is the plant's node, or kin to it."""
    plants = listed.select(names.clean("plantname").alias("plant"), F.col(order).alias("__order"), names.clean("nodename").alias("node"), names.key("nodename").alias("node_key"), names.family("nodename").alias("node_family"))
    plants = first_by(plants.filter("plant <> ''"), ["plant"], ["__order", "node"]).drop("__order").filter("node <> ''")
    met = linkage.candidates(m, plants, LISTED_PLANT_RULES)
    own = F.when(F.col("method").startswith("yes_name_base"), F.col("m_base")).otherwise(F.col("m_cdr"))
    met = met.filter(~(F.col("method").endswith("_fuzzy") & (F.col("plant") == own)))
    made = None
    for kind, (form, node, more) in {"price_exact": (names.clean, "node", 20), "price_key": (names.key, "node_key", 15), "price_family": (names.family, "node_family", 0)}.items():
        coded = r.withColumn("__form", form("price_code")).filter("__form <> ''")
        coded = coded.join(coded.groupBy("__form").agg(F.count("*").alias("r_group")), "__form")
        part = met.join(coded, F.col(node) == F.col("__form")).drop("__form").withColumns({"method": F.concat_ws("_", "method", F.lit(kind)), "score": F.col("score") + more})
        made = part if made is None else made.unionByName(part)
    return made.dropDuplicates(["unit_id", "method", "resource_name"])


def _by_registry(m: DataFrame, r: DataFrame, matches: DataFrame) -> DataFrame:
    """Candidates through matched registry units of the same code, or of the same name and the same county or fuel."""
    s = matches.filter((F.col("status") == "matched") & (names.clean("resource_name") != "")).select(names.clean("unit_code").alias("s_code"), names.key("unit_code").alias("s_key"), names.clean("unit_name").alias("s_name"), names.key("unit_name").alias("s_name_key"), names.clean("county").alias("s_county"), names.fuel("fuel").alias("s_fuel"), names.clean("resource_name").alias("s_node"))
    met = linkage.candidates(m, s, REGISTRY_RULES)
    aligned = ((F.col("m_county") != "") & (F.col("m_county") == F.col("s_county"))) | ((F.col("m_fuel") != "") & (F.col("m_fuel") == F.col("s_fuel")))
    met = met.filter(F.col("method").startswith("sb_cdr_unit_code") | aligned)
    made = met.join(r, F.col("s_node") == F.col("r_name")).withColumn("r_group", F.lit(None).cast("long"))
    return made.dropDuplicates(["unit_id", "method", "resource_name"])


def choose_plants(units: DataFrame, resources: DataFrame) -> DataFrame:
    """``s_plant, r_plant, plant_method, plant_score``: the plant of resources that each group of units belongs to.

    Candidates are the plant of the same descriptor (180 points) and the three
    closest ones (145). A fuel that both groups have adds 10, and each unit whose
    code is the name of one of the plant's resources 30. The best total wins;
    ties go to the same descriptor, then to the closest. Group pairs are scored by
    what their members share, so no unit meets every resource.
    """
    same = units.select("s_plant").distinct().join(resources.select("r_plant").distinct(), F.col("s_plant") == F.col("r_plant")).select("s_plant", "r_plant", F.lit("plant_descriptor_exact").alias("plant_method"), F.lit(180).alias("points"), F.lit(1.0).alias("ratio"))
    close = linkage.close_matches(units, resources, "s_plant", "r_plant", least=0.88, top=3).filter("__a <> __b")
    met = same.unionByName(close.select(F.col("__a").alias("s_plant"), F.col("__b").alias("r_plant"), F.lit("plant_descriptor_fuzzy").alias("plant_method"), F.lit(145).alias("points"), "ratio"))
    ours, theirs = (df.select(plant, F.col(fuel).alias("fuel")).filter("fuel <> ''").distinct() for df, plant, fuel in ((units, "s_plant", "s_fuel"), (resources, "r_plant", "r_fuel")))
    fuels = met.select("s_plant", "r_plant").join(ours, "s_plant").join(theirs, ["r_plant", "fuel"]).select("s_plant", "r_plant").distinct().withColumn("shared", F.lit(10))
    named = units.filter("s_code_key <> ''").join(resources.select("r_plant", F.col("r_key").alias("s_code_key")).distinct(), "s_code_key").groupBy("s_plant", "r_plant").agg(F.countDistinct("unit_id").alias("named"))
    pair = ["s_plant", "r_plant"]
    scored = met.join(fuels, pair, "left").join(named, pair, "left").withColumn("plant_score", (F.col("points") + F.coalesce("shared", F.lit(0)) + 30 * F.coalesce("named", F.lit(0))).cast("int"))
    best = top_k(scored, ["s_plant"], [F.desc("plant_score"), F.desc("points"), F.desc("ratio"), F.desc("r_plant")], 1, "__r")
    return Workspace(units.sparkSession, "plants").settle(best.select(*pair, "plant_method", "plant_score"), "chosen")


def match_registry_units(registry: DataFrame, resources: DataFrame) -> DataFrame:
    """Registry units (``unit_id, unit_name, codes, fuel, capacity``) to resources (``resource_name, resource_type, avg_base_point``).

    Strong direct matches stand; the other units of a plant descriptor together
    choose a plant of resources (``choose_plants``) and are matched one to one
    within it, by a method of the form ``plant_descriptor_exact:...`` or
    ``plant_descriptor_fuzzy:...``; what is left takes its best candidate.
    ``codes`` is an array, the unit code first.
    """
    code = F.coalesce(F.get("codes", F.lit(0)), F.lit(""))
    s = registry.select("unit_id", names.clean("unit_name").alias("s_name"), names.key("unit_name").alias("s_name_key"), names.clean(code).alias("s_code"), names.key(code).alias("s_code_key"), F.transform("codes", names.clean).alias("s_codes"), F.transform("codes", names.key).alias("s_keys"), F.transform("codes", names.family).alias("s_families"), names.fuel("fuel", names.RESOURCE_FUELS).alias("s_fuel"), F.col("capacity").cast("double").alias("s_capacity"), F.array_distinct(F.concat(names.unit_tokens("unit_name"), names.unit_tokens(code))).alias("s_tokens"), names.key(names.plant_and_unit(F.when(code != "", code).otherwise(F.col("unit_name")))["plant"]).alias("s_plant"))
    r = resources.select("resource_name", names.clean("resource_name").alias("r_name"), names.key("resource_name").alias("r_key"), names.family("resource_name").alias("r_family"), names.fuel("resource_type", names.RESOURCE_FUELS).alias("r_fuel"), F.col("avg_base_point").cast("double").alias("r_base"), names.unit_tokens("resource_name").alias("r_tokens"), names.key(names.plant_and_unit("resource_name")["plant"]).alias("r_plant"))
    space = Workspace(registry.sparkSession, "registry")
    s, r = space.settle(s, "units"), space.settle(r, "resources")
    tasks = max(1, 4 * registry.sparkSession.sparkContext.defaultParallelism)
    rules = [
        Rule("code_exact", 230, "s_codes", "r_name"), Rule("code_key_exact", 220, "s_keys", "r_key"), Rule("unit_name_key_exact", 205, "s_name_key", "r_key"), Rule("resource_family", 120, "s_families", "r_family"),
        Rule("cdr_unit_code_fuzzy", 165, "s_code", "r_name", 0.82, 5), Rule("unit_name_fuzzy", 135, "s_name", "r_name", 0.82, 5), Rule("unit_name_strong_fuzzy", 190, "s_name", "r_name", 0.94, 3),
    ]
    shared = F.arrays_overlap("s_tokens", "r_tokens")
    same_fuel = (F.col("s_fuel") != "") & (F.col("s_fuel") == F.col("r_fuel"))
    bonus = F.when(same_fuel, 12).otherwise(0) + F.when(shared, 15).otherwise(0) + linkage.relative_bonus("s_capacity", "r_base") + linkage.similarity_bonuses(("s_code", "r_name", 18), ("s_name", "r_name", 10))
    # units that differ in nothing but their name here are looked up once
    alone, members = (space.settle(df, part) for df, part in zip(linkage.stand_ins(s, "unit_id"), ("asking", "members"), strict=True))
    found = space.settle(linkage.candidates(alone, r, rules).repartition(tasks).select("unit_id", "resource_name", "method", (F.col("score") + bonus).alias("score")), "scored")
    best = space.settle(members.join(linkage.decide(found, ["unit_id"], "resource_name").withColumnRenamed("unit_id", "__first"), "__first").drop("__first"), "best")
    strong = best.filter(F.col("method").endswith("_exact") | ((F.col("method") == "unit_name_strong_fuzzy") & (F.col("score") >= 205)))
    # units without a strong match look for a plant together, those of one descriptor as one group
    asking = s.join(strong.select("unit_id"), "unit_id", "left_anti").filter("s_plant <> ''")
    plants = choose_plants(asking, r)
    pairs = asking.join(plants, "s_plant").join(r, "r_plant").repartition(tasks)
    points = F.when(shared, 80).otherwise(0) + F.when((F.col("s_code_key") != "") & (F.col("s_code_key") == F.col("r_key")), 120).otherwise(0) + F.when(same_fuel, 15).otherwise(0) + linkage.similarity_bonus("s_code", "r_name", 20) + linkage.relative_bonus("s_capacity", "r_base", ((0.10, 10), (0.25, 5)))
    pairs = pairs.select(F.col("s_plant").alias("plant"), "unit_id", "resource_name", points.alias("points"), F.col("r_base").alias("base"))
    assigned = linkage.assign_one_to_one(pairs, "plant", "unit_id", "resource_name", "points", "base").join(plants, F.col("plant") == F.col("s_plant"))
    assigned = assigned.select("unit_id", "resource_name", F.concat_ws(":", "plant_method", F.when(F.col("method") == "token", "distinct_unit_token_match").otherwise(F.col("method"))).alias("method"), (F.col("score") + F.col("plant_score")).alias("score"), F.lit("matched").alias("status"))
    columns = ["unit_id", "resource_name", "method", "score", "status"]
    rest = best.join(strong.select("unit_id"), "unit_id", "left_anti").join(assigned.select("unit_id"), "unit_id", "left_anti")
    made = strong.select(*columns).unionByName(assigned.select(*columns)).unionByName(rest.select(*columns))
    return registry.select("unit_id").join(made, "unit_id", "left").withColumn("status", F.coalesce("status", F.lit("unmatched")))
