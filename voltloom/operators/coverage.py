"""What matching leaves behind: short forms of matches, states of resources, notes and reference codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.functions import names
from voltloom.functions.values import first_rule
from voltloom.operators.frames import complete, domain, shares, with_total

# States of what has no match, in their order, as reports name them.
UNMATCHED = {"unmatched": "Unmatched", "unmatched_cancelled": "Cancelled", "unmatched_retired": "Retired", "unmatched_inactive": "Inactive", "unmatched_in_progress": "In progress"}
LIFECYCLE = ("Operating", "Cancelled", "Retired", "Inactive", "In progress")
#: Names that a joined list shows at most (fixed value).
EXAMPLES = 10


def total_first(df: DataFrame, *keys: str, label: str = "ALL") -> DataFrame:
    """Ordered by the keys, rows of the total before all others."""
    return df.orderBy(*[o for k in keys for o in (F.col(k).eqNullSafe(label).desc(), F.col(k))])


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def simple_matches(matches: DataFrame, *, name: str = "resource_name", code: str = "rtlmp_name", source: str = "price_node_source", status: str = "status", capacity: str = "capacity_mw", listed: str = "yes_capacity_mw", keep: Sequence[str] = ("fuel_type",)) -> DataFrame:
    """A resource's price code and its source, empty unless matched or ambiguous; a missing capacity is the listed one."""
    settled = F.col(status).isin("matched", "ambiguous")
    size = F.coalesce(F.col(capacity), F.col(listed)) if listed in matches.columns else F.col(capacity)
    return matches.select(name, *keep, size.alias(capacity), *[F.when(settled, F.col(c)).otherwise(F.lit("")).alias(out) for c, out in ((code, "price_code"), (source, "price_node_source"))])


def reference_frame(matches: DataFrame, simple: DataFrame, units: DataFrame, *, unit_code: str = "unit_code") -> DataFrame:
    """Resources with their price codes in comparable forms and the registry's row of the same unit code."""
    coded = simple.select("resource_name", F.col("capacity_mw").alias("matched_capacity_mw"), "price_code", "price_node_source")
    made = matches.select("resource_name", "station_code", "station_desc", "generator_type", "capacity_mw", "fuel_type").join(coded, "resource_name", "left")
    made = made.withColumns(
        {
            "capacity_mw": F.coalesce("capacity_mw", "matched_capacity_mw"),
            "name_norm": names.clean("resource_name"),
            "name_key": names.key("resource_name"),
            "fuel_norm": names.fuel(F.when(_text("fuel_type") != "", F.col("fuel_type")).otherwise(F.col("generator_type"))),
            "unit_tokens": names.unit_tokens("resource_name"),
            "price_code_norm": names.clean("price_code"),
            "price_code_key": names.key("price_code"),
            "price_code_family": names.family("price_code"),
        }
    )
    return made.join(units.withColumn("name_norm", names.clean(unit_code)).filter("name_norm <> ''"), "name_norm", "left")


def technology_summary(matches: DataFrame, *, technology: str, status: str = "status", method: str = "method", node: str = "price_code", source: str = "price_node_source", exact: Sequence[str] = ("ercot_unitcode_exact", "ercot_unitcode_key_exact")) -> DataFrame:
    """Rows, matches and price nodes by technology with their shares; the most frequent technology first, the total last."""
    priced = _text(node) != ""
    facts = {
        "sced_matched": F.col(status).isin("matched", "ambiguous"), "sced_exact": F.col(method).isin(*exact), "sced_ambiguous": F.col(status) == "ambiguous", "sced_unmatched": F.col(status) == "unmatched",
        "price_matched": priced, "price_from_rtlmp_bus": F.col(source) == "rtlmp_bus", "price_from_rtlmp": F.col(source) == "rtlmp", "price_blank": ~priced,
    }
    rows = matches.withColumn("__kind", F.when(names.clean(technology) != "", names.clean(technology)).otherwise("UNKNOWN"))
    made = with_total(rows, "__kind", [F.count("*").alias("rows_total"), *[F.count_if(c).alias(f"rows_{n}") for n, c in facts.items()], F.grouping("__kind").alias("__last")])
    made = made.withColumns({f"pct_{n}": F.round(F.try_divide(f"rows_{n}", "rows_total"), 4) for n in ("sced_matched", "sced_exact", "sced_ambiguous", "price_matched")})
    return made.withColumnRenamed("__kind", "technology").orderBy("__last", F.desc("rows_total"), "technology").drop("__last")


def resource_states(resources: DataFrame, matches: DataFrame, excused: DataFrame, *, name: str, plant: str, kind: str, matched: Sequence[str], matched_plant: str, excused_plant: str) -> dict[str, DataFrame]:
    """The state of every resource and the summary by kind.

    A resource that any of the columns ``matched`` names is ``used``; all others
    are ``missing``, ``missing_extra_sced`` where their plant has matches but
    fewer than resources, and ``missing_pun``, which overrides both, where the
    plant is ``excused``. Names and plants meet by their letters and digits.
    """
    used = matches.select(F.explode(F.array(*[names.key(c) for c in matched])).alias("resource_key")).filter("resource_key <> ''").distinct()
    detail = resources.withColumns({"resource_key": names.key(name), "plant_key": names.key(plant)})
    detail = detail.join(used.withColumn("__used", F.lit(True)), "resource_key", "left").withColumn("is_used", F.coalesce("__used", F.lit(False))).drop("__used")
    others = excused.select(names.key(excused_plant).alias("plant_key")).filter("plant_key <> ''").distinct().withColumn("is_excused", F.lit(True))
    met = matches.filter(_text(matched[0]) != "").groupBy(names.key(matched_plant).alias("plant_key")).agg(F.count("*").alias("rows_matched"))
    plants = detail.groupBy("plant_key").agg(F.count("*").alias("units"), F.count_if("is_used").alias("units_used")).join(met, "plant_key", "left").join(others, "plant_key", "left")
    plants = plants.select("plant_key", "units", "units_used", (F.col("units") - F.col("units_used")).alias("units_missing"), F.coalesce("rows_matched", F.lit(0)).alias("rows_matched"), F.coalesce("is_excused", F.lit(False)).alias("is_excused"))
    detail = detail.join(plants, "plant_key").withColumn("has_extra", (F.col("rows_matched") > 0) & (F.col("units") > F.col("rows_matched")))
    state = first_rule((F.col("is_used"), "used"), (F.col("is_excused"), "missing_pun"), (F.col("has_extra"), "missing_extra_sced"), otherwise="missing")
    detail = detail.withColumn("state", state)
    states = ("used", "missing", "missing_pun", "missing_extra_sced")
    summary = with_total(detail, kind, [F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in states]])
    summary = summary.withColumns({f"pct_{s}": F.round(F.try_divide(s, "total"), 4) for s in states})
    return {"detail": detail, "summary": total_first(summary, kind)}


def unmatched_by_fuel(matches: DataFrame, fuel: str, status: str) -> DataFrame:
    """Unmatched rows by fuel and state, every combination present, with the fuel's total and shares."""
    rows = matches.filter(F.col(status).isin(*UNMATCHED)).select(F.when(_text(fuel) != "", _text(fuel)).otherwise("UNKNOWN").alias("fuel"), F.col(status).alias("state"))
    made = complete(rows.groupBy("fuel", "state").agg(F.count("*").alias("rows")), [rows.select("fuel").distinct(), domain(matches.sparkSession, "state", list(UNMATCHED))], {"rows": 0})
    return _with_share(made, "rows", list(UNMATCHED)).withColumn("label", F.create_map(*[F.lit(x) for pair in UNMATCHED.items() for x in pair])[F.col("state")])


def lifecycle_by_fuel(units: DataFrame, fuel: str, state: str, capacity: str) -> DataFrame:
    """Units and capacity by fuel and state of life, every combination present, with shares of the fuel's capacity."""
    rows = units.select(F.when(_text(fuel) != "", _text(fuel)).otherwise("UNKNOWN").alias("fuel"), F.col(state).alias("state"), F.col(capacity).cast("double").alias("__mw"))
    sums = rows.groupBy("fuel", "state").agg(F.count("*").alias("rows"), F.sum("__mw").alias("capacity"))
    made = complete(sums, [rows.select("fuel").distinct(), domain(units.sparkSession, "state", LIFECYCLE)], {"rows": 0, "capacity": 0.0})
    return _with_share(made, "capacity", LIFECYCLE)


def _with_share(made: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    made = shares(made, ["fuel"], value).withColumn("share", F.round(F.coalesce("share", F.lit(0.0)), 4))
    totals = made.groupBy("fuel").agg(F.sum(value).alias("fuel_total"))
    return made.join(totals, "fuel").withColumn("state_order", F.array_position(F.array(*map(F.lit, order)), F.col("state")))


def plant_unit_lists(matches: DataFrame, resources: DataFrame, *, node: str, name: str = "resource_name", limit: int = EXAMPLES) -> DataFrame:
    """``matches`` with the first names of the resources of the matched node's plant, in alphabetical order."""
    lists = resources.filter(_text(name) != "").select(names.plant_id(name).alias("__plant"), _text(name).alias("__name")).distinct()
    lists = lists.groupBy("__plant").agg(F.array_join(F.slice(F.array_sort(F.collect_list("__name")), 1, limit), " | ").alias("plant_units"))
    made = matches.withColumn("__plant", F.when(_text(node) != "", names.plant_id(node))).join(lists, "__plant", "left")
    return made.withColumn("plant_units", F.coalesce("plant_units", F.lit(""))).drop("__plant")


def repeated_node_notes(matches: DataFrame, resources: DataFrame, *, node: str, name: str = "resource_name", base: str = "avg_base_point") -> DataFrame:
    """``matches`` with a note where several rows have the same node: the node and its mean base point, if known."""
    again = matches.filter(_text(node) != "").groupBy(_text(node).alias("__node")).count().filter("count > 1")
    points = resources.groupBy(F.col(name).alias("__node")).agg(F.max(F.col(base).cast("double")).alias("__base"))
    notes = again.join(points, "__node", "left").select("__node", F.concat("__node", F.coalesce(F.format_string(" | avg_base_point=%.6f", "__base"), F.lit(""))).alias("node_note"))
    notes = notes.withColumn("node_note", F.coalesce("node_note", "__node"))
    made = matches.withColumn("__node", _text(node)).join(notes, "__node", "left")
    return made.withColumn("node_note", F.coalesce("node_note", F.lit(""))).drop("__node")


def reference_codes(matches: DataFrame, listed: DataFrame, *, status: str, code: str, name: str, listed_code: str, listed_name: str, order: str) -> DataFrame:
    """``matches`` with the listed code of unmatched rows: by code, then by its key, then by name, then by its key.

    Of listed rows that meet in a form the first in ``order`` counts.
    """
    made, found = matches, []
    for k, (mine, theirs, form) in enumerate((m, t, f) for m, t in ((code, listed_code), (name, listed_name)) for f in (names.clean, names.key)):
        codes = listed.select(form(theirs).alias(f"__k{k}"), F.struct(order, F.col(listed_code).alias("code")).alias("__s")).filter(f"__k{k} <> ''")
        codes = codes.groupBy(f"__k{k}").agg(F.min("__s").getField("code").alias(f"__c{k}"))
        wanted = F.when((F.col(status) == "unmatched") & (form(mine) != ""), form(mine))
        made = made.withColumn(f"__k{k}", wanted).join(codes, f"__k{k}", "left").drop(f"__k{k}")
        found.append(f"__c{k}")
    return made.withColumn("reference_code", F.coalesce(*found, F.lit(""))).drop(*found)


def price_values(offers: DataFrame, *, by_step: bool = False, least: int = 5) -> DataFrame:
    """Finite price values in long form by type, or by type and step, of groups with ``least`` values or more."""
    keys = ["resource_type", "step"] if by_step else ["resource_type"]
    price = F.col("price").cast("double")
    rows = offers.withColumn("resource_type", F.coalesce("resource_type", F.lit("Unknown"))).filter(price.isNotNull() & ~F.isnan(price) & (F.abs(price) < float("inf")))
    enough = rows.groupBy(*keys).count().filter(F.col("count") >= least).drop("count")
    return rows.join(enough, keys, "left_semi").select(*keys, price.alias("price"))
