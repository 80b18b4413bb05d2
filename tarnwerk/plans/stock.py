"""Stock plans: from marginal tables to archetypes, renovation states and technology variants.

Each function takes and returns DataFrames and nothing is collected; the class tables are small by
nature, and every join is on their keys, so Spark picks broadcasts by their size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_code, decimal_comma, lookup, number_or_zero, percent_text
from ..operators import alloc, checks, fanout

#: Classes of dwellings and construction periods, and the bridges between source classes
#: and them as (source, target, weight).
TYPES = ("Detached house", "Semi-detached house", "Terraced house", "Apartment, enclosed", "Apartment, exposed")
PERIODS = ("pre-1946", "1946-1970", "1971-1990", "1991-2005", "post-2005")
TYPE_BRIDGE = (("R1", "Terraced house", 1.0), ("R2", "Semi-detached house", 1.0), ("R3", "Detached house", 1.0), ("R4", "Apartment, enclosed", 0.5), ("R4", "Apartment, exposed", 0.5))
PERIOD_BRIDGE = (
    ("Before 1919", "pre-1946", 1.0), ("1919-1945", "pre-1946", 1.0), ("1946-1970", "1946-1970", 1.0), ("1971-1990", "1971-1990", 1.0),
    ("1991-2000", "1991-2005", 1.0), ("2001-2010", "1991-2005", 0.5), ("2001-2010", "post-2005", 0.5), ("2011 onwards", "post-2005", 1.0),
)
V50_COLUMNS = {
    "detached_house_v50_m3_h_m2": "Detached house", "semi_detached_house_v50_m3_h_m2": "Semi-detached house", "terraced_house_v50_m3_h_m2": "Terraced house",
    "apartment_enclosed_v50_m3_h_m2": "Apartment, enclosed", "apartment_exposed_v50_m3_h_m2": "Apartment, exposed",
}
YEARS_ELAPSED = 25
STATES = ("as_is_TABULA", "renovated_TABULA_low_energy")


def type_shares(split: DataFrame, region: str = "region", code: str = "code", count: str = "dwellings") -> DataFrame:
    """region, dwelling_type, type_share from counts by type code; only bridged codes count."""
    weights = split.sparkSession.createDataFrame(list(TYPE_BRIDGE), f"{code} string, dwelling_type string, weight double")
    moved = alloc.bridge(split, weights, code, "dwelling_type", count, [region])
    return alloc.share_within_small(moved, [region], count, "type_share").select(region, "dwelling_type", "type_share")


def period_shares(counts: DataFrame, region: str = "region", period: str = "source_period", count: str = "dwellings") -> DataFrame:
    """region, construction_period, period_share from counts by source period."""
    weights = counts.sparkSession.createDataFrame(list(PERIOD_BRIDGE), f"{period} string, construction_period string, weight double")
    moved = alloc.bridge(counts, weights, period, "construction_period", count, [region])
    return alloc.share_within_small(moved, [region], count, "period_share").select(region, "construction_period", "period_share")


def airtightness_long(wide: DataFrame) -> DataFrame:
    return alloc.unpivoted(wide, ["construction_period"], list(V50_COLUMNS), "dwelling_type", "v50_m3_h_m2", V50_COLUMNS)


def base_matrix(geometry: DataFrame, u_values: DataFrame, airtightness: DataFrame, types: Sequence[str] = TYPES, periods: Sequence[str] = PERIODS) -> DataFrame:
    """Geometry with airtightness (one to one) and U-values (many to one), ids by type number. Raises if a
    key repeats, a field is missing, or the classes aren't complete."""
    keys = ["dwelling_type", "construction_period"]
    air = airtightness if "dwelling_type" in airtightness.columns else airtightness_long(airtightness)
    u = u_values.select("construction_period", *(c for c in u_values.columns if c.startswith("U_")))
    checks.enforce(geometry, checks.unique_key(geometry, keys), checks.unique_key(air, keys), checks.unique_key(u, ["construction_period"]))
    expected = F.explode(F.array(*[F.lit(t) for t in types])), F.explode(F.array(*[F.lit(p) for p in periods]))
    spark = geometry.sparkSession
    domain = spark.range(1).select(expected[0].alias("dwelling_type")).crossJoin(spark.range(1).select(expected[1].alias("construction_period")))
    checks.enforce_empty(geometry, "classes are not complete", checks.key_difference(geometry, domain, keys))
    out = geometry.join(air.select(*keys, "v50_m3_h_m2"), keys, "left").join(u, "construction_period", "left")
    checks.enforce(out, checks.not_null(out, ["v50_m3_h_m2", *(c for c in u.columns if c.startswith("U_"))]))
    number = F.col("tabula_type_number").cast("int")
    return out.select(F.format_string("BE_TABULA_%02d", number).alias("archetype_id"), number.alias("TABULA_type_number"), *(c for c in out.columns if c != "tabula_type_number"))


def stock_weighted(base: DataFrame, types: DataFrame, periods: DataFrame, modelled: DataFrame, region: str | None = None) -> DataFrame:
    """base x marginals: share = type share x period share, dwellings = modelled x share. With ``region`` the
    marginals and ``modelled`` (region, modelled) are by region; without, of one area."""
    if region is None:
        t, p = types.drop("region"), periods.drop("region")
        joint = base.join(t, "dwelling_type").join(p, "construction_period").crossJoin(modelled.select("modelled"))
    else:
        joint = modelled.crossJoin(base).join(types, [region, "dwelling_type"]).join(periods, [region, "construction_period"])
    share = F.col("type_share") * F.col("period_share")
    return joint.withColumn("share", share).withColumn("dwellings", F.col("modelled") * F.col("share")).drop("type_share", "period_share")


def checked_shares(matrix: DataFrame, keys: Sequence[str], atol: float = 1e-9) -> DataFrame:
    """``matrix`` if shares sum to 1 in each group."""
    return checks.enforce_empty(matrix, "shares don't sum to one", checks.group_sums(matrix, keys, "share", 1.0, atol))


def renovation_layers(matrix: DataFrame, priority: DataFrame, policy: DataFrame) -> DataFrame:
    """Priority-weighted allocation of each region's renovation flow over its archetypes."""
    checks.enforce(priority, checks.unique_key(priority, ["construction_period"]))
    checks.enforce(policy, checks.unique_key(policy, ["region"]))
    rates = [f"annual_renovation_rate_{s}" for s in ("low", "central", "high")]
    p = policy.select("region", *(F.col(r).cast("double").alias(r) for r in rates), *(c for c in ("target_2050", "target_energy_score_2050_kWh_m2_year") if c in policy.columns))
    joined = matrix.join(priority.select("construction_period", "renovation_priority", F.col("priority_weight").cast("double").alias("priority_weight")), "construction_period", "left").join(p, "region", "left")
    checks.enforce(joined, checks.not_null(joined, ["priority_weight", *rates]))
    weighted = joined.withColumn("allocation_raw_weight", F.col("share") * F.col("priority_weight"))
    out = alloc.share_within_small(weighted, ["region"], "allocation_raw_weight", "allocation")
    return out.withColumns({f"allocated_flow_{s}": F.col(f"annual_renovation_rate_{s}") * F.col("modelled") * F.col("allocation") for s in ("low", "central", "high")})


def scenario_states(layers: DataFrame, base_share: Column | None = None, years: float = YEARS_ELAPSED) -> DataFrame:
    """Two states for each archetype and scenario by capped flows; the excess of a cap isn't redistributed."""
    given = layers.withColumn("region_total", F.col("modelled").cast("double")).withColumnRenamed("dwellings", "dwellings_total")
    rates = {s: f"annual_renovation_rate_{s}" for s in ("low", "central", "high")}
    out = alloc.capped_states(given, ["region", "archetype_id", "dwelling_type", "construction_period", "modelled"], "dwellings_total", rates, years, base_share, STATES)
    return out.withColumn("renovated_fraction", F.try_divide(F.col("dwellings"), F.col("dwellings_total"))).withColumn("share_within_region", F.try_divide(F.col("dwellings"), F.col("modelled").cast("double")))


def renovation_crosscheck(states: DataFrame) -> DataFrame:
    """By region and scenario: renovated dwellings, their fraction of the modelled stock, caps and status."""
    moved = states.where(F.col("state") == STATES[1])
    out = moved.groupBy("region", "scenario").agg(F.sum("dwellings").alias("renovated"), F.max("modelled").alias("modelled"), F.max("rate").alias("rate"), F.count_if("capped").alias("caps"))
    status = lookup(F.col("scenario"), {"low": "below_policy_compatible_trajectory", "central": "policy_compatible_scenario", "high": "accelerated_scenario"})
    out = out.withColumn("renovated_fraction", F.col("renovated") / F.col("modelled"))
    return out.withColumn("status", F.when((F.col("scenario") == "high") & (F.col("caps") > 0), F.concat(status, F.lit("_with_archetype_caps"))).otherwise(status))


#: Notes by region and scenario ({percent} is the renovated fraction), what they say of bound caps,
#: and the sentence that ends each.
NOTES = {
    ("Flemish Region", "low"): "The low scenario renovates about {percent} by 2050 and remains below the central policy-compatible trajectory.",
    ("Flemish Region", "central"): (
        "The central scenario renovates about {percent} by 2050. This is a strong trajectory but does not guarantee full label-A compliance unless an existing renovated share is included or rates increase."
    ),
    ("Flemish Region", "high"): (
        "The high scenario renovates about {percent} by 2050. Archetype caps bind; because capped excess is not redistributed, the nominal 100% regional flow does not renovate the full stock."
    ),
    ("Walloon Region", "low"): "The low scenario renovates about {percent} by 2050 and represents a conservative current-rate proxy below the central deep-renovation trajectory.",
    ("Walloon Region", "central"): (
        "The central scenario is a policy-compatible deep-renovation trajectory toward average decarbonised PEB label A. The 3% rate is a scenario assumption unless directly sourced as a fixed legal annual rate."
    ),
    ("Walloon Region", "high"): (
        "The high scenario renovates about {percent} by 2050. Archetype caps bind; capped excess is not redistributed, so the nominal 100% regional flow does not renovate the full stock. "
        "The central 3% rate remains a scenario assumption."
    ),
    ("Brussels-Capital Region", "low"): "The low scenario renovates about {percent} by 2050 and remains below the cautious central policy-compatible trajectory.",
    ("Brussels-Capital Region", "central"): (
        "The central scenario is a cautious policy-compatible trajectory toward average PEB C+ / 100 kWh/m²/year. TABULA Low Energy is a physical deep-renovation package and may be stronger "
        "than the average C+ target for many dwellings."
    ),
    ("Brussels-Capital Region", "high"): (
        "The high scenario renovates about {percent} by 2050. Archetype caps bind; capped excess is not redistributed, so the nominal 100% regional flow does not renovate the full stock. "
        "TABULA Low Energy may be stronger than the average C+ benchmark for many dwellings."
    ),
}
CAPS_SENTENCE = r" Archetype caps bind;[^.]*\."
BENCHMARK_NOTE = "EPC/PEB targets are policy benchmarks, while TABULA Low Energy defines the physical renovated state; the model does not claim exact equivalence to EPC A, PEB A, or PEB C+."


def with_notes(crosscheck: DataFrame, notes: Mapping[tuple[str, str], str] = NOTES, ending: str = BENCHMARK_NOTE) -> DataFrame:
    """The crosscheck (region, scenario, renovated_fraction, caps) with a note on each row. Where no cap is bound
    the sentence on caps is left out; a region and scenario without a note raise."""
    table = crosscheck.sparkSession.createDataFrame([(r, s, n) for (r, s), n in notes.items()], "region string, scenario string, template string")
    out = crosscheck.join(table, ["region", "scenario"], "left")
    checks.enforce(out, checks.not_null(out, ["template"]))
    filled = F.replace("template", F.lit("{percent}"), percent_text(F.col("renovated_fraction")))
    plain = F.when(F.col("caps") > 0, filled).otherwise(F.regexp_replace(filled, CAPS_SENTENCE, ""))
    return out.withColumn("note", F.concat_ws(" ", plain, F.lit(ending))).drop("template")


#: Raw heating shares that don't sum to one, the renovated package, and the PV threshold.
RAW_SUMS = {"Walloon Region": 0.997}
RENOVATED_PACKAGE, SUPPLY_C, RECOVERY, SMALL_KW, OBSERVED_YEAR = "renovated_air_water_heat_pump", 45.0, 0.8, 10.0, 2024


def technology_rules(heating: DataFrame, packages: DataFrame, cooling: DataFrame, pv: DataFrame, atol: float = 1e-9) -> DataFrame:
    """The business rules of the technology inputs, as (check, violations)."""
    sums = heating.groupBy("region").agg(F.sum("raw_share").alias("raw"), F.sum("variant_share").alias("normal"))
    want = F.coalesce(lookup(F.col("region"), RAW_SUMS), F.lit(1.0))
    truth = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    renovated = packages.where(F.col("package_id") == RENOVATED_PACKAGE)
    used = heating.join(packages.select(F.col("package_id").alias("heating_variant_id"), "applicable_renovation_state", F.col("energy_carrier").alias("carrier")), "heating_variant_id", "left")
    return checks.union_checks(
        checks.audit(sums, {"raw heating shares": F.abs(F.col("raw") - want) <= atol, "heating shares sum to one": F.abs(F.col("normal") - 1) <= atol}),
        checks.unique_key(packages, ["package_id"]),
        checks.not_blank(packages, ["energy_carrier", "space_heating_system"]),
        checks.audit(packages, {"known state": F.col("applicable_renovation_state").isin(*STATES)}),
        checks.row_count(renovated, 1),
        checks.audit(renovated, {"supply temperature": F.col("supply_temperature_c") == SUPPLY_C, "heat recovery": F.abs(F.col("hrv_eta") - RECOVERY) <= atol, "summer bypass": truth("summer_bypass"), "reversible": truth("reversible_cooling_capable")}),
        checks.audit(used, {"variants apply to as-is states": F.col("applicable_renovation_state") == STATES[0], "carriers agree": F.col("carrier") == F.col("energy_carrier")}),
        checks.unique_key(cooling, ["cooling_case", "region"]),
        checks.in_range(cooling, {"active_cooling_share": (0.0, 1.0)}),
        checks.unique_key(pv, ["region"]),
        checks.audit(pv, {"observation year": F.col("observation_year") == OBSERVED_YEAR, "threshold": truth("threshold_supported") & (F.col("small_system_threshold_kw") == SMALL_KW)}),
    )


def checked_states(states: DataFrame, atol: float = 1e-5) -> DataFrame:
    """``states`` if every archetype and scenario has both states once and they sum to its stock."""
    keys = ["region", "archetype_id", "scenario"]
    checks.enforce_empty(states, "states are not paired", checks.states(states, keys, "state", STATES))
    return checks.enforce_empty(states, "states don't sum to the stock", checks.group_sums(states, keys, "dwellings", F.col("dwellings_total"), atol))


def heating_shares(raw: DataFrame) -> DataFrame:
    """Raw shares brought to a sum of one within each region, and the factor that did it."""
    out = alloc.share_within_small(raw, ["region"], "raw_share", "share")
    return out.withColumn("normalization_factor", F.try_divide("share", "raw_share"))


def technology(states: DataFrame, heating: DataFrame, cooling: DataFrame, pv_inputs: DataFrame, package: tuple[str, str] = ("air_water_heat_pump", "electricity")) -> dict[str, DataFrame]:
    """Heating, cooling and PV variants of all states, and the PV assignment; kept apart by design."""
    given = pv_inputs.select(
        "region", F.col("small_installations_2024").alias("small_n"), F.col("small_capacity_mw_2024").alias("small_mw"), F.col("total_capacity_mw_2024").alias("total_mw"), F.col("target_energy_gwh_2030").alias("target_gwh"),
        F.col("baseline_yield_kwh_per_kwp").alias("yield_kwh"), F.col("rooftop_potential_mw").alias("rooftop_mw"), F.col("modeled_house_dwellings").alias("houses"), F.col("modeled_apartment_dwellings").alias("apartments"),
        F.col("apartment_buildings_2025").alias("apartment_buildings"), F.col("apartment_participation_ratio_to_house_2050").alias("ratio"),
    )
    assigned = fanout.pv_assignments(fanout.pv_projection(given), "region")
    grouped = states.withColumn("dwelling_group", F.when(F.col("dwelling_type").startswith("Apartment"), "apartment").otherwise("house"))
    return {
        "heating": fanout.heating(states, heating.withColumnRenamed("heating_variant_id", "variant") if "heating_variant_id" in heating.columns else heating, "region", package, as_is=STATES[0]),
        "cooling": fanout.cooling(states, cooling.withColumnRenamed("active_cooling_share", "active_share") if "active_cooling_share" in cooling.columns else cooling, "region"),
        "pv": fanout.pv_rows(grouped, assigned, "region", as_is=STATES[0]),
        "pv_assignment": assigned,
    }


# Stock tables from long source tables ------------------------------------------------------------


def cadastral(raw: DataFrame) -> DataFrame:
    """The long cadastral table with clean codes and whole counts; what isn't a number counts as 0."""
    return raw.select(
        F.col("CD_YEAR").try_cast("int").alias("year"), clean_code(F.col("CD_REFNIS")).alias("area"), F.upper(F.trim("CD_STAT_TYPE")).alias("statistic"), F.upper(F.trim("CD_BUILDING_TYPE")).alias("code"), number_or_zero(F.col("MS_VALUE")).alias("value")
    )


def composition(stock: DataFrame, area_names: dict[str, str], year: int, statistic: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """By named area: counts of code groups in one pass and their shares as text. Totals are areas of the
    source of their own, never sums of the others. Counts are rounded half to even."""
    named = stock.where((F.col("year") == year) & (F.col("statistic") == statistic) & F.col("area").isin(*area_names)).withColumn("area_name", lookup(F.col("area"), area_names))
    sums = {g: F.bround(F.sum(F.when(F.col("code").isin(*codes), F.col("value"))), 0).cast("long") for g, codes in groups.items()}
    out = named.groupBy("area_name").agg(*(c.alias(g) for g, c in sums.items()))
    whole = sum((F.coalesce(F.col(g), F.lit(0)) for g in list(groups)[1:]), F.coalesce(F.col(next(iter(groups))), F.lit(0)))
    return out.withColumns({f"{g}_share": percent_text(F.try_divide(F.col(g).cast("double"), whole.cast("double"))) for g in groups})


def period_table(census: DataFrame, area: str, bands: dict[str, str], areas: Sequence[str]) -> DataFrame:
    """Source bands to period classes by area, interleaved as <area> dwellings and <area> share (%)."""
    long = alloc.unpivoted(census, [area], list(bands), "band", "n", None).withColumn("period", lookup(F.col("band"), bands))
    counted = long.groupBy(area, "period").agg(F.sum("n").alias("n"))
    shared = alloc.share_within_small(counted, [area], "n").withColumn("percent", F.bround(F.col("share") * 100, 2))
    wide = shared.groupBy("period").pivot(area, list(areas)).agg(F.first("n").alias("dwellings"), F.first("percent").alias("share"))
    return wide.select("period", *(F.col(f"{a}_{k}").alias(n) for a in areas for k, n in (("dwellings", f"{a} dwellings"), ("share", f"{a} share (%)"))))


def reconcile(extracted: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str], atol: float = 1e-9) -> DataFrame:
    """Cells of an extracted text table (decimal commas) that differ from the numeric one."""
    typed = extracted.select(*keys, *(F.coalesce(decimal_comma(F.col(c).cast("string")), F.col(c).try_cast("double")).alias(c) for c in columns))
    return checks.agreement(typed, table.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)), keys, columns, atol)


def side_by_side(spark: SparkSession, series: dict[str, dict[str, float]], key: str = "category") -> DataFrame:
    """Literal series joined on their categories; a category that one lacks is null there."""
    out: DataFrame | None = None
    for name, values in series.items():
        df = spark.createDataFrame(list(values.items()), f"{key} string, `{name}` double")
        out = df if out is None else out.join(df, key, "full")
    return out
