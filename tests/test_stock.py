"""Stock plans against known totals and fractions."""

import itertools

import pytest
from pyspark.sql import functions as F

from tarnwerk.operators import alloc, checks, fanout
from tarnwerk.plans import stock

#: Dwellings by region and type code, by region and construction period, rates and priorities.
SPLIT = {"Flemish Region": (699047, 623453, 921020, 1000614), "Walloon Region": (457796, 393702, 531885, 343826), "Brussels-Capital Region": (177028, 17227, 6208, 365579)}
PERIODS = {
    "Flemish Region": (390952, 401041, 807711, 750152, 345165, 308308, 331525),
    "Walloon Region": (688183, 188460, 304430, 293691, 109076, 117935, 110015),
    "Brussels-Capital Region": (191485, 118845, 155353, 78396, 25817, 27962, 33655),
}
PERIOD_NAMES = ("Before 1919", "1919-1945", "1946-1970", "1971-1990", "1991-2000", "2001-2010", "2011 onwards")
RATES = {"Flemish Region": (0.006, 0.030, 0.040), "Walloon Region": (0.008, 0.030, 0.040), "Brussels-Capital Region": (0.008, 0.025, 0.040)}
PRIORITY = {"pre-1946": ("very high", 4), "1946-1970": ("very high", 4), "1971-1990": ("high", 3), "1991-2005": ("medium", 2), "post-2005": ("low", 1)}
FRACTIONS = {
    ("Flemish Region", "low"): 0.15, ("Flemish Region", "central"): 0.75, ("Flemish Region", "high"): 0.848246190633, ("Walloon Region", "low"): 0.2, ("Walloon Region", "central"): 0.75,
    ("Walloon Region", "high"): 0.878730275039, ("Brussels-Capital Region", "low"): 0.2, ("Brussels-Capital Region", "central"): 0.625, ("Brussels-Capital Region", "high"): 0.900282680962,
}
#: region: small_n, small_mw, total_mw, target_gwh, yield, rooftop, houses, apartments, buildings; 2050 house rate.
PV = {
    "Flemish Region": ((1003001.0, 4441.78497, 7151.423095, 8200.0, 921.348314606742, 56967.685, 2243520.0, 1000614.0, 151968.0), 0.905414195978, "linear_trajectory"),
    "Walloon Region": ((358367.0, 1889.08, 2276.0, 5100.0, 956.0, 6659.588, 1383383.0, 343826.0, 59379.0), 0.903539422188, "official_rooftop_potential"),
    "Brussels-Capital Region": ((22354.0, 88.655492918859, 308.618, 334.0, 850.0, 2500.0, 200463.0, 365579.0, 42388.0), 0.231312889111, "linear_trajectory"),
}


@pytest.fixture(scope="module")
def layers(spark):
    split = spark.createDataFrame([(r, f"R{i + 1}", float(n)) for r, ns in SPLIT.items() for i, n in enumerate(ns)], "region string, code string, dwellings double")
    counts = spark.createDataFrame([(r, p, float(n)) for r, ns in PERIODS.items() for p, n in zip(PERIOD_NAMES, ns, strict=True)], "region string, source_period string, dwellings double")
    base = spark.createDataFrame([(f"BE_TABULA_{i + 1:02d}", t, p) for i, (p, t) in enumerate(itertools.product(stock.PERIODS, stock.TYPES))], "archetype_id string, dwelling_type string, construction_period string")
    modelled = spark.createDataFrame([(r, float(sum(n))) for r, n in SPLIT.items()], "region string, modelled double")
    matrix = stock.checked_shares(stock.stock_weighted(base, stock.type_shares(split), stock.period_shares(counts), modelled, "region"), ["region"])
    priority = spark.createDataFrame([(p, n, w) for p, (n, w) in PRIORITY.items()], "construction_period string, renovation_priority string, priority_weight int")
    policy = spark.createDataFrame([(r, *v) for r, v in RATES.items()], "region string, annual_renovation_rate_low double, annual_renovation_rate_central double, annual_renovation_rate_high double")
    return stock.renovation_layers(matrix, priority, policy).cache()


def test_matrix_totals(layers):
    row = layers.agg(F.count("*").alias("n"), F.sum("dwellings").alias("d")).first()
    assert row["n"] == 75
    assert row["d"] == pytest.approx(5537385, abs=1e-6)


def test_crosscheck_fractions(layers):
    states = stock.checked_states(stock.scenario_states(layers))
    assert states.count() == 450
    got = {(r["region"], r["scenario"]): r for r in stock.renovation_crosscheck(states).collect()}
    assert {k: r["renovated_fraction"] for k, r in got.items()} == pytest.approx(FRACTIONS, abs=1e-9)
    assert all(r["caps"] == (10 if s == "high" else 0) for (_, s), r in got.items())
    assert got["Flemish Region", "high"]["status"] == "accelerated_scenario_with_archetype_caps"


def test_notes_of_every_region_and_scenario(spark, layers):
    crosscheck = stock.renovation_crosscheck(stock.scenario_states(layers))
    got = {(r["region"], r["scenario"]): r["note"] for r in stock.with_notes(crosscheck).collect()}
    assert len(got) == 9 and all(n.endswith("or PEB C+.") and "{" not in n for n in got.values())
    assert got["Flemish Region", "high"].startswith("The high scenario renovates about 84.8% by 2050. Archetype caps bind; because")
    assert got["Walloon Region", "low"].startswith("The low scenario renovates about 20.0% by 2050 and represents")
    free = {(r["region"], r["scenario"]): r["note"] for r in stock.with_notes(crosscheck.withColumn("caps", F.lit(0))).collect()}
    assert free["Walloon Region", "high"] == "The high scenario renovates about 87.9% by 2050. The central 3% rate remains a scenario assumption. " + stock.BENCHMARK_NOTE
    with pytest.raises(checks.CheckFailed, match="template"):
        stock.with_notes(crosscheck.withColumn("region", F.lit("elsewhere")))


def test_business_rules_name_what_is_broken(spark):
    regions = list(SPLIT)
    raw = {"Walloon Region": (0.4, 0.597), "Flemish Region": (0.4, 0.6), "Brussels-Capital Region": (0.4, 0.6)}
    heating = spark.createDataFrame([(r, f"v{i}", f"c{i}", x, x / sum(raw[r])) for r in regions for i, x in enumerate(raw[r])], "region string, heating_variant_id string, energy_carrier string, raw_share double, variant_share double")
    packages = spark.createDataFrame([("v0", stock.STATES[0], "c0", "x", None, None, "false", "false"), ("v1", stock.STATES[0], "c1", "x", None, None, "false", "false"), (stock.RENOVATED_PACKAGE, stock.STATES[1], "e", "x", 45.0, 0.8, "true", "true")], "package_id string, applicable_renovation_state string, energy_carrier string, space_heating_system string, supply_temperature_c double, hrv_eta double, summer_bypass string, reversible_cooling_capable string")
    cooling = spark.createDataFrame([(c, r, 0.1) for c in ("a", "b") for r in regions], "cooling_case string, region string, active_cooling_share double")
    pv = spark.createDataFrame([(r, 2024, "true", 10.0) for r in regions], "region string, observation_year int, threshold_supported string, small_system_threshold_kw double")
    broken = lambda *t: {r["check"] for r in stock.technology_rules(*t).where("violations > 0").collect()}
    assert broken(heating, packages, cooling, pv) == set()
    assert broken(heating.withColumn("raw_share", F.col("raw_share") * 1.01), packages, cooling, pv) == {"raw heating shares"}
    assert broken(heating, packages.withColumn("supply_temperature_c", F.lit(55.0)).withColumn("summer_bypass", F.lit("false")), cooling, pv) == {"supply temperature", "summer bypass"}
    assert broken(heating.withColumn("energy_carrier", F.lit("c0")), packages, cooling.withColumn("active_cooling_share", F.lit(1.5)), pv.withColumn("small_system_threshold_kw", F.lit(5.0))) == {"carriers agree", "range active_cooling_share", "threshold"}


def test_technology_counts_and_sums(spark, layers):
    states = stock.scenario_states(layers)
    regions = list(SPLIT)
    heating = spark.createDataFrame([(r, v, s) for r in regions for v, s in (("a", 0.06), ("b", 0.424), ("c", 0.375), ("d", 0.138))], "region string, variant string, raw_share double")
    cooling = spark.createDataFrame([(c, r, s) for r in regions for c, s in (("none", 0.0), ("now", 0.07), ("more", 0.14))], "cooling_case string, region string, active_share double")
    names = ("small_installations_2024", "small_capacity_mw_2024", "total_capacity_mw_2024", "target_energy_gwh_2030", "baseline_yield_kwh_per_kwp", "rooftop_potential_mw", "modeled_house_dwellings", "modeled_apartment_dwellings", "apartment_buildings_2025", "apartment_participation_ratio_to_house_2050")
    pv = spark.createDataFrame([(r, *v[0], 0.25) for r, v in PV.items()], "region string, " + ", ".join(f"{n} double" for n in names))
    out = stock.technology(states, stock.heating_shares(heating), cooling, pv)
    assert {k: v.count() for k, v in out.items()} == {"heating": 1125, "cooling": 2700, "pv": 900, "pv_assignment": 12}
    keys = ["region", "archetype_id", "scenario", "state"]
    for name, by in (("heating", keys), ("cooling", [*keys, "cooling_case"]), ("pv", keys)):
        assert fanout.unreconstructed(out[name], by).count() == 0
    end = {r["region"]: r for r in out["pv_assignment"].where("basis_year = 2050 and dwelling_group = 'house'").collect()}
    for region, (_, rate, why) in PV.items():
        assert end[region]["participation_rate"] == pytest.approx(rate, abs=1e-11)
        assert end[region]["cap_reason"] == why


def test_base_matrix_and_completeness(spark):
    pairs = list(itertools.product(stock.PERIODS, stock.TYPES))
    geometry = spark.createDataFrame([(i + 1, t, p, 100.0 + i) for i, (p, t) in enumerate(pairs)], "tabula_type_number int, dwelling_type string, construction_period string, area double")
    u = spark.createDataFrame([(p, 1.0, 2.0) for p in stock.PERIODS], "construction_period string, U_wall double, U_roof double")
    air = spark.createDataFrame([(p, *[10.0 + i for i in range(5)]) for p in stock.PERIODS], "construction_period string, " + ", ".join(f"{c} double" for c in stock.V50_COLUMNS))
    out = stock.base_matrix(geometry, u, air).orderBy("archetype_id").collect()
    assert len(out) == 25 and out[0]["archetype_id"] == "BE_TABULA_01" and out[0]["v50_m3_h_m2"] == 10.0
    with pytest.raises(checks.CheckFailed, match="complete"):
        stock.base_matrix(geometry.where("tabula_type_number < 25"), u, air)
    with pytest.raises(checks.CheckFailed, match="unique"):
        stock.base_matrix(geometry.union(geometry.limit(1)), u, air)


def test_composition_and_period_table(spark):
    raw = spark.createDataFrame([("2025", "01000.0", "T5", "R1", "3"), ("2025", "1000", " t5 ", "r2", "1"), ("2025", "1000", "T5", "R4", "x"), ("2025", "2000", "T5", "R1", "2")], "CD_YEAR string, CD_REFNIS string, CD_STAT_TYPE string, CD_BUILDING_TYPE string, MS_VALUE string")
    got = {r["area_name"]: r for r in stock.composition(stock.cadastral(raw), {"01000": "Belgium", "02000": "Flanders"}, 2025, "T5", {"houses": ("R1", "R2"), "flats": ("R4",)}).collect()}
    assert got["Belgium"]["houses"] == 4 and got["Belgium"]["houses_share"] == "100.0%" and got["Flanders"]["flats"] is None
    census = spark.createDataFrame([("a", 1.0, 2.0, 1.0), ("b", 0.0, 3.0, 1.0)], "area string, x1 double, x2 double, x3 double")
    table = {r["period"]: r for r in stock.period_table(census, "area", {"x1": "old", "x2": "old", "x3": "new"}, ["a", "b"]).collect()}
    assert table["old"]["a dwellings"] == 3.0 and table["new"]["b share (%)"] == 25.0


def test_reconcile_and_side_by_side(spark):
    text = spark.createDataFrame([("p", "1,5"), ("q", "2,0")], "k string, v string")
    numbers = spark.createDataFrame([("p", 1.5), ("q", 2.1)], "k string, v double")
    assert [r["k"] for r in stock.reconcile(text, numbers, ["k"], ["v"]).collect()] == ["q"]
    assert stock.side_by_side(spark, {"a": {"x": 1.0, "y": 2.0}, "b": {"x": 3.0}}).where("b is null").count() == 1


def test_zero_rows_survive_and_totals_have_their_own_source(spark):
    states = spark.createDataFrame([("r", "as_is", 10.0)], "region string, state string, dwellings double")
    cases = spark.createDataFrame([("r", "none", 0.0)], "region string, cooling_case string, active_share double")
    assert fanout.cooling(states, cases, "region").count() == 2
    parts = spark.createDataFrame([("a", 1)], "area string, n int")
    total = spark.createDataFrame([(5,)], "n int")
    assert {r["area"]: r["n"] for r in alloc.with_total(parts, "area", total).collect()} == {"a": 1, "Total": 5}
