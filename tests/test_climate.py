"""Climate plans on synthetic hourly and daily series."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwerk.operators import checks, timeseries
from tarnwerk.plans import climate


def hour_rows(year):
    at, out = datetime(year, 1, 1), []
    while at.year == year:
        sun = 40 * math.sin((at.hour - 6) * math.pi / 12)
        beam, diffuse = (max(0.0, sun * 10), max(0.0, sun * 4)) if sun >= 0 else (0.0, 0.0)
        t = 10 + 12 * math.sin((at.timetuple().tm_yday - 100) * 2 * math.pi / 365) + 3 * math.sin(at.hour * math.pi / 12)
        out.append((at, t, beam, diffuse, beam + diffuse, 2.0, sun, False))
        at += timedelta(hours=1)
    return out


@pytest.fixture(scope="module")
def observed(spark):
    schema = "timestamp_utc timestamp, T_out_C double, I_beam_horizontal_W_m2 double, I_diffuse_horizontal_W_m2 double, I_solar_W_m2 double, wind_speed_10m_m_s double, sun_height_deg double, pvgis_reconstructed boolean"
    df = spark.createDataFrame(hour_rows(2019) + hour_rows(2020), schema).cache()
    return climate.complete_years(df)


@pytest.fixture(scope="module")
def contract(spark):
    rows = [(s, m, d + m / 100, a + m / 1000) for s, d, a in (("rcp_a", 1.0, 1.01), ("rcp_b", 2.0, 1.05)) for m in range(1, 13)]
    return spark.createDataFrame(rows, "scenario string, month int, delta double, alpha double")


def test_threshold_edges(spark):
    t = spark.createDataFrame([(v,) for v in (15.0, 15.0001, 23.9999, 24.0)], "t double")
    row = timeseries.degree_days(t, [], "t").first()
    assert (row["hdd"], row["cdd"]) == (3.0, 3.0)


def test_two_day_fixture(spark):
    rows = [(datetime(2020, 1, 1) + timedelta(hours=h), 15.0 if h < 24 else 24.0, 100.0) for h in range(48)]
    row = timeseries.annual_metrics(spark.createDataFrame(rows, "ts timestamp, t double, s double"), [], "ts", "t", "s").first()
    assert (row["rows"], row["hdd"], row["cdd"], row["solar_kwh"]) == (48, 3.0, 3.0, 4.8)


def test_leap_and_complete_years(observed):
    got = {r["observed_year"]: r["count"] for r in observed.groupBy("observed_year").count().collect()}
    assert got == {2019: 8760, 2020: 8784}
    with pytest.raises(checks.CheckFailed, match="years"):
        climate.complete_years(observed.drop("observed_year").where("timestamp_utc <> timestamp'2019-05-05 05:00:00'"))


@pytest.mark.parametrize(
    "column, value, name",
    [("T_out_C", "float('nan')", "finite"), ("T_out_C", "float('inf')", "finite"), ("T_out_C", "99.0", "temperature"), ("I_beam_horizontal_W_m2", "-1.0", "irradiance"), ("I_solar_W_m2", "7.5", "solar"), ("wind_speed_10m_m_s", "-2.0", "wind"), ("pvgis_reconstructed", "True", "reconstructed")],
)
def test_faults_are_named(observed, column, value, name):
    bad = observed.withColumn(column, F.when(F.col("timestamp_utc") == F.lit("2019-03-03 00:00:00").cast("timestamp"), F.lit(eval(value))).otherwise(F.col(column)))
    failed = {r["check"] for r in climate.hourly_checks(bad)[0].where("violations > 0").collect()}
    assert any(name in f for f in failed)


def test_night_light_is_found(observed):
    bad = observed.withColumn("I_beam_horizontal_W_m2", F.col("I_beam_horizontal_W_m2") + 1).withColumn("I_solar_W_m2", F.col("I_solar_W_m2") + 1)
    failed = {r["check"] for r in climate.hourly_checks(bad)[0].where("violations > 0").collect()}
    assert "no light at night" in failed


def test_ensemble_members_and_invariants(observed, contract):
    table = climate.ensemble(observed, contract)
    members = climate.members(table).collect()
    assert len(members) == 4 and sum(r["row_count"] for r in members) == 2 * (8760 + 8784)
    assert {r["observed_year"] for r in members if r["is_leap_year"]} == {2020}
    inv = climate.invariants(table, observed)
    assert inv.count() == 48 and inv.where("not ok").count() == 0
    for broken in ("T_out_C", "wind_speed_10m_m_s", "I_beam_horizontal_W_m2"):
        assert climate.invariants(table.withColumn(broken, F.col(broken) + 0.5), observed).where("not ok").count() > 0
    summary = climate.member_summary(table, observed)
    assert summary.where("hdd_ratio < 1 and cdd_change >= 0").count() == 4
    assert climate.implausible(summary, {"hdd_ratio": (0.0, 0.5), "cdd_change": (-1e9, 1e9)}).count() == 4


def test_facades_need_every_hour(spark, observed, contract):
    table = climate.ensemble(observed.where("observed_year = 2019"), contract)
    planes = observed.select("timestamp_utc", F.explode(F.array(F.lit("south"), F.lit("north"))).alias("orientation"), F.lit(1.0).alias("beam"), F.lit(2.0).alias("diffuse"), F.lit(0.5).alias("reflected"))
    row = climate.facades(table, planes, ["south", "north"]).where("scenario = 'rcp_a' and month = 1").first()
    assert row["I_facade_south_W_m2"] == pytest.approx(3.5 * 1.011)
    with pytest.raises(checks.CheckFailed, match="not null"):
        climate.facades(table, planes.where("timestamp_utc > timestamp'2019-06-01 00:00:00'"), ["south", "north"])


def test_deltas_and_contract(spark):
    rows = [(s, datetime(y, m, d, 12), base + m, sun + m) for s, base, sun in (("historical", 1.0, 100.0), ("rcp", 2.5, 110.0)) for y in (2000, 2001) for m in range(1, 13) for d in (1, 2)]
    daily = spark.createDataFrame(rows, "scenario string, timestamp timestamp, T_out_C double, I_solar_W_m2 double")
    deltas = climate.monthly_deltas(daily)
    got = {r["month"]: r for r in deltas.collect()}
    assert len(got) == 12 and got[3]["delta"] == pytest.approx(1.5) and got[3]["alpha"] == pytest.approx(113 / 103) and got[3]["month_name"] == "Mar"
    assert climate.delta_contract(deltas).count() == 12
    with pytest.raises(checks.CheckFailed, match="months"):
        climate.delta_contract(deltas.where("month <> 7"))


def test_alpha_bounds(spark):
    base = spark.createDataFrame([(1, 10, 0.0, 1.0), (2, 10, 0.0, 1.0), (3, 10, 0.0, 1.0)], "month int, n_rows long, T double, I double")
    future = spark.createDataFrame([(1, 10, 0.0, 1.05), (2, 10, 0.0, 1.4), (3, 10, 0.0, 0.6)], "month int, n_rows long, T double, I double")
    out = timeseries.change_factors(base, future, [], "T", "I", 0.7, 1.3).orderBy("month").collect()
    assert [(r["alpha"], r["clipped"]) for r in out] == [(1.05, False), (1.3, True), (0.7, True)]


def test_clean_hourly_clamps_and_warns(spark):
    plane = spark.createDataFrame([("20200101:0010", -0.25, 0.0, 0.0, -5.0, 1.0, 1.0, 0.0), ("20200101:1210", 2.0, 0.5, 0.0, 20.0, 1.0, 1.0, 0.0)], "time string, `Gb(i)` double, `Gd(i)` double, `Gr(i)` double, H_sun double, T2m double, WS10m double, Int double")
    out, warnings = climate.clean_hourly(plane)
    assert [r["I_solar_W_m2"] for r in out.orderBy("timestamp_utc").collect()] == [0.0, 2.5]
    assert [tuple(r) for r in warnings.collect()] == [("I_beam_horizontal_W_m2", 1, -0.25)]
    with pytest.raises(checks.CheckFailed, match="ten past"):
        climate.clean_hourly(plane.withColumn("time", F.lit("20200101:0011")))


def test_plausibility_never_divides(spark):
    summary = spark.createDataFrame([("s", 2000, 0.5, 151.0, 1.2)], "scenario string, observed_year int, hdd_ratio double, cdd_change double, solar_ratio double")
    got = climate.implausible(summary, {"hdd_ratio": (0.7, 1.0), "cdd_change": (0.0, 150.0), "solar_ratio": (0.9, 1.15)}).collect()
    assert [r["metric"] for r in got] == ["hdd_ratio", "cdd_change", "solar_ratio"]
    zero = spark.createDataFrame([(1.0, 0.0)], "a double, b double").select(F.try_divide("a", "b").alias("r")).first()
    assert zero["r"] is None


def test_reference_statistics_and_curves(spark, observed):
    own = spark.createDataFrame([(y, 100.0 + y, 10.0 + y) for y in range(5)], "year int, hdd double, cdd double")
    official = spark.createDataFrame([(y, 98.0 + y, 11.0 + y) for y in range(5)], "year int, HDD_C_days double, CDD_C_days double")
    rows, both = climate.reference_comparison(own, official)
    got = {r["metric"]: r for r in both.collect()}
    assert rows.count() == 5 and got["HDD"]["bias"] == pytest.approx(2.0) and got["CDD"]["mae"] == pytest.approx(1.0) and got["HDD"]["correlation"] == pytest.approx(1.0)
    curves = timeseries.duration_curves(observed, ["observed_year"], "T_out_C", 11)
    first = curves.where("pos = 0").agg(F.max("value")).first()[0]
    assert first == observed.agg(F.max("T_out_C")).first()[0]


def test_calendar_and_gaps(spark):
    stamps = [datetime(2020, 1, 1, h) for h in (0, 1, 1, 3)]
    df = spark.createDataFrame([("a", s) for s in stamps], "k string, ts timestamp")
    row = timeseries.calendar_report(df, ["k"], "ts").first()
    assert (row["expected"], row["present"], row["missing"], row["repeated"]) == (4, 3, 1, 1)
    assert timeseries.missing_stamps(df, ["k"], "ts").count() == 1
    assert timeseries.gaps(df, ["k"], "ts").count() == 2
    assert timeseries.missing_stamps(df.limit(0), ["k"], "ts").count() == 0


def test_full_record_of_each_member(spark, observed, contract):
    table = climate.ensemble(observed, contract)
    hashes = table.select("scenario", "observed_year").distinct().withColumns({"member_sha256": F.lit("m"), "metadata_sha256": F.lit("s")})
    got = {r["member_id"]: r for r in climate.member_records(table, observed, hashes, [("hdd_low", "HDD_ratio_vs_observed", 0.99, 1.0), ("cdd_high", "CDD_change_C_days", -1e9, 1e9)]).collect()}
    assert len(got) == 4 and tuple(next(iter(got.values())).asDict()) == climate.RECORD and len(climate.RECORD) == 26
    r = got["rcp_b_2020"]
    own, before = ({x["observed_year"]: x for x in climate.annual(t, ["observed_year"]).collect()}[2020] for t in (table.where("scenario = 'rcp_b'"), observed))
    assert r["row_count"] == 8784 and r["is_leap_year"] and r["morphed_HDD_C_days"] == pytest.approx(own["hdd"]) and r["observed_HDD_C_days"] == pytest.approx(before["hdd"])
    assert r["HDD_ratio_vs_observed"] == pytest.approx(own["hdd"] / before["hdd"]) and r["annual_solar_change_kWh_m2"] == pytest.approx(own["solar_kwh"] - before["solar_kwh"])
    assert (r["warning_codes"], r["warning_count"], r["plausibility_status"], r["hard_status"], r["member_sha256"]) == ("hdd_low", 1, "warning", "pass", "m")
    plain = climate.member_records(table, observed, hashes, [("any", "T_min_C", -99.0, 99.0)]).first()
    assert (plain["warning_codes"], plain["plausibility_status"]) == ("", "pass")


def test_stored_contract_and_parameters(spark, tmp_path):
    p = tmp_path / "d.csv"
    lines = [f"{s},{m},{1 + m / 10},{1.0 + m / 100},{1.0 + m / 100},False" for s in "abc" for m in range(1, 13)]
    p.write_text("scenario,month,delta_T_C,alpha_solar_raw,alpha_solar_applied,alpha_was_clipped\n" + "\n".join(lines) + "\n")
    from tarnwerk.sources import files

    digest = files.sha256(str(p))
    table = climate.stored_contract(spark, str(p), digest)
    months = climate.scenario_parameters(table, "b")
    assert table.count() == 36 and months.where("month = 3").first()["delta"] == pytest.approx(1.3) and months.count() == 12
    with pytest.raises(checks.CheckFailed, match="sha256"):
        climate.stored_contract(spark, str(p), "0" * 64)
    with pytest.raises(checks.CheckFailed, match="rows = 24"):
        climate.stored_contract(spark, str(p), digest, scenarios=2)
    for bad in (table.where("month <> 4"), table.where("scenario = 'none'"), table.withColumn("month", F.when(F.col("month") == 4, 5).otherwise(F.col("month")))):
        with pytest.raises(checks.CheckFailed):
            climate.scenario_parameters(bad, "b")


def test_years_of_one_side_fail(spark):
    own = spark.createDataFrame([(y, 1.0, 1.0) for y in range(5)], "year int, hdd double, cdd double")
    official = spark.createDataFrame([(y, 1.0, 1.0) for y in range(1, 6)], "year int, HDD_C_days double, CDD_C_days double")
    with pytest.raises(checks.CheckFailed, match="one side"):
        climate.reference_comparison(own, official)


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_order_is_checked_within_and_between_ranges(spark, parts):
    stamps = [datetime(2020, 1, 1) + timedelta(hours=h) for h in range(200)]
    swapped = list(stamps)
    swapped[57], swapped[58] = swapped[58], swapped[57]
    swapped[150] = swapped[149]
    for rows, want in ((stamps, []), (swapped, [58, 150])):
        df = spark.createDataFrame(list(enumerate(rows)), "i long, ts timestamp").repartition(5)
        assert sorted(r["i"] for r in climate.strictly_increasing(df, "i", "ts", parts).collect()) == want
    assert climate.strictly_increasing(df.limit(0), "i", "ts").count() == 0


def test_hot_and_cold_parts_of_the_curves(observed, contract):
    rows = climate.duration_subsets(climate.ensemble(observed, contract), 101).where("scenario = 'rcp_a'").collect()
    parts = {n: [r for r in rows if r["part"] == n] for n in ("hot", "cold", "rest")}
    assert [len(parts[n]) for n in ("hot", "cold", "rest")] == [3, 3, 95]
    assert min(r["low"] for r in parts["hot"]) > max(r["high"] for r in parts["cold"])
    deltas = climate.parameter_plot(contract.withColumn("month", F.col("month").cast("int")))
    row = deltas.where("scenario = 'rcp_b' and month = 2").first()
    assert row["month_name"] == "Feb" and row["solar_change_percent"] == pytest.approx(5.2)
