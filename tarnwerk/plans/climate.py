"""Climate plans: cleaned hourly series, monthly change factors, an ensemble as one table, and its audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import close, finite, flag, is_leap
from ..operators import checks, stats, timeseries
from ..sources import files

#: Bounds of the measures, of the solar factor, and of the degree days.
T_BOUNDS, SOLAR_BOUNDS, ALPHA_BOUNDS = (-35.0, 50.0), (0.0, 1500.0), (0.7, 1.3)
LIMITS = {"heat_limit": 15.0, "heat_base": 18.0, "cool_limit": 24.0, "cool_base": 21.0}
HOURLY = ("timestamp_utc", "T_out_C", "I_beam_horizontal_W_m2", "I_diffuse_horizontal_W_m2", "I_solar_W_m2", "wind_speed_10m_m_s", "sun_height_deg", "pvgis_reconstructed")
BEAM, DIFFUSE, SOLAR = "I_beam_horizontal_W_m2", "I_diffuse_horizontal_W_m2", "I_solar_W_m2"


def daily_source(df: DataFrame) -> DataFrame:
    """A daily source if its stamps are every day's noon, its measures in range, its labels constant."""
    checks.require_columns(df, ["timestamp", "T_out_C", "I_solar_W_m2"])
    labels = [c for c in ("scenario", "window", "gcm_model", "rcm_model", "ensemble_member") if c in df.columns]
    noon = checks.audit(df, {"noon stamps": (F.hour("timestamp") == 12) & (F.minute("timestamp") == 0)})
    report = timeseries.calendar_report(df.withColumn("timestamp", F.col("timestamp").cast("timestamp")), [], "timestamp", "day")
    complete = checks.audit(report, {"every day once": (F.col("missing") == 0) & (F.col("repeated") == 0)})
    return checks.enforce(df, noon, complete, checks.in_range(df, {"T_out_C": T_BOUNDS, "I_solar_W_m2": SOLAR_BOUNDS}), *(checks.constant(df, c) for c in labels))


def clean_hourly(plane: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A raw plane (time text, Gb(i), Gd(i), H_sun, T2m, WS10m, Int) as the canonical hourly table, and its
    warnings. Raises on bad stamps, non-numbers, values out of range or light at night."""
    beam, diffuse = F.col("`Gb(i)`"), F.col("`Gd(i)`")
    raw = timeseries.normalise_stamps(plane, "time").select("timestamp_utc", "stamp_ok", F.col("T2m").alias("T_out_C"), beam.alias(BEAM), diffuse.alias(DIFFUSE), F.col("WS10m").alias("wind_speed_10m_m_s"), F.col("H_sun").alias("sun_height_deg"), (F.col("Int") != 0).alias("pvgis_reconstructed"))
    warnings = timeseries.negative_warnings(raw, [BEAM, DIFFUSE])
    clean = timeseries.clamp_negative(raw, [BEAM, DIFFUSE]).withColumn(SOLAR, F.col(BEAM) + F.col(DIFFUSE))
    rules = {"stamps at ten past": F.col("stamp_ok"), "not reconstructed": ~F.col("pvgis_reconstructed")}
    out = clean.select(*HOURLY)
    checks.enforce(clean, checks.audit(clean, rules), *hourly_checks(out))
    return out, warnings


def hourly_checks(df: DataFrame, atol: float = 2e-10) -> list[DataFrame]:
    """Invariants of canonical hourly rows, in one pass over them."""
    solar = F.greatest(F.col(BEAM), F.col(DIFFUSE), F.col(SOLAR))
    return [checks.audit(df, {
        "finite": finite(F.col("T_out_C")) & finite(F.col(BEAM)) & finite(F.col(DIFFUSE)) & finite(F.col(SOLAR)) & finite(F.col("wind_speed_10m_m_s")) & finite(F.col("sun_height_deg")),
        "temperature in range": F.col("T_out_C").between(*T_BOUNDS), "irradiance in range": F.least(F.col(BEAM), F.col(DIFFUSE)).between(*SOLAR_BOUNDS) & F.col(SOLAR).between(*SOLAR_BOUNDS),
        "wind not negative": F.col("wind_speed_10m_m_s") >= 0, "solar is beam and diffuse": close(F.col(SOLAR), F.col(BEAM) + F.col(DIFFUSE), atol),
        "no light at night": ~(F.col("sun_height_deg") < 0) | (solar == 0), "not reconstructed": ~F.col("pvgis_reconstructed"),
    })]


def complete_years(df: DataFrame) -> DataFrame:
    """The hourly table with ``observed_year``, if every year has each of its hours once."""
    years = timeseries.complete_years(df, [], "timestamp_utc")
    checks.enforce_empty(df, "years are not complete", years.where("not complete"))
    return df.withColumn("observed_year", F.year("timestamp_utc"))


def monthly_deltas(daily: DataFrame, baseline: str = "historical", bounds: tuple[float, float] = ALPHA_BOUNDS) -> DataFrame:
    """Monthly deltas and solar factors of every future scenario against the baseline, from one daily table
    with a ``scenario`` column."""
    clim = timeseries.climatology(daily, ["scenario"], "timestamp", {"T": "T_out_C", "I": "I_solar_W_m2"})
    return deltas_of(clim, baseline, bounds)


def deltas_of(clim: DataFrame, baseline: str = "historical", bounds: tuple[float, float] = ALPHA_BOUNDS) -> DataFrame:
    """The same from climatologies (scenario, month, n_rows, T, I)."""
    base = clim.where(F.col("scenario") == baseline).drop("scenario")
    future = clim.where(F.col("scenario") != baseline)
    each = future.select("scenario").distinct().crossJoin(base)
    out = timeseries.change_factors(each, future, ["scenario"], "T", "I", *bounds)
    return timeseries.with_month_names(out)


def delta_contract(deltas: DataFrame, bounds: tuple[float, float] = ALPHA_BOUNDS, digits: int | None = 10) -> DataFrame:
    """scenario, month, delta, alpha, as they are applied: rounded as they are stored, months complete,
    nothing clipped, factors in bounds."""
    checks.enforce_empty(deltas, "months are not complete", checks.covers(deltas.withColumn("month", F.col("month").cast("int")), ["scenario"], "month", list(range(1, 13))))
    checks.enforce(deltas, checks.audit(deltas, {"not clipped": ~F.col("clipped"), "applied as computed": close(F.col("alpha"), F.col("alpha_raw"), 1e-12)}), checks.in_range(deltas, {"alpha": bounds}))
    d, a = F.col("delta"), F.col("alpha")
    return deltas.select("scenario", "month", (F.round(d, digits) if digits else d).alias("delta"), (F.round(a, digits) if digits else a).alias("alpha"))


def stored_contract(spark: SparkSession, path: str, expected_sha256: str, bounds: tuple[float, float] = ALPHA_BOUNDS, scenarios: int = 3) -> DataFrame:
    """The contract read from a stored CSV (scenario, month, delta_T_C, alpha_solar_raw, alpha_solar_applied,
    alpha_was_clipped), if the file has the expected hash and one row for each scenario and month."""
    files.require_hash(path, expected_sha256)
    raw = files.csv(spark, path, columns=["scenario", "month", "delta_T_C", "alpha_solar_raw", "alpha_solar_applied", "alpha_was_clipped"])
    typed = raw.select("scenario", F.col("month").cast("int").alias("month"), F.col("delta_T_C").cast("double").alias("delta"), F.col("alpha_solar_raw").cast("double").alias("alpha_raw"), F.col("alpha_solar_applied").cast("double").alias("alpha"), flag(F.col("alpha_was_clipped")).alias("clipped"))
    checks.enforce(typed, checks.row_count(typed, 12 * scenarios), checks.unique_key(typed, ["scenario", "month"]))
    return delta_contract(typed, bounds)


def scenario_parameters(contract: DataFrame, scenario: str) -> DataFrame:
    """The twelve months of one scenario: month, delta, alpha. Another number of months raises."""
    out = contract.where(F.col("scenario") == scenario).select("month", "delta", "alpha")
    months = out.select(F.lit(scenario).alias("scenario"), F.col("month").cast("int").alias("month"))
    checks.enforce(out, checks.row_count(out, 12))
    return checks.enforce_empty(out, f"{scenario} doesn't have each month", checks.covers(months, ["scenario"], "month", list(range(1, 13))))


def parameter_plot(deltas: DataFrame) -> DataFrame:
    """What a plot of the monthly parameters shows: scenario, month, name, delta, and the sun's change in %."""
    return timeseries.with_month_names(deltas).select("scenario", "month", "month_name", "delta", ((F.col("alpha") - 1) * 100).alias("solar_change_percent"))


def ensemble(observed: DataFrame, contract: DataFrame) -> DataFrame:
    """Every observed year under every scenario, as one table: T + delta, beam and diffuse x alpha, their sum
    anew, all else unchanged. Written with ``partitionBy(scenario, observed_year)``, a member is a folder."""
    stamped = observed.withColumn("month", F.month("timestamp_utc"))
    return timeseries.morph(stamped, contract, ["month"], ["T_out_C"], [BEAM, DIFFUSE], {SOLAR: [BEAM, DIFFUSE]})


def facades(member: DataFrame, planes: DataFrame, orientations: Sequence[str]) -> DataFrame:
    """Irradiance of each orientation under a member: (beam + diffuse + reflected) x alpha. ``planes`` is long:
    timestamp_utc, orientation, beam, diffuse, reflected; hours that a plane lacks raise."""
    wide = planes.groupBy("timestamp_utc").pivot("orientation", list(orientations)).agg(F.sum(F.col("beam") + F.col("diffuse") + F.col("reflected")))
    joined = member.join(wide, "timestamp_utc", "left")
    checks.enforce(joined, checks.not_null(joined, list(orientations)))
    return joined.withColumns({f"I_facade_{o}_W_m2": F.col(o) * F.col("alpha") for o in orientations}).drop(*orientations)


def members(table: DataFrame) -> DataFrame:
    """The manifest: one row a member."""
    out = timeseries.manifest(table, ["scenario", "observed_year"], "timestamp_utc", ["T_out_C", SOLAR])
    return out.withColumn("is_leap_year", is_leap(F.col("observed_year"))).withColumn("member_id", F.format_string("%s_%d", "scenario", "observed_year"))


def annual(table: DataFrame, keys: Sequence[str] = ("scenario", "observed_year")) -> DataFrame:
    return timeseries.annual_metrics(table, list(keys), "timestamp_utc", "T_out_C", SOLAR, **LIMITS)


def invariants(table: DataFrame, observed: DataFrame, atol: float = 1e-8) -> DataFrame:
    """By member and month: what was applied against what is found."""
    return timeseries.pair_invariants(table, observed, ["timestamp_utc"], ["scenario", "observed_year"], F.month("timestamp_utc"), "T_out_C", [BEAM, DIFFUSE, SOLAR], ["wind_speed_10m_m_s", "sun_height_deg", "pvgis_reconstructed"], atol)


def member_summary(table: DataFrame, observed: DataFrame) -> DataFrame:
    """Each member's metrics beside those of its observed year: changes of degree days and ratio of sun."""
    o = annual(observed, ["observed_year"]).select("observed_year", F.col("hdd").alias("observed_hdd"), F.col("cdd").alias("observed_cdd"), F.col("solar_kwh").alias("observed_solar"))
    out = annual(table).join(o, "observed_year")
    return out.withColumn("hdd_ratio", F.try_divide("hdd", "observed_hdd")).withColumn("cdd_change", F.col("cdd") - F.col("observed_cdd")).withColumn("solar_ratio", F.try_divide("solar_kwh", "observed_solar"))


#: Plausible bands as (code, column, low, high).
BANDS = (("hdd_ratio_outside_band", "HDD_ratio_vs_observed", 0.65, 1.0), ("cdd_change_outside_band", "CDD_change_C_days", 0.0, 150.0), ("solar_ratio_outside_band", "annual_solar_ratio_vs_observed", 0.95, 1.15))
#: The columns of a member's record.
RECORD = (
    "member_id", "scenario", "observed_pvgis_year", "is_leap_year", "row_count", "member_sha256", "metadata_sha256", "hard_status", "plausibility_status", "warning_count", "warning_codes",
    "T_min_C", "T_max_C", "I_solar_min_W_m2", "I_solar_max_W_m2", "observed_HDD_C_days", "morphed_HDD_C_days", "HDD_change_C_days", "HDD_ratio_vs_observed", "observed_CDD_C_days",
    "morphed_CDD_C_days", "CDD_change_C_days", "observed_annual_solar_kWh_m2", "morphed_annual_solar_kWh_m2", "annual_solar_change_kWh_m2", "annual_solar_ratio_vs_observed",
)


def member_records(table: DataFrame, observed: DataFrame, hashes: DataFrame, bands: Sequence[tuple[str, str, float, float]] = BANDS) -> DataFrame:
    """The full record of each member that passed its hard checks. ``hashes`` has scenario, observed_year,
    member_sha256 and metadata_sha256."""
    keys = ["scenario", "observed_year"]
    ranges = table.groupBy(*keys).agg(F.count("*").alias("row_count"), *(f(c).alias(n) for c, t in (("T_out_C", "T_{}_C"), (SOLAR, "I_solar_{}_W_m2")) for f, n in ((F.min, t.format("min")), (F.max, t.format("max")))))
    m = member_summary(table, observed).join(ranges, keys).join(hashes, keys, "left")
    named = {"HDD": ("observed_hdd", "hdd"), "CDD": ("observed_cdd", "cdd")}
    for n, (before, after) in named.items():
        m = m.withColumns({f"observed_{n}_C_days": F.col(before), f"morphed_{n}_C_days": F.col(after), f"{n}_change_C_days": F.col(after) - F.col(before)})
    m = m.withColumns({
        "HDD_ratio_vs_observed": F.try_divide("hdd", "observed_hdd"), "observed_annual_solar_kWh_m2": F.col("observed_solar"), "morphed_annual_solar_kWh_m2": F.col("solar_kwh"),
        "annual_solar_change_kWh_m2": F.col("solar_kwh") - F.col("observed_solar"), "annual_solar_ratio_vs_observed": F.try_divide("solar_kwh", "observed_solar"),
        "observed_pvgis_year": F.col("observed_year"), "is_leap_year": is_leap(F.col("observed_year")), "member_id": F.format_string("%s_%d", "scenario", "observed_year"), "hard_status": F.lit("pass"),
    })
    outside = [F.when(~F.coalesce(F.col(c).between(lo, hi), F.lit(False)), F.lit(code)) for code, c, lo, hi in bands]
    m = m.withColumn("codes", F.filter(F.array(*outside), lambda x: x.isNotNull()))
    m = m.withColumns({"warning_count": F.size("codes"), "warning_codes": F.array_join("codes", ";"), "plausibility_status": F.when(F.size("codes") > 0, "warning").otherwise("pass")})
    return m.select(*RECORD)


def implausible(summary: DataFrame, bands: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Warnings; degree days of cooling are compared by difference, never by ratio."""
    return checks.outside_bands(summary, ["scenario", "observed_year"], [(f"{c}_outside_band", c, lo, hi) for c, (lo, hi) in bands.items()])


def reference_comparison(observed: DataFrame, official: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annual degree days against official ones: errors by year, and correlation, bias and absolute error. A
    year that one side lacks or has twice raises."""
    a = observed.select("year", F.col("hdd").alias("hdd_own"), F.col("cdd").alias("cdd_own"))
    checks.enforce(a, checks.unique_key(a, ["year"]), checks.unique_key(official, ["year"]))
    checks.enforce_empty(a, "years of one side only", checks.key_difference(a, official, ["year"]))
    joined = a.join(official, "year")
    rows = joined.withColumn("hdd_error", F.col("hdd_own") - F.col("HDD_C_days")).withColumn("cdd_error", F.col("cdd_own") - F.col("CDD_C_days"))
    h = stats.error_statistics(rows, "hdd_own", "HDD_C_days").withColumn("metric", F.lit("HDD"))
    c = stats.error_statistics(rows, "cdd_own", "CDD_C_days").withColumn("metric", F.lit("CDD"))
    return rows, h.unionByName(c)


def direct_against_morphed(direct: DataFrame, summary: DataFrame, baseline: str = "historical") -> DataFrame:
    """By scenario: change of annual degree days in the climate source (future mean - baseline mean) beside the
    mean paired change of the members (morphed - observed)."""
    base = direct.where(F.col("scenario") == baseline).agg(F.avg("hdd").alias("base_hdd"), F.avg("cdd").alias("base_cdd"))
    future = direct.where(F.col("scenario") != baseline).groupBy("scenario").agg(F.avg("hdd").alias("future_hdd"), F.avg("cdd").alias("future_cdd")).crossJoin(F.broadcast(base))
    paired = summary.groupBy("scenario").agg(F.avg(F.col("hdd") - F.col("observed_hdd")).alias("paired_hdd"), F.avg("cdd_change").alias("paired_cdd"))
    out = future.join(paired, "scenario")
    return out.withColumn("direct_hdd", F.col("future_hdd") - F.col("base_hdd")).withColumn("direct_cdd", F.col("future_cdd") - F.col("base_cdd"))


def duration_data(table: DataFrame, points: int = 1001) -> DataFrame:
    """Median and 5-95 % band of the members' temperature-duration curves by scenario."""
    return timeseries.curve_bands(timeseries.duration_curves(table, ["scenario", "observed_year"], "T_out_C", points), ["scenario"])


def duration_subsets(table: DataFrame, points: int = 1001, share: float = 2.0) -> DataFrame:
    """The duration data with ``exceedance`` in % of hours and ``part``: hot, cold, or the rest, the outer ones
    being ``share`` % at either end."""
    x = F.col("pos") * (100.0 / (points - 1))
    out = duration_data(table, points).withColumn("exceedance", x)
    return out.withColumn("part", F.when(x <= share, "hot").when(x >= 100 - share, "cold").otherwise("rest"))


def residual_matrix(invariant_rows: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """Members in a fixed order x months of the residual temperature shift."""
    long = invariant_rows.withColumn("residual", F.col("mean_shift") - F.col("delta"))
    wide = timeseries.month_matrix(long, ["scenario", "observed_year"], "month", "residual")
    return stats.ordinals(wide, "scenario", list(scenarios), "observed_year", "row")


def day_weighted_check(variability: DataFrame, days: DataFrame) -> DataFrame:
    """Day-weighted means of a variability table's anomalies, which are zero by construction."""
    w = variability.join(days, ["scenario", "year", "month"])
    return stats.weighted_mean(w, ["scenario", "month"], "anomaly", "n_rows")


def strictly_increasing(df: DataFrame, position: str, ts: str, parts: int = 32) -> DataFrame:
    """Rows whose stamp doesn't exceed that of the row before, by a given number of the row. Rows are compared
    within ranges of positions, and the ranges by their ends, so no task holds all rows."""
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(df.agg(F.percentile_approx(position, shares)).first()[0] or [])) if shares else []
    part = reduce(lambda a, b: a + b, [(F.col(position) >= b).cast("int") for b in bounds], F.lit(0))
    ranged = df.withColumn("__part", part)
    ends = ranged.groupBy("__part").agg(F.max_by(ts, position).alias("__end"))
    before = ends.withColumn("__end", F.lag("__end").over(Window.orderBy("__part")))  # a row a range
    inner = F.lag(ts).over(Window.partitionBy("__part").orderBy(position))
    out = ranged.withColumn("previous", inner).join(before, "__part").withColumn("previous", F.coalesce("previous", "__end"))
    return out.where(F.col(ts) <= F.col("previous")).drop("__part", "__end")
