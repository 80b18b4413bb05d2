"""Operators on regular time series. Columns are named by the caller, so any table with a stamp and
measures will do; families of series are one table with member columns, never many tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, clipped, close, hours_in_year, month_name, skip_nan


def climatology(df: DataFrame, keys: Sequence[str], ts: str, measures: Mapping[str, str], by_year: bool = False) -> DataFrame:
    """Means of measures (output name -> column) by keys and calendar month, with n_rows and n_years;
    with ``by_year`` by year and month. NaN is left out as null is."""
    stamped = df.withColumn("month", F.month(ts)).withColumn("year", F.year(ts))
    group = [*keys, *(["year"] if by_year else []), "month"]
    means = [F.avg(skip_nan(F.col(c).cast("double"))).alias(n) for n, c in measures.items()]
    counts = [F.count("*").alias("n_rows"), *([] if by_year else [F.count_distinct("year").alias("n_years")])]
    return stamped.groupBy(*group).agg(*counts, *means)


def with_month_names(df: DataFrame) -> DataFrame:
    return df.withColumn("month_name", month_name(F.col("month")))


def change_factors(base: DataFrame, future: DataFrame, keys: Sequence[str], shift: str, ratio: str, low: float, high: float) -> DataFrame:
    """Delta of one measure and ratio of another between two climatologies on keys + month. The ratio is
    null where the base is not positive; it is bounded by low and high and flagged where it was."""
    on = [*keys, "month"]
    b = base.select(*on, F.col("n_rows").alias("n_base"), F.col(shift).alias("shift_base"), F.col(ratio).alias("ratio_base"))
    f = future.select(*on, F.col("n_rows").alias("n_future"), F.col(shift).alias("shift_future"), F.col(ratio).alias("ratio_future"))
    raw = F.when(F.col("ratio_base") > 0, F.col("ratio_future") / F.col("ratio_base"))
    out = f.join(b, on).withColumn("delta", F.col("shift_future") - F.col("shift_base")).withColumn("alpha_raw", raw)
    return out.withColumn("alpha", clip(F.col("alpha_raw"), low, high)).withColumn("clipped", clipped(F.col("alpha_raw"), low, high))


def variability(by_year: DataFrame, base: DataFrame, future: DataFrame, keys: Sequence[str], shift: str, ratio: str) -> DataFrame:
    """Each year-month's anomaly and factor against the future climatology, and against the base one."""
    on = [*keys, "month"]
    b = base.select(*on, F.col(shift).alias("shift_base"), F.col(ratio).alias("ratio_base"))
    f = future.select(*on, F.col(shift).alias("shift_future"), F.col(ratio).alias("ratio_future"))
    joined = by_year.join(f, on).join(b, on)
    return joined.select(
        *keys, "year", "month",
        (F.col(shift) - F.col("shift_future")).alias("anomaly"),
        F.try_divide(F.col(ratio), F.col("ratio_future")).alias("factor"),
        (F.col(shift) - F.col("shift_base")).alias("anomaly_base"),
        F.try_divide(F.col(ratio), F.col("ratio_base")).alias("factor_base"),
    )


def annual_change(base: DataFrame, future: DataFrame, keys: Sequence[str], shift: str, ratio: str) -> DataFrame:
    """Overall means of the future by keys against the base's overall means (one broadcast row)."""
    b = base.agg(F.avg(shift).alias("shift_base"), F.avg(ratio).alias("ratio_base"))
    f = future.groupBy(*keys).agg(F.avg(shift).alias("shift_future"), F.avg(ratio).alias("ratio_future"))
    return f.crossJoin(F.broadcast(b)).withColumn("delta", F.col("shift_future") - F.col("shift_base")).withColumn("ratio", F.try_divide("ratio_future", "ratio_base"))


def clamp_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negative values as 0; nulls stay."""
    return df.withColumns({c: clip(F.col(c), 0.0) for c in columns})


def negative_warnings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each column with negative values: their count and the least."""
    row = df.agg(*(F.struct(F.count_if(F.col(c) < 0).alias("n"), F.min(c).cast("double").alias("least")).alias(c) for c in columns))
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.n").alias("n_negative"), F.col(f"{c}.least").alias("least")) for c in columns))
    return row.select(F.explode(each).alias("w")).select("w.*").where("n_negative > 0")


def normalise_stamps(df: DataFrame, text: str, out: str = "timestamp_utc", minute: int = 10, pattern: str = "yyyyMMdd:HHmm") -> DataFrame:
    """Stamps parsed and floored to the hour, and ``stamp_ok``: parsed, with the expected minute."""
    parsed = F.try_to_timestamp(F.col(text), F.lit(pattern))
    return df.withColumn(out, F.date_trunc("hour", parsed)).withColumn("stamp_ok", F.coalesce(F.minute(parsed) == minute, F.lit(False)))


def calendar(df: DataFrame, keys: Sequence[str], ts: str, unit: str = "hour") -> DataFrame:
    """Every stamp between each group's first and last, in steps of one unit."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return ends.select(*keys, F.explode(F.sequence(F.date_trunc(unit, "lo"), F.date_trunc(unit, "hi"), F.expr(f"interval 1 {unit}"))).alias(ts))


def missing_stamps(df: DataFrame, keys: Sequence[str], ts: str, unit: str = "hour") -> DataFrame:
    """Stamps of the calendar that a group lacks."""
    have = df.select(*keys, F.date_trunc(unit, ts).alias(ts)).distinct()
    return calendar(have, keys, ts, unit).join(have, [*keys, ts], "left_anti")


def calendar_report(df: DataFrame, keys: Sequence[str], ts: str, unit: str = "hour") -> DataFrame:
    """By group: expected, present, missing and repeated stamps."""
    per = df.groupBy(*keys, F.date_trunc(unit, ts).alias("at")).agg(F.count("*").alias("n"))
    have = per.groupBy(*keys).agg(F.count("*").alias("present"), F.sum(F.col("n") - 1).alias("repeated"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    seconds = {"hour": 3600, "day": 86400}[unit]
    expected = (F.unix_timestamp("hi") - F.unix_timestamp("lo")) / seconds + 1
    return have.withColumn("expected", expected.cast("long")).withColumn("missing", F.col("expected") - F.col("present")).drop("lo", "hi")


def complete_years(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """By group and year: rows, expected hours, and whether every hour is there once."""
    at = F.date_trunc("hour", F.col(ts))
    out = df.withColumn("year", F.year(ts)).groupBy(*keys, "year").agg(F.count("*").alias("rows"), F.count_distinct(at).alias("hours"))
    out = out.withColumn("expected", hours_in_year(F.col("year")))
    return out.withColumn("complete", (F.col("rows") == F.col("expected")) & (F.col("hours") == F.col("expected")))


def gaps(df: DataFrame, keys: Sequence[str], ts: str, step_seconds: int = 3600) -> DataFrame:
    """Neighbouring stamps of a group that aren't one step apart."""
    w = Window.partitionBy(*keys).orderBy(ts)
    out = df.select(*keys, ts).withColumn("previous", F.lag(ts).over(w))
    return out.withColumn("step", F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.col("previous").cast("timestamp"))).where(F.col("step") != step_seconds)


def morph(series: DataFrame, factors: DataFrame, on: Sequence[str], shift: Sequence[str], scale: Sequence[str], total: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Every series row under every scenario of ``factors`` (scenario, *on, delta, alpha): columns of
    ``shift`` + delta, of ``scale`` x alpha, totals summed anew, all other columns as they were.
    The factors are a few rows a scenario; Spark broadcasts them if their size allows."""
    out = series.join(factors.select("scenario", *on, "delta", "alpha"), list(on))
    out = out.withColumns({c: F.col(c) + F.col("delta") for c in shift} | {c: F.col(c) * F.col("alpha") for c in scale})
    for name, parts in (total or {}).items():
        out = out.withColumn(name, sum((F.col(p) for p in parts[1:]), F.col(parts[0])))
    return out


def facade_totals(planes: DataFrame, alpha: Column, parts: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column for each plane: the sum of its parts, scaled."""
    return planes.withColumns({n: sum((F.col(p) for p in ps[1:]), F.col(ps[0])) * alpha for n, ps in parts.items()})


def daily_means(df: DataFrame, keys: Sequence[str], ts: str, measures: Mapping[str, str]) -> DataFrame:
    """Means by keys and UTC day."""
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(*(F.avg(skip_nan(F.col(c).cast("double"))).alias(n) for n, c in measures.items()))


def degree_days(daily: DataFrame, keys: Sequence[str], value: str, heat_limit: float = 15.0, heat_base: float = 18.0, cool_limit: float = 24.0, cool_base: float = 21.0) -> DataFrame:
    """Sums of base - value where value <= heat_limit, and of value - base where value >= cool_limit."""
    v = F.col(value)
    heat = F.sum(F.when(v <= heat_limit, F.lit(heat_base) - v).otherwise(0.0))
    cool = F.sum(F.when(v >= cool_limit, v - F.lit(cool_base)).otherwise(0.0))
    return daily.groupBy(*keys).agg(F.count("*").alias("n_days"), heat.alias("hdd"), cool.alias("cdd"))


def annual_metrics(hourly: DataFrame, keys: Sequence[str], ts: str, temperature: str, irradiance: str, **limits: float) -> DataFrame:
    """Degree days of UTC daily means and the sum of irradiance in thousands, by keys."""
    days = hourly.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.avg(temperature).alias("t"), F.sum(irradiance).alias("s"), F.count("*").alias("n"))
    t, heat = F.col("t"), {"heat_limit": 15.0, "heat_base": 18.0, "cool_limit": 24.0, "cool_base": 21.0} | limits
    return days.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(t <= heat["heat_limit"], heat["heat_base"] - t).otherwise(0.0)).alias("hdd"),
        F.sum(F.when(t >= heat["cool_limit"], t - heat["cool_base"]).otherwise(0.0)).alias("cdd"),
        (F.sum("s") / 1000).alias("solar_kwh"),
    )


def pair_invariants(member: DataFrame, source: DataFrame, on: Sequence[str], keys: Sequence[str], month: Column, shift: str, scales: Sequence[str], fixed: Sequence[str], atol: float = 1e-8) -> DataFrame:
    """By member and month: mean shift and ratios of sums against what was applied, and how many fixed
    values changed. ``member`` carries delta and alpha."""
    s = source.select(*on, *(F.col(c).alias(f"{c}__s") for c in [shift, *scales, *fixed]))
    changed = sum((F.count_if(~F.col(c).eqNullSafe(F.col(f"{c}__s"))) for c in fixed[1:]), F.count_if(~F.col(fixed[0]).eqNullSafe(F.col(f"{fixed[0]}__s")))) if fixed else F.lit(0).cast("long")
    out = member.join(s, list(on)).withColumn("month", month).groupBy(*keys, "month").agg(
        F.count("*").alias("rows"), F.avg(F.col(shift) - F.col(f"{shift}__s")).alias("mean_shift"), F.max("delta").alias("delta"), F.max("alpha").alias("alpha"),
        *(F.try_divide(F.sum(c), F.sum(f"{c}__s")).alias(f"{c}_ratio") for c in scales), changed.alias("changed"),
    )
    ok = close(F.col("mean_shift"), F.col("delta"), atol) & (F.col("changed") == 0)
    for c in scales:
        ok = ok & F.coalesce(close(F.col(f"{c}_ratio"), F.col("alpha"), atol), F.lit(True))
    return out.withColumn("ok", ok)


def duration_curves(df: DataFrame, keys: Sequence[str], value: str, points: int = 1001) -> DataFrame:
    """By keys, exceedance curves: for each position the quantile at 1 - position / (points - 1), by linear
    interpolation. ``percentile`` merges value counts, so partial results travel, not rows."""
    grid = F.array(*[F.lit(1.0 - i / (points - 1)) for i in range(points)])
    return df.groupBy(*keys).agg(F.percentile(value, grid).alias("curve")).select(*keys, F.posexplode("curve").alias("pos", "value"))


def curve_bands(curves: DataFrame, keys: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Median and band of many curves at each position."""
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(low), F.lit(high)))
    return curves.groupBy(*keys, "pos").agg(q.alias("q")).select(*keys, "pos", F.col("q")[0].alias("median"), F.col("q")[1].alias("low"), F.col("q")[2].alias("high"))


def manifest(df: DataFrame, keys: Sequence[str], ts: str, measures: Sequence[str]) -> DataFrame:
    """One row a member: rows, first and last stamp, and least, largest and mean of each measure."""
    stats = [f(c).alias(f"{c}_{n}") for c in measures for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return df.groupBy(*keys).agg(F.count("*").alias("row_count"), F.min(ts).alias("start"), F.max(ts).alias("end"), *stats)


def month_matrix(df: DataFrame, row: Sequence[str], month: str, value: str) -> DataFrame:
    """Rows x twelve month columns m1..m12."""
    out = df.groupBy(*row).pivot(month, list(range(1, 13))).agg(F.first(value))
    return out.withColumnsRenamed({str(m): f"m{m}" for m in range(1, 13)})


def heat_scale(df: DataFrame, columns: Sequence[str], least: float = 1e-8) -> DataFrame:
    """The largest absolute value of a matrix, at least ``least``."""
    return df.agg(F.greatest(F.lit(least), *(F.coalesce(F.max(F.abs(skip_nan(F.col(c)))), F.lit(least)) for c in columns)).alias("scale"))
