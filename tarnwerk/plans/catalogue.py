"""The query catalogue: every operator on the star schema, with its SQL.

``QUERIES`` maps names to functions of (spark, folder), ``ORACLE_SQL`` has the same names. Whole numbers
are longs and doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType

from ..functions import scalars as fn
from ..operators import alloc, checks, fanout, stats, timeseries
from . import stock

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Fixed values of the catalogue's literal tables.
SCENARIOS = (("central", 1.0, 1.05), ("high", 2.0, 1.10), ("low", 0.5, 1.02))
PRIORITIES = {"AUTOMOBILE": 4, "BUILDING": 4, "FURNITURE": 3, "HOUSEHOLD": 2, "MACHINERY": 1}
RATES = {"low": 0.008, "central": 0.03, "high": 0.04}
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
YEARS = 25
HEATING = (("electricity", 0.075), ("gas", 0.712), ("oil", 0.147), ("other", 0.066))
COOLING = (("current_regional", 0.13), ("higher_uptake", 0.26), ("no_active_cooling", 0.0))
BRIDGE = (("1-URGENT", "top", 1.0), ("2-HIGH", "top", 0.5), ("2-HIGH", "middle", 0.5), ("3-MEDIUM", "middle", 1.0), ("4-NOT SPECIFIED", "middle", 0.5), ("4-NOT SPECIFIED", "rest", 0.5), ("5-LOW", "rest", 1.0))
HEAT = {"heat_limit": 48.0, "heat_base": 50.0, "cool_limit": 51.0, "cool_base": 49.0}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as longs, doubles rounded."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ByteType | ShortType | IntegerType):
            c = c.cast("long")
        elif isinstance(f.dataType, DoubleType | FloatType):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL; R(x) in the SQL rounds."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(f(spark, sf_dir), digits)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = _rounded(sql, digits)
        return f

    return register


def _rounded(sql: str, digits: int) -> str:
    out, at = [], 0
    while (i := sql.find("R(", at)) >= 0:
        if i and (sql[i - 1].isalnum() or sql[i - 1] == "_"):
            out.append(sql[at : i + 2])
            at = i + 2
            continue
        depth, j = 1, i + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out.append(sql[at:i] + f"(round(cast({_rounded(sql[i + 2 : j - 1], digits)} as double), {digits}) + 0.0)")
        at = j
    return "".join(out) + sql[at:]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)


# Time series -----------------------------------------------------------------------------------

_MEASURES = {"quantity": "l_quantity", "price": "l_extendedprice"}
_CLIM = """select l_returnflag, l_linestatus, month(l_shipdate) as month, count(*) as n_rows,
    count(distinct year(l_shipdate)) as n_years, avg(l_quantity) as quantity, avg(l_extendedprice) as price
    from lineitem group by all"""


def _climate(spark: SparkSession, sf_dir: str, status: str | None = None, by_year: bool = False) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_extendedprice")
    if status:
        li = li.where(F.col("l_linestatus") == status)
    keys = ["l_returnflag"] if status else ["l_returnflag", "l_linestatus"]
    return timeseries.climatology(li, keys, "l_shipdate", _MEASURES, by_year)


@query(f"select l_returnflag, l_linestatus, month, strftime(make_date(2000, month, 1), '%b') as month_name, n_rows, n_years, R(quantity) as quantity, R(price) as price from ({_CLIM})", 4)
def monthly_climatology(spark, sf_dir):
    return timeseries.with_month_names(_climate(spark, sf_dir)).select("l_returnflag", "l_linestatus", "month", "month_name", "n_rows", "n_years", "quantity", "price")


_DELTAS = f"""with c as ({_CLIM}), j as (
    select f.l_returnflag, f.month, b.n_rows as n_base, f.n_rows as n_future, b.quantity as shift_base, f.quantity as shift_future,
        b.price as ratio_base, f.price as ratio_future, f.quantity - b.quantity as delta, case when b.price > 0 then f.price / b.price end as alpha_raw
    from c f join c b on f.l_returnflag = b.l_returnflag and f.month = b.month where f.l_linestatus = 'O' and b.l_linestatus = 'F'),
    d as (select *, greatest(least(alpha_raw, 1.02), 0.98) as alpha, alpha_raw < 0.98 or alpha_raw > 1.02 as clipped from j)"""


def _factors(spark, sf_dir) -> DataFrame:
    return timeseries.change_factors(_climate(spark, sf_dir, "F"), _climate(spark, sf_dir, "O"), ["l_returnflag"], "quantity", "price", 0.98, 1.02)


@query(_DELTAS + "select l_returnflag, month, n_base, n_future, R(shift_base) as shift_base, R(shift_future) as shift_future, R(delta) as delta, R(alpha_raw) as alpha_raw, R(alpha) as alpha, clipped from d", 5)
def monthly_deltas(spark, sf_dir):
    return _factors(spark, sf_dir).select("l_returnflag", "month", "n_base", "n_future", "shift_base", "shift_future", "delta", "alpha_raw", "alpha", "clipped")


@query(_DELTAS + """, o as (select row_number() over (order by alpha_raw, l_returnflag, month) as lo, row_number() over (order by alpha_raw desc, l_returnflag, month) as hi, * from d)
    select 'min' as side, R(alpha_raw) as value, l_returnflag, month from o where lo = 1 union all select 'max', R(alpha_raw), l_returnflag, month from o where hi = 1""", 5)
def alpha_extremes(spark, sf_dir):
    return stats.extremes(_factors(spark, sf_dir), "alpha_raw", ["l_returnflag", "month"], ["l_returnflag", "month"])


@query("""with c as (select l_returnflag, l_linestatus, month(l_shipdate) as month, avg(l_quantity) as q, avg(l_extendedprice) as p from lineitem group by all),
    y as (select l_returnflag, year(l_shipdate) as year, month(l_shipdate) as month, avg(l_quantity) as q, avg(l_extendedprice) as p from lineitem where l_linestatus = 'O' group by all)
    select y.l_returnflag, y.year, y.month, R(y.q - f.q) as anomaly, R(y.p / f.p) as factor, R(y.q - b.q) as anomaly_base, R(y.p / b.p) as factor_base
    from y join c f on f.l_returnflag = y.l_returnflag and f.month = y.month and f.l_linestatus = 'O'
    join c b on b.l_returnflag = y.l_returnflag and b.month = y.month and b.l_linestatus = 'F'""")
def year_month_variability(spark, sf_dir):
    return timeseries.variability(_climate(spark, sf_dir, "O", True), _climate(spark, sf_dir, "F"), _climate(spark, sf_dir, "O"), ["l_returnflag"], "quantity", "price")


@query("""with b as (select avg(l_quantity) as q, avg(l_extendedprice) as p from lineitem where l_linestatus = 'F'),
    f as (select l_returnflag, avg(l_quantity) as q, avg(l_extendedprice) as p from lineitem where l_linestatus = 'O' group by all)
    select l_returnflag, R(f.q) as shift_future, R(f.p) as ratio_future, R(b.q) as shift_base, R(b.p) as ratio_base, R(f.q - b.q) as delta, R(f.p / b.p) as ratio from f cross join b""", 4)
def annual_diagnostics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    return timeseries.annual_change(li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'"), ["l_returnflag"], "q", "p")


@query("select event_id, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') as hour_utc, strftime(ts, '%Y-%m-%d') as day, minute(ts) as minute_of_hour from events")
def timestamp_normalise(spark, sf_dir):
    ts = F.col("ts").cast("timestamp_ntz")
    text = table(spark, sf_dir, "events").select("event_id", F.date_format(ts, "yyyyMMdd:HHmm").alias("stamp"))
    out = timeseries.normalise_stamps(text, "stamp", "hour", 10)
    return out.select("event_id", fn.iso_utc(F.col("hour")).alias("hour_utc"), F.date_format("hour", "yyyy-MM-dd").alias("day"), F.minute(fn.stamp(F.col("stamp"))).alias("minute_of_hour"))


_DAILY = "select event_type, cast(ts as date) as day, avg(value) as value from events group by all"


@query(f"select event_type, strftime(day, '%Y-%m-%d') as day, R(value) as value from ({_DAILY})")
def daily_means(spark, sf_dir):
    return timeseries.daily_means(table(spark, sf_dir, "events"), ["event_type"], "ts", {"value": "value"}).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_DD = "sum(case when value <= 48 then 50 - value else 0 end) as hdd, sum(case when value >= 51 then value - 49 else 0 end) as cdd"


@query(f"select count(*) as n_days, R(sum(case when value <= 48 then 50 - value else 0 end)) as hdd, R(sum(case when value >= 51 then value - 49 else 0 end)) as cdd from (select cast(ts as date) as day, avg(value) as value from events group by all)")
def degree_days(spark, sf_dir):
    return timeseries.degree_days(timeseries.daily_means(table(spark, sf_dir, "events"), [], "ts", {"value": "value"}), [], "value", **HEAT)


@query("""with d as (select event_type, cast(ts as date) as day, avg(value) as t, sum(value) as s, count(*) as n from events group by all)
    select event_type, cast(sum(n) as bigint) as rows, R(sum(case when t <= 48 then 50 - t else 0 end)) as hdd, R(sum(case when t >= 51 then t - 49 else 0 end)) as cdd, R(sum(s) / 1000) as solar_kwh from d group by all""", 5)
def annual_degree_days_by_group(spark, sf_dir):
    return timeseries.annual_metrics(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", "value", **HEAT)


@query("""with h as (select distinct event_type, date_trunc('hour', ts) as hr from events), e as (select event_type, min(hr) as lo, max(hr) as hi, count(*) as n from h group by all),
    c as (select event_type, unnest(generate_series(lo, hi, interval 1 hour)) as hr from e)
    select c.event_type, strftime(c.hr, '%Y-%m-%d %H') as hour from c anti join h on c.event_type = h.event_type and c.hr = h.hr""")
def calendar_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return timeseries.missing_stamps(e, ["event_type"], "ts").select("event_type", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))


@query("""with p as (select event_type, date_trunc('hour', ts) as hr, count(*) as n from events group by all)
    select event_type, count(*) as present, cast(sum(n - 1) as bigint) as repeated, date_diff('hour', min(hr), max(hr)) + 1 as expected, date_diff('hour', min(hr), max(hr)) + 1 - count(*) as missing from p group by all""")
def calendar_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return timeseries.calendar_report(e, ["event_type"], "ts")


@query("""with y as (select year(l_shipdate) as year, count(*) as rows, count(distinct date_trunc('hour', l_shipdate)) as hours from lineitem group by all)
    select year, rows, hours, dayofyear(make_date(year, 12, 31)) * 24 as expected, rows = dayofyear(make_date(year, 12, 31)) * 24 and hours = dayofyear(make_date(year, 12, 31)) * 24 as complete from y""")
def complete_years(spark, sf_dir):
    return timeseries.complete_years(table(spark, sf_dir, "lineitem"), [], "l_shipdate")


@query("""with h as (select distinct event_type, date_trunc('hour', ts) as hr from events), l as (select event_type, hr, lag(hr) over (partition by event_type order by hr) as before from h)
    select event_type, strftime(hr, '%Y-%m-%d %H') as hour, strftime(before, '%Y-%m-%d %H') as previous, date_diff('second', before, hr) as step from l where date_diff('second', before, hr) <> 3600""")
def gap_lag(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).distinct()
    return timeseries.gaps(e, ["event_type"], "ts").select("event_type", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.date_format("previous", "yyyy-MM-dd HH").alias("previous"), "step")


_MORPH = f"""s(scenario, d, a) as (values {_values(SCENARIOS)}),
    f as (select scenario, b as bucket, d * (b + 1) as delta, a + b / 100.0 as alpha from s cross join (values (0), (1), (2)) as t(b)),
    e as (select event_id, event_type, ts, cast((day(ts) - 1) // 10 % 3 as bigint) as bucket, value as t, value / 2 as beam, value / 4 as diffuse from events),
    m as (select scenario, event_id, event_type, ts, bucket, delta, alpha, t + delta as t, beam * alpha as beam, diffuse * alpha as diffuse, t as t0, beam as beam0, diffuse as diffuse0 from e join f using (bucket))"""


def _factor_rows(spark: SparkSession) -> DataFrame:
    rows = [(s, b, d * (b + 1), a + b / 100.0) for s, d, a in SCENARIOS for b in range(3)]
    return spark.createDataFrame(rows, "scenario string, bucket long, delta double, alpha double")


def _series(spark, sf_dir) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", "event_type", "ts", (F.floor((F.day("ts") - 1) / 10) % 3).cast("long").alias("bucket"), v.alias("t"), (v / 2).alias("beam"), (v / 4).alias("diffuse"))


def _morphed(spark, sf_dir) -> DataFrame:
    return timeseries.morph(_series(spark, sf_dir), _factor_rows(spark), ["bucket"], ["t"], ["beam", "diffuse"], {"total": ["beam", "diffuse"]})


@query(f"with {_MORPH} select scenario, event_id, bucket, R(t) as t, R(beam) as beam, R(diffuse) as diffuse, R(beam + diffuse) as total from m", 9)
def morph_series(spark, sf_dir):
    return _morphed(spark, sf_dir).select("scenario", "event_id", "bucket", "t", "beam", "diffuse", "total")


@query(f"""with {_MORPH}, x as (select *, t + case when scenario = 'low' and bucket = 1 then 0.001 else 0 end as t1, case when scenario = 'high' and event_id % 100 = 7 then 'other' else event_type end as type1 from m),
    g as (select scenario, bucket as month, count(*) as rows, avg(t1 - t0) as mean_shift, max(delta) as delta, max(alpha) as alpha, sum(beam) / nullif(sum(beam0), 0) as beam_ratio, sum(diffuse) / nullif(sum(diffuse0), 0) as diffuse_ratio,
        count(*) filter (type1 <> event_type) as changed from x group by scenario, bucket)
    select scenario, month, rows, R(mean_shift) as mean_shift, R(delta) as delta, R(alpha) as alpha, R(beam_ratio) as beam_ratio, R(diffuse_ratio) as diffuse_ratio, changed,
        abs(mean_shift - delta) <= 1e-8 and changed = 0 and coalesce(abs(beam_ratio - alpha) <= 1e-8, true) and coalesce(abs(diffuse_ratio - alpha) <= 1e-8, true) as ok from g""", 9)
def pair_invariants(spark, sf_dir):
    """A member with a wrong shift in one scenario and changed labels in another: both must be found."""
    m = _morphed(spark, sf_dir)
    shifted = F.when((F.col("scenario") == "low") & (F.col("bucket") == 1), F.col("t") + 0.001).otherwise(F.col("t"))
    other = F.when((F.col("scenario") == "high") & (F.col("event_id") % 100 == 7), "other").otherwise(F.col("event_type"))
    return timeseries.pair_invariants(m.withColumns({"t": shifted, "event_type": other}), _series(spark, sf_dir), ["event_id"], ["scenario"], F.col("bucket"), "t", ["beam", "diffuse"], ["event_type", "ts"])


@query(f"""with {_MORPH} select scenario, event_type, count(*) as row_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as "end",
    R(min(t)) as t_min, R(max(t)) as t_max, R(avg(t)) as t_mean, R(min(beam + diffuse)) as total_min, R(max(beam + diffuse)) as total_max, R(avg(beam + diffuse)) as total_mean from m group by all""", 9)
def member_manifest(spark, sf_dir):
    out = timeseries.manifest(_morphed(spark, sf_dir), ["scenario", "event_type"], "ts", ["t", "total"])
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")})


@query("select l_orderkey, l_linenumber, l_partkey, R((l_quantity + l_discount + l_tax) * 1.05) as south, R((l_quantity + l_discount) * 1.05) as north from lineitem", 9)
def facade_sum(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = timeseries.facade_totals(li, F.lit(1.05), {"south": ["l_quantity", "l_discount", "l_tax"], "north": ["l_quantity", "l_discount"]})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "south", "north")


@query("select c_custkey, R(greatest(c_acctbal, 0)) as c_acctbal from customer", 9)
def clamp_negative(spark, sf_dir):
    return timeseries.clamp_negative(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query("""select 'c_acctbal' as column_name, count(*) as n_negative, R(min(c_acctbal)) as least from customer where c_acctbal < 0 having count(*) > 0
    union all select 's_acctbal', count(*), R(min(s_acctbal)) from supplier where s_acctbal < 0 having count(*) > 0""")
def clamp_warnings(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return timeseries.negative_warnings(c, ["c_acctbal"]).unionByName(timeseries.negative_warnings(s, ["s_acctbal"]))


@query("""with q as (select event_type, quantile_cont(value, [1 - i / 10.0 for i in range(11)]) as c from events group by all)
    select event_type, cast(i as bigint) as pos, R(c[i + 1]) as value from q, (select unnest(range(11)) as i)""")
def duration_curve(spark, sf_dir):
    return timeseries.duration_curves(table(spark, sf_dir, "events"), ["event_type"], "value", 11)


@query("""with q as (select event_type, user_id % 7 as member, quantile_cont(value, [1 - i / 10.0 for i in range(11)]) as c from events group by all),
    v as (select event_type, cast(i as bigint) as pos, c[i + 1] as value from q, (select unnest(range(11)) as i))
    select event_type, pos, R(quantile_cont(value, 0.5)) as median, R(quantile_cont(value, 0.05)) as low, R(quantile_cont(value, 0.95)) as high from v group by all""")
def duration_bands(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("member", F.col("user_id") % 7)
    return timeseries.curve_bands(timeseries.duration_curves(e, ["event_type", "member"], "value", 11), ["event_type"])


_PIVOT = ", ".join(f"R(max(case when month = {m} then q end)) as m{m}" for m in range(1, 13))


@query(f"with c as (select l_returnflag, year(l_shipdate) as year, month(l_shipdate) as month, avg(l_quantity) as q from lineitem group by all) select l_returnflag, year, {_PIVOT} from c group by all")
def pivot_months(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return timeseries.month_matrix(timeseries.climatology(li, ["l_returnflag"], "l_shipdate", {"q": "l_quantity"}, True), ["l_returnflag", "year"], "month", "q")


@query("with c as (select year(l_shipdate) as year, month(l_shipdate) as month, avg(l_quantity) as q from lineitem group by all) select R(greatest(max(abs(q)), 1e-8)) as scale from c")
def heat_scale(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    matrix = timeseries.month_matrix(timeseries.climatology(li, [], "l_shipdate", {"q": "l_quantity"}, True), ["year"], "month", "q")
    return timeseries.heat_scale(matrix, [f"m{m}" for m in range(1, 13)])


# Invariants ------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, count(*) as rows from lineitem group by all having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return checks.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""select 'range o_totalprice' as "check", count(*) filter (not coalesce(o_totalprice between 1000 and 300000, false)) as violations from orders
    union all select 'range c_acctbal', count(*) filter (not coalesce(c_acctbal between 0 and 5000, false)) from customer""")
def range_violations(spark, sf_dir):
    a = checks.in_range(table(spark, sf_dir, "orders"), {"o_totalprice": (1000.0, 300000.0)})
    return checks.union_checks(a, checks.in_range(table(spark, sf_dir, "customer"), {"c_acctbal": (0.0, 5000.0)}))


@query("""select 'no discount without tax' as "check", count(*) filter (l_discount = 0 and not l_tax = 0) as violations from lineitem""")
def night_zero_rule(spark, sf_dir):
    return checks.implies(table(spark, sf_dir, "lineitem"), "no discount without tax", F.col("l_discount") == 0, F.col("l_tax") == 0)


@query("""with s as (select r_name, r_regionkey, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all),
    l as (select count(*) as n, count(*) filter (l_quantity is null) as nulls, count(*) filter (not (l_discount between 0 and 1)) as bad from lineitem)
    select 'unique l_orderkey, l_linenumber' as "check", (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)) as violations
    union all select 'unique o_orderkey', (select count(*) from (select 1 from orders group by o_orderkey having count(*) > 1))
    union all select 'not null l_quantity', nulls from l
    union all select 'range l_discount', bad from l
    union all select 'not blank c_name', (select count(*) filter (coalesce(trim(c_name), '') = '') from customer)
    union all select 'rows = 25', (select abs(count(*) - 25) from nation)
    union all select 'constant r_regionkey', (select greatest(count(distinct r_regionkey) - 1, 0) from region)
    union all select 'whole prices', (select count(*) filter (not coalesce(abs(l_extendedprice - round(l_extendedprice / l_quantity, 0) * l_quantity) <= 20, false)) from lineitem)
    union all select 'customers', (select case when sum(n) = (select count(*) from customer) then 0 else 1 end from s)""")
def quality_report(spark, sf_dir):
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    counts = joined.agg(F.count("*").alias("a")).crossJoin(c.agg(F.count("*").alias("b")))
    return checks.union_checks(
        checks.unique_key(li, ["l_orderkey", "l_linenumber"]), checks.unique_key(o, ["o_orderkey"]), checks.not_null(li, ["l_quantity"]), checks.in_range(li, {"l_discount": (0.0, 1.0)}),
        checks.not_blank(c, ["c_name"]), checks.row_count(n, 25), checks.constant(r, "r_regionkey"), checks.identity(li, "whole prices", F.col("l_extendedprice"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 0) * F.col("l_quantity"), 20.0),
        checks.audit(counts, {"customers": F.col("a") == F.col("b")}),
    )


@query("""select l_orderkey as key, 'left' as side from lineitem where l_orderkey not in (select o_orderkey from orders) group by all
    union all select o_orderkey, 'right' from orders where o_orderkey not in (select l_orderkey from lineitem) group by all""")
def key_set_diff(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return checks.key_difference(li, o, ["key"])


@query("""select c_custkey, 'bal' as field, cast(1 as bigint) as n from customer join supplier on c_custkey = s_suppkey where not abs(c_acctbal - s_acctbal) <= 100""")
def field_agreement(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("bal"))
    return checks.agreement(c, s, ["c_custkey"], ["bal"], 100.0).select("c_custkey", "field", F.lit(1).cast("long").alias("n"))


@query("""with g as (select s_nationkey, list_sort(list(distinct least(3, s_suppkey % 5))) as values from supplier group by all)
    select s_nationkey, cast(len(values) as bigint) as n from g where values <> [0, 1, 2, 3]""")
def domain_coverage(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.least(F.lit(3), F.col("s_suppkey") % 5).cast("int").alias("v")).distinct()
    return checks.covers(s, ["s_nationkey"], "v", [0, 1, 2, 3]).select("s_nationkey", F.size("values").alias("n"))


@query("""select o_orderkey, cast(count(*) as bigint) as n from (select distinct l_orderkey as o_orderkey, l_linestatus as state from lineitem) group by all having list_sort(list(state)) <> ['F', 'O']""")
def paired_states(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("state")).distinct()
    return checks.states(s, ["o_orderkey"], "state", ["F", "O"]).select("o_orderkey", F.size("values").alias("n"))


@query("""select 'nations' as "check", cast(count(*) <> 25 as bigint) as violations from nation union all select 'keys', cast(sum(n_nationkey) <> 300 as bigint) from nation union all select 'wrong', cast(sum(n_nationkey) <> 299 as bigint) from nation""")
def headline_totals(spark, sf_dir):
    return checks.headline(table(spark, sf_dir, "nation"), {"nations": (F.count("*"), 25.0), "keys": (F.sum("n_nationkey"), 300.0), "wrong": (F.sum("n_nationkey"), 299.0)})


@query("""select s_nationkey, case when count(*) = 1 then max(s_suppkey) end as s_suppkey, count(*) as rows from supplier group by all""")
def exactly_one(spark, sf_dir):
    return stats.exactly_one(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey")


@query("""with b as (select l_returnflag, avg(l_quantity) as quantity, avg(l_discount) as discount from lineitem group by all)
    select l_returnflag, 'quantity_band' as code, 'quantity' as metric, R(quantity) as value, 25.4::double as low, 25.6::double as high from b where not quantity between 25.4 and 25.6
    union all select l_returnflag, 'discount_band', 'discount', R(discount), 0.04::double, 0.0499::double from b where not discount between 0.04 and 0.0499""")
def plausibility_bands(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return checks.outside_bands(b, ["l_returnflag"], [("quantity_band", "quantity", 25.4, 25.6), ("discount_band", "discount", 0.04, 0.0499)])


# Shares and flows ------------------------------------------------------------------------------

_STOCK = "select r_name as region, c_mktsegment as segment, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all"


def _stock(spark, sf_dir) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    by_nation = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    joined = by_nation.join(n, by_nation.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy(F.col("r_name").alias("region"), "segment").agg(F.sum("n").alias("n"))


@query(f"with s as ({_STOCK}) select region, segment, n, R(n / sum(n) over (partition by region)) as share from s", 9)
def share_within_group(spark, sf_dir):
    return alloc.share_within(_stock(spark, sf_dir), ["region"], "n")


@query(f"with s as ({_STOCK}) select segment, cast(sum(n) as bigint) as n, R(sum(n) / (select sum(n) from s)) as share from s group by all", 9)
def share_of_total(spark, sf_dir):
    return alloc.share_within(_stock(spark, sf_dir).groupBy("segment").agg(F.sum("n").alias("n")), [], "n")


@query(f"""with s as ({_STOCK}), t as (select sum(n) as t from s), a as (select region, sum(n) / max(t) as sa from s, t group by all), b as (select segment, sum(n) / max(t) as sb from s, t group by all)
    select region, segment, R(sa * sb) as share, R(sa * sb * (select t from t)) as dwellings from a cross join b""", 9)
def type_period_outer_product(spark, sf_dir):
    s = _stock(spark, sf_dir)
    a = alloc.share_within(s.groupBy("region").agg(F.sum("n").alias("n")), [], "n", "sa").select("region", "sa")
    b = alloc.share_within(s.groupBy("segment").agg(F.sum("n").alias("n")), [], "n", "sb").select("segment", "sb")
    total = s.agg(F.sum("n").alias("total"))
    return alloc.outer_product(a, b, "sa", "sb").crossJoin(total).select("region", "segment", "share", (F.col("share") * F.col("total")).alias("dwellings"))


@query(f"""with w(o_orderpriority, class, weight) as (values {_values(BRIDGE)}), n as (select o_orderpriority, count(*) as n from orders group by all)
    select class, R(sum(n * weight)) as n from n join w using (o_orderpriority) group by all""", 9)
def bridge_split(spark, sf_dir):
    w = spark.createDataFrame(list(BRIDGE), "o_orderpriority string, class string, weight double")
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").cast("double").alias("n"))
    return alloc.bridge(n, w, "o_orderpriority", "class", "n")


@query("""select l_returnflag, measure, count(*) as n, R(sum(value)) as total from (
    select l_returnflag, 'quantity' as measure, l_quantity as value from lineitem union all select l_returnflag, 'discount', l_discount from lineitem union all select l_returnflag, 'tax', l_tax from lineitem) group by all""", 4)
def unpivot_measures(spark, sf_dir):
    labels = {"l_quantity": "quantity", "l_discount": "discount", "l_tax": "tax"}
    long = alloc.unpivoted(table(spark, sf_dir, "lineitem"), ["l_returnflag"], list(labels), "measure", "value", labels)
    return long.groupBy("l_returnflag", "measure").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


_SPLIT = ", ".join(f"cast(sum(case when segment = '{s}' then n else 0 end) as bigint) as n_{i}" for i, s in enumerate(SEGMENTS[:4]))
_SPLIT_SHARES = ", ".join(f"R(n_{i} / nullif(modelled, 0)) as share_{i}" for i in range(4))


@query(f"""with s as ({_STOCK}), w as (select region, {_SPLIT}, cast(sum(n) as bigint) as n_total from s group by all), m as (select *, n_0 + n_1 + n_2 + n_3 as modelled from w)
    select region, n_0, n_1, n_2, n_3, n_total, modelled, n_total - modelled as residual, {_SPLIT_SHARES} from m""", 9)
def regional_split(spark, sf_dir):
    return alloc.regional_split(_stock(spark, sf_dir), "region", "segment", SEGMENTS[:4], F.col("n"))


@query(f"with s as ({_STOCK}) select region, cast(sum(n) as bigint) as n from s group by all union all select 'Total', count(*) from customer")
def stock_composition_totals(spark, sf_dir):
    parts = _stock(spark, sf_dir).groupBy("region").agg(F.sum("n").alias("n"))
    return alloc.with_total(parts, "region", table(spark, sf_dir, "customer").agg(F.count("*").alias("n")))


_PRIORITY = ", ".join(f"('{s}', {p})" for s, p in PRIORITIES.items())
_ALLOC = f"""p(segment, priority) as (values {_PRIORITY}), s as ({_STOCK}),
    w as (select *, n / sum(n) over (partition by region) as share, sum(n) over (partition by region) as region_total from s join p using (segment)),
    a as (select *, share * priority / sum(share * priority) over (partition by region) as allocation from w)"""


def _allocated(spark, sf_dir) -> DataFrame:
    p = spark.createDataFrame(list(PRIORITIES.items()), "segment string, priority int")
    stock = alloc.share_within_small(_stock(spark, sf_dir), ["region"], "n").join(p, "segment")
    return alloc.allocation(stock.withColumns({f"rate_{s}": F.lit(r) for s, r in RATES.items()}), "region", "share", "priority", {s: f"rate_{s}" for s in RATES}, "n")


@query(f"with {_ALLOC} select region, segment, n, R(allocation) as allocation, " + ", ".join(f"R({r} * region_total * allocation) as flow_{s}" for s, r in RATES.items()) + " from a", 9)
def allocation_flow(spark, sf_dir):
    return _allocated(spark, sf_dir).select("region", "segment", "n", "allocation", *(f"flow_{s}" for s in RATES))


_STATES = f"""{_ALLOC}, r(scenario, rate) as (values {_values(RATES.items())}), q as (select region, segment, n, scenario, rate, rate * {YEARS} * region_total * allocation as wanted from a cross join r),
    c as (select *, least(wanted, n) as moved, wanted > n + 1e-10 as capped from q),
    st as (select region, segment, scenario, rate, 'as_is' as state, n - moved as dwellings, n, capped from c union all select region, segment, scenario, rate, 'renovated', moved, n, capped from c)"""


def _states(spark, sf_dir) -> DataFrame:
    return alloc.capped_states(_allocated(spark, sf_dir), ["region", "segment"], "n", {s: f"rate_{s}" for s in RATES}, YEARS)


@query(f"with {_STATES} select region, segment, scenario, R(rate) as rate, state, R(dwellings) as dwellings, n, capped from st", 9)
def capped_flow_states(spark, sf_dir):
    return _states(spark, sf_dir)


@query(f"""with {_STATES}, x as (select region, scenario, sum(dwellings) as renovated, cast(sum(n) as bigint) as stock, count(*) filter (capped) as caps from st where state = 'renovated' group by all)
    select region, scenario, R(renovated) as renovated, stock, caps, R(renovated / stock) as fraction, case scenario when 'low' then 'below_policy_compatible_trajectory' when 'central' then 'policy_compatible_scenario'
    else case when caps > 0 then 'accelerated_scenario_with_archetype_caps' else 'accelerated_scenario' end end as status from x""", 9)
def crosscheck_status(spark, sf_dir):
    return alloc.crosscheck(_states(spark, sf_dir), "region", "n")


_HEAT = f"""h(variant, share) as (values {_values(HEATING)}), heat as (
    select region, segment, scenario, state, dwellings, variant, share, dwellings * share as variant_dwellings from st cross join h where state = 'as_is'
    union all select region, segment, scenario, state, dwellings, 'heat_pump', 1.0, dwellings from st where state <> 'as_is')"""


def _heating(spark, sf_dir) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"))
    shares = regions.crossJoin(spark.createDataFrame(list(HEATING), "variant string, share double"))
    return fanout.heating(_states(spark, sf_dir), shares, "region", ("heat_pump", "low_energy"))


@query(f"with {_STATES}, {_HEAT} select region, segment, scenario, state, variant, R(share) as share, R(variant_dwellings) as variant_dwellings from heat", 9)
def heating_fanout(spark, sf_dir):
    return _heating(spark, sf_dir).select("region", "segment", "scenario", "state", "variant", "share", "variant_dwellings")


_COOL = f"""k(cooling_case, active_share) as (values {_values(COOLING)}), cool as (select region, segment, scenario, state, dwellings, cooling_case, active,
    case when active then active_share else 1 - active_share end as share, dwellings * case when active then active_share else 1 - active_share end as variant_dwellings from st cross join k cross join (values (false), (true)) as t(active))"""


def _cooling(spark, sf_dir) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"))
    return fanout.cooling(_states(spark, sf_dir), regions.crossJoin(spark.createDataFrame(list(COOLING), "cooling_case string, active_share double")), "region")


@query(f"with {_STATES}, {_COOL} select region, segment, scenario, state, cooling_case, active, R(share) as share, R(variant_dwellings) as variant_dwellings from cool", 9)
def cooling_fanout(spark, sf_dir):
    return _cooling(spark, sf_dir).select("region", "segment", "scenario", "state", "cooling_case", "active", "share", "variant_dwellings")


@query(f"""with {_STATES}, {_HEAT}, {_COOL}, v as (select 'heating' as layer, sum(variant_dwellings) as variants, max(dwellings) as state_total, sum(share) as shares from heat group by region, segment, scenario, state
    union all select 'cooling', sum(variant_dwellings), max(dwellings), sum(share) from cool group by region, segment, scenario, state, cooling_case)
    select layer, count(*) as states, count(*) filter (abs(variants - state_total) > 1e-5 or abs(shares - 1) > 1e-10) as broken, R(sum(variants)) as total from v group by all""", 3)
def variant_reconstruction(spark, sf_dir):
    keys = ["region", "segment", "scenario", "state"]
    out = []
    for layer, df, by in (("heating", _heating(spark, sf_dir), keys), ("cooling", _cooling(spark, sf_dir), [*keys, "cooling_case"])):
        per = df.groupBy(*by).agg(F.sum("variant_dwellings").alias("v")).agg(F.count("*").alias("states"), F.sum("v").alias("total"))
        broken = fanout.unreconstructed(df, by).agg(F.count("*").alias("broken"))
        out.append(per.crossJoin(broken).select(F.lit(layer).alias("layer"), "states", "broken", "total"))
    return fanout.states_of(out)


_PV = """r as (select n_name as region, n_nationkey, cast(count(*) as double) as small_n from nation join supplier on s_nationkey = n_nationkey group by all),
    i as (select region, small_n, small_n * (3.5 + n_nationkey / 10.0) / 1000 as small_mw, small_n * 0.008 as total_mw, 0.01 * small_n as target_gwh, 900.0 + n_nationkey as yield_kwh,
        small_n * (0.006 + 0.0005 * n_nationkey) as rooftop_mw, small_n * 2 as houses, small_n * 1.5 as apartments, small_n / 4 as apartment_buildings, 0.25 as ratio from r),
    p1 as (select *, small_mw * 1000 / small_n as mean_kwp, apartments / apartment_buildings as apb, least(1.0, small_n / houses) as house_rate_base, target_gwh * 1000 / yield_kwh as target_mw from i),
    p2 as (select *, greatest(small_mw, small_mw + small_mw / total_mw * (target_mw - total_mw)) as small_target_mw, mean_kwp / apb as apartment_kwp from p1),
    p3 as (select *, small_mw + 26.0 / 6 * (small_target_mw - small_mw) as linear_mw, mean_kwp * houses + ratio * apartment_kwp * apartments as per_rate from p2),
    p4 as (select *, per_rate / 1000 as eligible_mw, least(linear_mw, rooftop_mw, per_rate / 1000) as projected_mw from p3),
    pv as (select *, projected_mw * 1000 / per_rate as house_rate_end, ratio * projected_mw * 1000 / per_rate as apartment_rate_end,
        concat_ws('+', case when abs(linear_mw - projected_mw) <= 1e-6 then 'linear_trajectory' end, case when abs(rooftop_mw - projected_mw) <= 1e-6 then 'official_rooftop_potential' end,
            case when abs(eligible_mw - projected_mw) <= 1e-6 then 'eligible_stock' end) as cap_reason from p4)"""


def _projection(spark, sf_dir) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    r = s.groupBy("s_nationkey").agg(F.count("*").cast("double").alias("small_n")).join(n, F.col("s_nationkey") == n.n_nationkey)
    k, c = F.col("n_nationkey"), F.col("small_n")
    given = r.select(
        F.col("n_name").alias("region"), "small_n", (c * (3.5 + k / 10.0) / 1000).alias("small_mw"), (c * 0.008).alias("total_mw"), (0.01 * c).alias("target_gwh"), (900.0 + k).alias("yield_kwh"),
        (c * (0.006 + 0.0005 * k)).alias("rooftop_mw"), (c * 2).alias("houses"), (c * 1.5).alias("apartments"), (c / 4).alias("apartment_buildings"), F.lit(0.25).alias("ratio"),
    )
    return fanout.pv_projection(given)


@query(f"with {_PV} select region, R(mean_kwp) as mean_kwp, R(house_rate_base) as house_rate_base, R(small_target_mw) as small_target_mw, R(linear_mw) as linear_mw, R(eligible_mw) as eligible_mw, R(projected_mw) as projected_mw, cap_reason, R(house_rate_end) as house_rate_end, R(apartment_rate_end) as apartment_rate_end from pv", 8)
def pv_projection(spark, sf_dir):
    return _projection(spark, sf_dir).select("region", "mean_kwp", "house_rate_base", "small_target_mw", "linear_mw", "eligible_mw", "projected_mw", "cap_reason", "house_rate_end", "apartment_rate_end")


_ASSIGN = """g as (select region, 2024 as basis_year, 'house' as dwelling_group, house_rate_base as rate, mean_kwp as kwp, small_mw as basis_mw, 'observed_2024_small_system_stock' as cap_reason from pv
    union all select region, 2024, 'apartment', 0, 0, small_mw, 'observed_2024_small_system_stock' from pv
    union all select region, 2050, 'house', house_rate_end, case when house_rate_end = 0 then 0 else mean_kwp end, projected_mw, cap_reason from pv
    union all select region, 2050, 'apartment', apartment_rate_end, case when apartment_rate_end = 0 then 0 else apartment_kwp end, projected_mw, cap_reason from pv)"""


@query(f"with {_PV}, {_ASSIGN} select region, cast(basis_year as bigint) as basis_year, dwelling_group, R(rate) as participation_rate, R(kwp) as capacity_kwp, R(basis_mw) as basis_mw, cap_reason from g", 8)
def pv_assignments(spark, sf_dir):
    return fanout.pv_assignments(_projection(spark, sf_dir), "region")


@query(f"""with {_PV}, {_ASSIGN}, c as (select n_name as region, case when c_mktsegment in ('AUTOMOBILE', 'BUILDING') then 'house' else 'apartment' end as dwelling_group, cast(count(*) as double) as n
        from customer join nation on c_nationkey = n_nationkey group by all),
    s as (select region, dwelling_group, 'as_is' as state, 2024 as basis_year, n * 0.4 as dwellings from c union all select region, dwelling_group, 'renovated', 2050, n * 0.6 from c),
    v as (select s.*, i, case when i then rate else 1 - rate end as share, kwp from s join g using (region, basis_year, dwelling_group) cross join (values (false), (true)) as t(i))
    select region, dwelling_group, state, cast(basis_year as bigint) as basis_year, case when i then 'installed' else 'no_pv' end as pv_status, R(share) as share, R(dwellings * share) as variant_dwellings,
    R(case when i then dwellings * share * kwp / 1000 else 0 end) as capacity_mw from v""", 9)
def pv_rows(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    group = F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "house").otherwise("apartment")
    counted = c.groupBy("c_nationkey", group.alias("dwelling_group")).agg(F.count("*").cast("double").alias("n")).join(n, F.col("c_nationkey") == n.n_nationkey).withColumnRenamed("n_name", "region")
    two = F.explode(F.array(F.struct(F.lit("as_is").alias("state"), (F.col("n") * 0.4).alias("dwellings")), F.struct(F.lit("renovated").alias("state"), (F.col("n") * 0.6).alias("dwellings"))))
    states = counted.select("region", "dwelling_group", two.alias("t")).select("region", "dwelling_group", "t.*")
    out = fanout.pv_rows(states, fanout.pv_assignments(_projection(spark, sf_dir), "region"), "region")
    return out.select("region", "dwelling_group", "state", "basis_year", "pv_status", "share", "variant_dwellings", "capacity_mw")


# Comparisons and picks -------------------------------------------------------------------------

_NATIONS = """c as (select c_nationkey as k, avg(c_acctbal) as a from customer group by all), s as (select s_nationkey as k, avg(s_acctbal) as b from supplier group by all), j as (select k, a, b from c join s using (k))"""


@query(f"with {_NATIONS} select count(*) as n, R(corr(a, b)) as correlation, R(avg(a - b)) as bias, R(avg(abs(a - b))) as mae from j")
def reference_comparison(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("a"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("b"))
    return stats.error_statistics(a.join(b, "k"), "a", "b")


@query("""with m as (select l_returnflag, month(l_shipdate) as month, l_linestatus as s, avg(l_quantity) as q from lineitem group by all)
    select l_returnflag, count(*) as n, R(avg(o.q - f.q)) as paired, R(avg(o.q) - avg(f.q)) as unpaired from (select * from m where s = 'O') o join (select * from m where s = 'F') f using (l_returnflag, month) group by all""")
def paired_change(spark, sf_dir):
    o = _climate(spark, sf_dir, "O").select("l_returnflag", "month", F.col("quantity").alias("o"))
    f = _climate(spark, sf_dir, "F").select("l_returnflag", "month", F.col("quantity").alias("f"))
    return stats.paired_change(o.join(f, ["l_returnflag", "month"]), ["l_returnflag"], "o", "f")


@query("select l_returnflag, R(sum(l_discount * l_extendedprice) / sum(l_extendedprice)) as weighted_mean from lineitem group by all")
def weighted_mean(spark, sf_dir):
    return stats.weighted_mean(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_extendedprice")


@query("""select c_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from (select o_custkey as c_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders) where k = 1""")
def distinct_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return stats.first_rows(o, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""with k as (select l_returnflag, year(l_shipdate) as year, count(*) as n from lineitem group by all)
    select l_returnflag, year, n, dense_rank() over (order by case l_returnflag when 'R' then 1 when 'A' then 2 when 'N' then 3 end, year) - 1 as ordinal from k""")
def row_ordinals(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))
    return stats.ordinals(k, "l_returnflag", ["R", "A", "N"], "year")


@query("""select c_custkey, case when length(c) < 5 then lpad(c, 5, '0') else c end as code, upper(trim(' ' || c_mktsegment || ' ')) as segment from (select c_custkey, cast(c_custkey as varchar) as c, c_mktsegment from customer)""")
def code_cleaning(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", fn.clean_code(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".0 "))).alias("code"), F.upper(F.trim(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))).alias("segment"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_prop(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""select n_regionkey, cast(count(*) as bigint) as n, string_agg(n_name, ';' order by n_name) as names from nation group by all""")
def collected_groups(spark, sf_dir):
    got = stats.collected(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_name"], ["n_name"])
    return got.select("n_regionkey", F.size("records").alias("n"), F.array_join(F.transform("records", lambda r: r["n_name"]), ";").alias("names"))


@query("""select n_regionkey, cast(sum(case when n_name < 'J' then n_nationkey end) as bigint) as early, cast(sum(case when n_name >= 'J' then n_nationkey end) as bigint) as late from nation group by all""")
def sums_by_predicate(spark, sf_dir):
    early = F.col("n_name") < "J"
    return stats.sum_where(table(spark, sf_dir, "nation"), ["n_regionkey"], {"early": (early, F.col("n_nationkey")), "late": (~early, F.col("n_nationkey"))})


# Stock plans on the star schema --------------------------------------------------------------------

_PRIORITY_PERIODS = (("1-URGENT", "Before 1919"), ("2-HIGH", "1946-1970"), ("3-MEDIUM", "1971-1990"), ("4-NOT SPECIFIED", "2001-2010"), ("5-LOW", "2011 onwards"))
_SEGMENT_CODES = (("AUTOMOBILE", "R1"), ("BUILDING", "R2"), ("FURNITURE", "R3"), ("HOUSEHOLD", "R4"), ("MACHINERY", "other"))
_MARGINS = f"""tc(segment, code) as (values {_values(_SEGMENT_CODES)}), tb(code, dwelling_type, weight) as (values {_values(stock.TYPE_BRIDGE)}),
    pc(priority, source_period) as (values {_values(_PRIORITY_PERIODS)}), pb(source_period, construction_period, weight) as (values {_values(stock.PERIOD_BRIDGE)}),
    where_(custkey, region) as (select c_custkey, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
    t1 as (select region, dwelling_type, sum(weight) as n from customer join where_ on c_custkey = custkey join tc on segment = c_mktsegment join tb using (code) group by all),
    types as (select region, dwelling_type, n / sum(n) over (partition by region) as type_share from t1),
    p1 as (select region, construction_period, sum(weight) as n from orders join where_ on o_custkey = custkey join pc on priority = o_orderpriority join pb using (source_period) group by all),
    periods as (select region, construction_period, n / sum(n) over (partition by region) as period_share from p1)"""


def _marginals(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    placed = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("region"), "c_custkey", "c_mktsegment")
    split = placed.groupBy("region", fn.lookup(F.col("c_mktsegment"), dict(_SEGMENT_CODES)).alias("code")).agg(F.count("*").cast("double").alias("dwellings"))
    orders = table(spark, sf_dir, "orders").join(placed, F.col("o_custkey") == F.col("c_custkey"))
    counts = orders.groupBy("region", fn.lookup(F.col("o_orderpriority"), dict(_PRIORITY_PERIODS)).alias("source_period")).agg(F.count("*").cast("double").alias("dwellings"))
    return stock.type_shares(split), stock.period_shares(counts)


@query(f"with {_MARGINS} select region, dwelling_type, R(type_share) as type_share from types", 9)
def type_shares(spark, sf_dir):
    return _marginals(spark, sf_dir)[0]


@query(f"with {_MARGINS} select region, construction_period, R(period_share) as period_share from periods", 9)
def period_shares(spark, sf_dir):
    return _marginals(spark, sf_dir)[1]


def _archetypes(spark: SparkSession) -> DataFrame:
    """The archetype matrix of made-up class tables."""
    pairs = [(i + 1, t, p, 100.0 + i) for i, (p, t) in enumerate((p, t) for p in stock.PERIODS for t in stock.TYPES)]
    geometry = spark.createDataFrame(pairs, "tabula_type_number int, dwelling_type string, construction_period string, area double")
    walls = spark.createDataFrame([(p, 2.0 - 0.3 * i, 1.5 - 0.2 * i) for i, p in enumerate(stock.PERIODS)], "construction_period string, U_wall double, U_roof double")
    air = spark.createDataFrame([(p, *[10.0 - i + k / 10 for k in range(5)]) for i, p in enumerate(stock.PERIODS)], "construction_period string, " + ", ".join(f"{c} double" for c in stock.V50_COLUMNS))
    return stock.base_matrix(geometry, walls, air)


_BASE = f"""ty(k, dwelling_type) as (values {_values(tuple(enumerate(stock.TYPES)))}), pe(i, construction_period) as (values {_values(tuple(enumerate(stock.PERIODS)))}),
    base as (select 'BE_TABULA_' || lpad(cast(5 * i + k + 1 as varchar), 2, '0') as archetype_id, 5 * i + k + 1 as number, dwelling_type, construction_period, 100.0 + 5 * i + k as area, 10.0 - i + k / 10 as v50, 2.0 - 0.3 * i as u_wall, 1.5 - 0.2 * i as u_roof from ty, pe)"""


@query(f"with {_BASE} select archetype_id, cast(number as bigint) as number, dwelling_type, construction_period, R(area) as area, R(v50) as v50, R(u_wall) as u_wall, R(u_roof) as u_roof from base", 9)
def base_matrix(spark, sf_dir):
    return _archetypes(spark).select("archetype_id", F.col("TABULA_type_number").alias("number"), "dwelling_type", "construction_period", "area", F.col("v50_m3_h_m2").alias("v50"), F.col("U_wall").alias("u_wall"), F.col("U_roof").alias("u_roof"))


@query(f"""with {_MARGINS}, {_BASE}, modelled as (select region, cast(count(*) as double) as modelled from where_ group by all)
    select region, archetype_id, R(type_share * period_share) as share, R(modelled * type_share * period_share) as dwellings from base join types using (dwelling_type) join periods using (region, construction_period) join modelled using (region)""", 9)
def regional_matrix(spark, sf_dir):
    types, periods = _marginals(spark, sf_dir)
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    modelled = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("region")).agg(F.count("*").cast("double").alias("modelled"))
    return stock.stock_weighted(_archetypes(spark), types, periods, modelled, "region").select("region", "archetype_id", "share", "dwellings")


@query("""select area, period, R(dwellings) as dwellings, R(round_even(100 * dwellings / sum(dwellings) over (partition by area), 2)) as percent from (
    select r_name as area, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'old' else 'new' end as period, cast(count(*) as double) as dwellings
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all)""", 6)
def construction_period_table(spark, sf_dir):
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    bands = {"b1": "old", "b2": "old", "b3": "new", "b4": "new", "b5": "new"}
    placed = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    census = placed.groupBy(F.col("r_name").alias("area")).agg(*(F.count_if(F.col("o_orderpriority").startswith(str(i))).cast("double").alias(f"b{i}") for i in range(1, 6)))
    areas = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = stock.period_table(census, "area", bands, areas)
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("area"), F.col(f"`{a} dwellings`").alias("dwellings"), F.col(f"`{a} share (%)`").alias("percent")) for a in areas)))
    return wide.select("period", each.alias("r")).select("r.area", "period", "r.dwellings", "r.percent")


@query(f"""with {_STATES}, x as (select region, scenario, sum(dwellings) as renovated, cast(sum(n) as double) as modelled, count(*) filter (capped) as caps from st where state = 'renovated' group by all)
    select region, scenario, caps, case when caps > 0 then 'Moves ' || printf('%.1f%%', 100 * renovated / modelled) || ' of it. Archetype caps bind; so less. Done. End.' else 'Moves ' || printf('%.1f%%', 100 * renovated / modelled) || ' of it. Done. End.' end as note from x""")
def policy_notes(spark, sf_dir):
    x = _states(spark, sf_dir).where("state = 'renovated'").groupBy("region", "scenario").agg((F.sum("dwellings") / F.sum("n")).alias("renovated_fraction"), F.count_if("capped").alias("caps"))
    regions = [r["r_name"] for r in table(spark, sf_dir, "region").collect()]  # five rows
    notes = {(r, s): "Moves {percent} of it. Archetype caps bind; so less. Done." for r in regions for s in RATES}
    return stock.with_notes(x, notes, "End.").select("region", "scenario", "caps", "note")
