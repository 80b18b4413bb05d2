"""Readers, writers, checks and streaming."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarnwerk.functions import scalars as fn
from tarnwerk.operators import checks
from tarnwerk.sources import files, sinks
from tarnwerk.streaming import means


def test_quoted_csv(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('﻿a,b,c\r\n"x, ""y""","line\none",1\n,,\nshort,2\n')
    rows = [tuple(r) for r in files.quoted_csv(spark, str(p)).collect()]
    assert rows == [('x, "y"', "line\none", "1"), ("short", "2", "")]
    p.write_text("a,,c\n1,2,3\n")
    with pytest.raises(checks.CheckFailed, match="headers"):
        files.quoted_csv(spark, str(p))


@pytest.mark.parametrize("text", ['a,b\n1,x"y\n', 'a,b\n1,"x\n', 'a,b\n1,x""\n', 'a,b\n"1" ,2\n', 'a,b"\n1,2\n'])
def test_stray_quotes_fail(spark, tmp_path, text):
    p = tmp_path / "q.csv"
    p.write_text(text)
    with pytest.raises(Exception, match="stray|headers"):
        files.quoted_csv(spark, str(p)).collect()


def test_typed_csv_fails_fast(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b\n1,2.5\n")
    assert files.csv(spark, str(p), "a int, b double").first()["b"] == 2.5
    p.write_text("a,b\n1,x\n")
    with pytest.raises(Exception, match="(?i)malformed|bad|x"):
        files.csv(spark, str(p), "a int, b double").collect()


def test_preamble_csv(spark, tmp_path):
    p = tmp_path / "plane.csv"
    p.write_text("Latitude (decimal degrees):\t50.851\nSlope: 90 deg. (fixed)\n\ntime,Gb(i),T2m\n20050101:0010,0.0,1.5\n20050101:0110,oops,2\n\nT2m: 2-m air temperature\nfooter text\n")
    rows, meta = files.preamble_csv(spark, str(p), ["time", "Gb(i)", "T2m"])
    assert [tuple(r) for r in rows.collect()] == [("20050101:0010", 0.0, 1.5), ("20050101:0110", None, 2.0)]
    got = {r["key"]: r["number"] for r in meta.collect()}
    assert got["Latitude (decimal degrees)"] == 50.851 and got["Slope"] == 90.0


def test_hash_gate_and_copy(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "x" / "b.txt"
    a.write_text("hello")
    digest = files.sha256(str(a))
    assert files.hashes(spark, str(a)).first()["sha256"] == digest
    assert files.verified_copy(str(a), str(b), digest) and not files.verified_copy(str(a), str(b), digest)
    b.write_text("other")
    with pytest.raises(checks.CheckFailed, match="exists"):
        files.verified_copy(str(a), str(b), digest)
    assert files.verified_copy(str(a), str(b), digest, overwrite=True)
    with pytest.raises(checks.CheckFailed, match="sha256"):
        files.require_hash(str(a), "0" * 64)


def test_json_reader_and_nested_fields(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"source": {"year": 2005}, "monthly": [{"month": 1, "delta": 0.5}]}))
    df = files.json(spark, str(p), "source struct<year:int>, monthly array<struct<month:int,delta:double>>")
    assert df.select("source.year", F.col("monthly")[0]["delta"].alias("d")).first() == (2005, 0.5)


def test_publish_is_all_or_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    root = str(tmp_path / "out")
    sinks.publish({"one": df, "two": df}, root, {"one": [lambda t: checks.enforce(t, checks.unique_key(t, ["k"]))]})
    assert spark.read.parquet(f"{root}/two").count() == 2
    with pytest.raises(checks.CheckFailed, match="unique"):
        sinks.publish({"three": df.union(df)}, root, {"three": [lambda t: checks.enforce(t, checks.unique_key(t, ["k"]))]})
    with pytest.raises(checks.CheckFailed, match="inputs changed"):
        sinks.publish({"four": df}, root, unchanged=lambda: False)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one", "two"]


def test_a_failed_move_puts_the_old_tables_back(spark, tmp_path):
    old, new = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2,)], "k int")
    root = tmp_path / "out"
    sinks.publish({"one": old}, str(root))
    (root / "file").write_text("no folder")
    with pytest.raises(Exception):  # noqa: B017
        sinks.publish({"one": new, "file/two": new}, str(root))
    assert spark.read.parquet(str(root / "one")).first()["k"] == 1
    assert sorted(p.name for p in root.iterdir()) == ["file", "one"]
    sinks.publish({"one": new}, str(root))
    assert spark.read.parquet(str(root / "one")).first()["k"] == 2


def test_one_file_csv(spark, tmp_path):
    values = [0.0, -0.0, 1.0, -2.5, 1 / 3, 123456789012.0, 1234567890123.0, 1e-4, 0.00012345678901234, 1e-5, -6.02e23, 1e100, 99999999999.95, 0.1 + 0.2, 5e-324, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double").repartition(3)
    p = tmp_path / "x" / "t.csv"
    sinks.one_csv(df, str(p), ["k"], general=12)
    assert p.read_text() == "k,v\n" + "".join(f"{i},{'' if v is None else f'{v:.12g}'}\n" for i, v in enumerate(values))
    cells = spark.createDataFrame([(1, 1.0, 'a,"b"'), (2, -1e-14, "c\nd"), (3, 1 / 3, ""), (4, 1e15, None), (5, -2.50, "e")], "k int, v double, t string")
    sinks.one_csv(cells, str(p), ["k"], short=12)
    assert p.read_text() == 'k,v,t\n1,1,"a,""b"""\n2,0,"c\nd"\n3,0.333333333333,\n4,1000000000000000,\n5,-2.5,e\n'
    sinks.one_csv(df.where("k < 5"), str(p), ["k"], 6)
    assert p.read_text().splitlines()[5] == "4,0.333333" and [x.name for x in p.parent.iterdir() if not x.name.endswith(".crc")] == ["t.csv"]


def test_percent_text_rounds_the_binary_value(spark):
    values = [0.2285, 0.0005, 0.0015, 0.12345, 0.9995, 0.22250, 0.2225, 1.0, 0.0, -0.2285, *(i / 2000 for i in range(0, 2000, 7))]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(fn.percent_text(F.col("v")).alias("p"))
    assert [r["p"] for r in got.collect()] == [f"{100 * v:.1f}%" for v in values]


def test_sections_of_text(spark):
    r = spark.range(1).select(fn.section(F.lit("x Table 1: a b Table 2: c"), "Table 1:", "Table 2:").alias("a"), fn.section(F.lit("x Table 2: c "), "Table 2:", "Table 3:").alias("b"), fn.section(F.lit("x"), "y", "z").alias("c")).first()
    assert tuple(r) == ("a b", "c", None)


def test_csv_sink_is_deterministic(spark, tmp_path):
    df = spark.createDataFrame([(2, 1 / 3), (1, -0.0)], "k int, v double").repartition(3)
    for name in "ab":
        sinks.csv(df, str(tmp_path / name), ["k"])
    a, b = (next((tmp_path / n).glob("part-*")).read_bytes() for n in "ab")
    assert a == b and b"2,0.3333333333" in a
    assert sinks.short_decimals(spark.createDataFrame([(1e-14,)], "v double")).first()["v"] == 0.0


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1.5)], "k string, v double")
    none = df.limit(0)
    assert "no warnings" in sinks.report("t", {"x": df}, none) and "no warnings" not in sinks.report("t", {"x": df}, df)
    assert r"a\_b" in sinks.latex_table(df, "cap")
    sinks.json({"b": 1, "a": 2}, str(tmp_path / "m.json"))
    assert list(json.loads((tmp_path / "m.json").read_text())) == ["a", "b"]
    sinks.members(df, str(tmp_path / "members"), ["k"])
    assert spark.read.parquet(str(tmp_path / "members")).where("k = 'a_b'").count() == 1


def test_scalars(spark):
    df = spark.createDataFrame([(" 123.0 ", "1,5", "TRUE", "a: b: c", "-3.5 m"), ("1234567", "x", "no", "plain", "none")], "code string, dec string, flag string, text string, num string")
    a, b = df.select(fn.clean_code(F.col("code")), fn.decimal_comma(F.col("dec")), fn.flag(F.col("flag")), fn.after_first(F.col("text")), fn.first_number(F.col("num"))).collect()
    assert tuple(a) == ("00123", 1.5, True, "b: c", -3.5) and tuple(b) == ("1234567", None, None, None, None)
    one = spark.range(1)
    row = one.select(fn.clip(F.lit(None).cast("double"), 0, 1).alias("n"), fn.hours_in_year(F.lit(2020)).alias("h"), fn.percent_text(F.lit(0.2285)).alias("p"), fn.month_name(F.lit(2)).alias("m"), fn.reasons([(F.lit(True), "a"), (F.lit(False), "b"), (F.lit(True), "c")]).alias("r"), fn.finite(F.lit(float("nan"))).alias("f"), fn.csv_cell(F.lit('x,"y"')).alias("c")).first()
    assert row["n"] is None and row["h"] == 8784 and row["p"] == "22.9%" and row["m"] == "Feb" and row["r"] == "a+c" and row["f"] is False and row["c"] == '"x,""y"""'


def test_column_contracts(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(checks.CheckFailed, match="missing"):
        checks.require_columns(df, ["b"])
    with pytest.raises(checks.CheckFailed, match="obsolete"):
        checks.require_columns(df, forbidden=["a"])
    with pytest.raises(checks.CheckFailed, match="not"):
        checks.require_columns(df, exact=["b"])


def test_unchanged_and_headline(spark):
    a = spark.createDataFrame([(1, None, 2.0), (2, "x", 3.0)], "k int, v string, n double")
    assert checks.unchanged(a, a, ["k"], ["v", "n"]).where("violations > 0").count() == 0
    assert checks.unchanged(a.withColumn("n", F.col("n") + 1), a, ["k"], ["n"]).first()["violations"] == 2
    assert checks.headline(a, {"sum": (F.sum("n"), 5.0)}).first()["violations"] == 0


def test_documents_agree_or_say_where_not():
    found = {"version": 1, "method": {"tag": "m", "more": 2}, "monthly": [{"month": 1, "delta": 0.5}, {"month": 2, "delta": 0.25}], "leap": False}
    assert checks.require_agreement(found, {"version": 1, "method": {"tag": "m"}, "monthly": [{"month": 1, "delta": 0.5 + 1e-12}, {"month": 2}], "leap": False}, atol=1e-10) is found
    wrong = checks.disagreements(found, {"version": 2, "method": {"tag": "n", "none": None}, "monthly": [{"month": 1, "delta": 0.6}, {"month": 2}], "leap": 0, "absent": {"x": 1}})
    assert [w.split(":")[0] for w in wrong] == ["version", "method.tag", "monthly[0].delta", "leap", "absent.x"]
    with pytest.raises(checks.CheckFailed, match="side: version"):
        checks.require_agreement(found, {"version": 3}, "side")


def test_totals_pinned_to_inputs_and_fields(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "k int, n double"), spark.createDataFrame([(1, "x")], "k int, v string")
    totals = {"sum": (F.sum("n"), 3.0)}
    assert checks.pinned(a, totals, {"f": "1"}, {"f": "2"}) is None
    assert checks.pinned(a, totals, {"f": "1"}, {"f": "1"}).first()["violations"] == 1
    assert checks.fields_of(a, b) == ["k", "n", "v"]


def test_command_line(spark, tmp_path, capsys, caplog):
    from tarnwerk import cli

    rows = [(s, datetime(2000 + y, m, 5, 12), 10.0 + m + (2 if s != "historical" else 0), 100.0 * (1.1 if s != "historical" else 1)) for s in ("historical", "rcp") for y in (1, 2) for m in range(1, 13)]
    spark.createDataFrame(rows, "scenario string, timestamp timestamp, T_out_C double, I_solar_W_m2 double").write.parquet(str(tmp_path / "daily"))
    (tmp_path / "c.json").write_text(json.dumps({"source": str(tmp_path / "daily"), "output": "nowhere"}))
    assert cli.main(["deltas", "--config", str(tmp_path / "c.json"), "--set", f"output={tmp_path / 'out'}", "--set", "bounds=[0.7, 1.3]"], spark) == 0
    assert "monthly deltas" in capsys.readouterr().out
    lines = (tmp_path / "out" / "monthly_deltas.csv").read_text().splitlines()
    assert len(lines) == 13 and "2.0000000000" in lines[1] and "1.1000000000" in lines[1]
    assert cli.main(["deltas", "--set", "source=x"], spark) == 1 and "lacks output" in caplog.text
    assert cli.main(["query", "--set", "name=none", "--set", "tables=x"], spark) == 1
    assert cli.read_config(None, ["a.b=1", "a.c=text", "d=[1]"]) == {"a": {"b": 1, "c": "text"}, "d": [1]}
    with pytest.raises(ValueError, match="override"):
        cli.read_config(None, ["novalue"])


def test_streamed_daily_means_equal_batch(spark, tmp_path):
    rows = [("a", datetime(2020, 1, d, h), float(h + d)) for d in (1, 2, 3) for h in range(24)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    means.write(means.daily_means(stream, ["k"], "ts", {"value": "value"}, "1 hour"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    want = {(r["day"], r["value"]) for r in means.daily_means(df, ["k"], "ts", {"value": "value"}).collect()}
    got = {(r["day"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got < want and len(want) - len(got) == 1  # the last day stays open
    assert means.degree_contributions(means.daily_means(df, ["k"], "ts", {"value": "value"}), "value").where("hdd > 0").count() > 0
