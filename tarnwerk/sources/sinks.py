"""Writers: deterministic CSV, JSON, reports, partitioned members, and publishing of several tables at
once after they were read back and checked."""

from __future__ import annotations

import json as jsonlib
import uuid
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.scalars import small_to_zero
from ..operators.checks import CheckFailed

Check = Callable[[DataFrame], object]


def _decimals(df: DataFrame, digits: int) -> list[Column]:
    return [F.format_string(f"%.{digits}f", F.col(f.name)).alias(f.name) if isinstance(f.dataType, DoubleType | FloatType) else F.col(f.name) for f in df.schema.fields]


def csv(df: DataFrame, path: str, order: Sequence[str], digits: int | None = 10) -> None:
    """One CSV part in a fixed order with fixed decimals, committed as a whole. For report tables."""
    out = df.orderBy(*order)
    if digits is not None:
        out = out.select(*_decimals(out, digits))
    out.coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").option("escape", '"').csv(path)


def _shown(c: Column, form: str) -> Column:
    """A double in a C format; ``short`` ones lose zeros at the end, and the sign of zero. Java's formats round the
    shortest text of a double, not its value, so report tables, which are small, go through Python here; in
    batches, null staying null."""
    short, form = form.startswith("short"), form.removeprefix("short")

    def text(v: float) -> str:
        out = format(v, form)
        if short and "." in out:
            out = out.rstrip("0").rstrip(".")
        return "0" if short and out == "-0" else out

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(text)

    return F.when(c.isNull(), None).otherwise(shown(c.cast("double")))


def one_csv(df: DataFrame, path: str, order: Sequence[str], digits: int | None = 10, general: int | None = None, short: int | None = None) -> None:
    """One CSV file at ``path``, replaced at once: written beside it and renamed. Doubles have ``digits``
    decimals, or as many significant figures as ``general`` says, or at most ``short`` decimals, tiny ones being 0;
    without any they are as Spark prints them. Cells are quoted where they have to be. For report tables, which
    fit in one task."""
    spark = df.sparkSession
    out = df.orderBy(*order)
    form = f".{general}g" if general is not None else f"short.{short}f" if short is not None else None
    if form:
        out = out.select(*(_shown(F.col(f.name), form).alias(f.name) if isinstance(f.dataType, DoubleType | FloatType) else F.col(f.name) for f in out.schema.fields))
    elif digits is not None:
        out = out.select(*_decimals(out, digits))
    hadoop = spark._jvm.org.apache.hadoop.fs
    to = hadoop.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    stage = hadoop.Path(to.getParent(), f".{to.getName()}.writing-{uuid.uuid4().hex}")
    try:
        out.coalesce(1).write.option("header", True).option("lineSep", "\n").option("emptyValue", "").option("escape", '"').csv(stage.toString())
        part = next(x.getPath() for x in fs.listStatus(stage) if x.getPath().getName().startswith("part-"))
        _replace(fs, hadoop, [(part, to)])
    finally:
        fs.delete(stage, True)


def _replace(fs: object, hadoop: object, moves: Sequence[tuple[object, object]]) -> None:
    """Rename each source to its target. What a target was is set aside first, and is put back with all others
    if any rename fails."""
    done: list[tuple[object, object | None]] = []
    try:
        for source, to in moves:
            aside = None
            if fs.exists(to):
                aside = hadoop.Path(to.getParent(), f".{to.getName()}.before-{uuid.uuid4().hex}")
                if not fs.rename(to, aside):
                    raise CheckFailed(f"{to} can't be set aside")
            done.append((to, aside))
            fs.mkdirs(to.getParent())
            if not fs.rename(source, to):
                raise CheckFailed(f"{to} can't be moved into place")
    except Exception:
        for to, aside in reversed(done):
            fs.delete(to, True)
            if aside is not None:
                fs.rename(aside, to)
        raise
    for _, aside in done:
        if aside is not None:
            fs.delete(aside, True)


def console(tables: Mapping[str, DataFrame], rows: int = 20) -> str:
    """A plain summary of small tables for a terminal: aligned columns, at most ``rows`` rows each."""
    out = []
    for name, df in tables.items():
        found = df.limit(rows + 1).collect()
        cells = [df.columns, *([("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in found[:rows])]
        width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
        out += [f"{name}:", *("  " + "  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in cells)]
        out += ["  ..."] if len(found) > rows else []
    return "\n".join(out)


def short_decimals(df: DataFrame, digits: int = 12) -> DataFrame:
    """Doubles rounded to ``digits`` and tiny or minus zeros as 0."""
    return df.select(*(small_to_zero(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields))


def members(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One folder a member: later reads of some members prune the others."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def json(document: object, path: str) -> None:
    """A driver-side document with sorted keys, in place at once."""
    to = Path(path)
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_name(to.name + ".part")
    part.write_text(jsonlib.dumps(document, indent=2, sort_keys=True, default=str) + "\n")
    part.replace(to)


def report(title: str, tables: Mapping[str, DataFrame], warnings: DataFrame | None = None, limit: int = 1000) -> str:
    """Markdown of small aggregates; says that there are no warnings only if there are none."""
    lines = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(limit).collect()
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows] + [""]
    if warnings is not None:
        found = warnings.limit(limit).collect()
        lines += ["## Warnings", ""] + ([f"- {', '.join(f'{k}={v}' for k, v in r.asDict().items())}" for r in found] or ["This run produced no warnings."]) + [""]
    return "\n".join(lines)


def latex_table(df: DataFrame, caption: str, drop: Sequence[str] = (), limit: int = 1000) -> str:
    """A longtable of a small table."""
    shown = df.drop(*drop)

    def cell(v: object) -> str:
        return "".join({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}.get(ch, ch) for ch in ("" if v is None else str(v)))

    head = " & ".join(cell(c) for c in shown.columns) + r" \\"
    body = [" & ".join(cell(v) for v in r) + r" \\" for r in shown.limit(limit).collect()]
    return "\n".join([rf"\begin{{longtable}}{{{'l' * len(shown.columns)}}}", rf"\caption{{{cell(caption)}}} \\", r"\hline", head, r"\hline", *body, r"\hline", r"\end{longtable}"])


def publish(tables: Mapping[str, DataFrame], root: str, checks: Mapping[str, Sequence[Check]] | None = None, unchanged: Callable[[], bool] | None = None) -> None:
    """Write all tables to a staging folder, read them back, run their checks (which raise), make sure that
    the inputs are unchanged, and only then move them into place; on failure, also of a move, the tables that
    were there before are there again."""
    spark = next(iter(tables.values())).sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    stage = f"{root.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    place = hadoop.Path(stage)
    fs = place.getFileSystem(conf)
    try:
        for name, df in tables.items():
            df.write.parquet(f"{stage}/{name}")
            again = spark.read.schema(df.schema).parquet(f"{stage}/{name}")
            for check in (checks or {}).get(name, ()):
                check(again)
        if unchanged is not None and not unchanged():
            raise CheckFailed("inputs changed while tables were built")
        _replace(fs, hadoop, [(hadoop.Path(f"{stage}/{name}"), hadoop.Path(f"{root.rstrip('/')}/{name}")) for name in tables])
    finally:
        fs.delete(place, True)
