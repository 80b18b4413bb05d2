"""Invariants as operators: each gives rows of (check, violations), none collects data.

``audit`` evaluates any number of row predicates in one pass. ``enforce`` raises on violations and
returns the table it guards; warnings stay rows and never raise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import close, finite


class CheckFailed(ValueError):
    """An invariant doesn't hold; the message names it."""


def require_columns(df: DataFrame, needed: Sequence[str] = (), exact: Sequence[str] | None = None, forbidden: Sequence[str] = ()) -> DataFrame:
    """``df`` if it has the needed columns, is exactly ``exact`` in order, and has none forbidden."""
    if missing := [c for c in needed if c not in df.columns]:
        raise CheckFailed(f"missing columns: {', '.join(missing)}")
    if exact is not None and list(exact) != df.columns:
        raise CheckFailed(f"columns are {df.columns}, not {list(exact)}")
    if found := [c for c in forbidden if c in df.columns]:
        raise CheckFailed(f"obsolete columns: {', '.join(found)}")
    return df


def audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row a rule: how many rows its predicate doesn't hold for (null counts as not)."""
    counts = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("violations")) for n in rules))).alias("r")).select("r.*")


def _as_check(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of more than one row, and their rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _as_check(duplicate_keys(df, keys), f"unique {', '.join(keys)}")


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return audit(df, {f"not null {c}": F.col(c).isNotNull() for c in columns})


def not_blank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return audit(df, {f"not blank {c}": F.trim(c) != "" for c in columns})


def in_range(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Finite and between the bounds, both included."""
    return audit(df, {f"range {c}": finite(F.col(c).cast("double")) & F.col(c).between(lo, hi) for c, (lo, hi) in bounds.items()})


def row_count(df: DataFrame, expected: int) -> DataFrame:
    return df.agg(F.abs(F.count("*") - expected).alias("violations")).select(F.lit(f"rows = {expected}").alias("check"), "violations")


def covers(df: DataFrame, keys: Sequence[str], value: str, domain: Sequence[object]) -> DataFrame:
    """Groups whose values aren't exactly the domain, each value once."""
    want = F.sort_array(F.array(*[F.lit(v) for v in domain]))
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("values")).where(~F.col("values").eqNullSafe(want))


def constant(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.count_distinct(column) - 1).alias("violations")).select(F.lit(f"constant {column}").alias("check"), F.greatest("violations", F.lit(0).cast("long")).alias("violations"))


def identity(df: DataFrame, name: str, left: Column, right: Column, atol: float = 0.0, rtol: float = 0.0) -> DataFrame:
    return audit(df, {name: close(left, right, atol, rtol)})


def implies(df: DataFrame, name: str, condition: Column, then: Column) -> DataFrame:
    return audit(df, {name: ~F.coalesce(condition, F.lit(False)) | then})


def unchanged(df: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of ``df`` that differ from their source row, nulls being equal, by column."""
    other = source.select(*keys, *(F.col(c).alias(f"{c}__source") for c in columns))
    return audit(df.join(other, list(keys), "left"), {f"unchanged {c}": F.col(c).eqNullSafe(F.col(f"{c}__source")) for c in columns})


def group_sums(df: DataFrame, keys: Sequence[str], value: str, target: float | Column = 1.0, atol: float = 1e-9) -> DataFrame:
    """Groups whose sum isn't the target."""
    want = F.lit(target) if isinstance(target, int | float) else F.max(target)
    return df.groupBy(*keys).agg(F.sum(value).alias("total"), want.alias("target")).where(~close(F.col("total"), F.col("target"), atol))


def states(df: DataFrame, keys: Sequence[str], state: str, expected: Sequence[str]) -> DataFrame:
    """Groups that don't have exactly the expected states."""
    return covers(df, keys, state, expected)


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only: the keys and ``side``."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))


def agreement(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], atol: float | None = None) -> DataFrame:
    """Joined rows whose fields disagree: keys, field, and both values as text."""
    other = right.select(*keys, *(F.col(c).alias(f"{c}__other") for c in columns))
    same = (lambda c: close(F.col(c), F.col(f"{c}__other"), atol)) if atol is not None else (lambda c: F.col(c).eqNullSafe(F.col(f"{c}__other")))
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), F.col(f"{c}__other").cast("string").alias("other"), same(c).alias("same")) for c in columns))
    return left.join(other, list(keys)).select(*keys, F.explode(each).alias("f")).where("not f.same").select(*keys, "f.field", "f.value", "f.other")


def headline(df: DataFrame, totals: Mapping[str, tuple[Column, float]], atol: float = 0.0) -> DataFrame:
    """Aggregates against known totals."""
    row = df.agg(*(a.alias(n) for n, (a, _) in totals.items()))
    return audit(row, {n: close(F.col(f"`{n}`").cast("double"), F.lit(float(t)), atol) for n, (_, t) in totals.items()})


def pinned(df: DataFrame, totals: Mapping[str, tuple[Column, float]], hashes: Mapping[str, str], known: Mapping[str, str], atol: float = 0.0) -> DataFrame | None:
    """``headline`` against totals that hold for inputs of known hashes only: None for any other inputs, whose
    totals may differ."""
    return headline(df, totals, atol) if dict(hashes) == dict(known) else None


def fields_of(*frames: DataFrame) -> list[str]:
    """All column names, each once, in the order of first appearance."""
    return list(dict.fromkeys(c for df in frames for c in df.columns))


def disagreements(found: Mapping, expected: Mapping, atol: float = 0.0, at: str = "") -> list[str]:
    """Where a nested document says something else than is expected: paths, with both values. Fields that
    nothing is expected of may hold anything; numbers are compared with ``atol``, lists by position."""
    out: list[str] = []
    for key, want in expected.items():
        path, got = f"{at}{key}", found.get(key) if isinstance(found, Mapping) else None
        if isinstance(want, Mapping):
            out += disagreements(got if isinstance(got, Mapping) else {}, want, atol, f"{path}.")
        elif isinstance(want, list) and isinstance(got, list) and len(want) == len(got) and any(isinstance(x, Mapping) for x in want):
            for i, (g, w) in enumerate(zip(got, want, strict=True)):
                out += disagreements({"": g}, {"": w}, atol, f"{path}[{i}]")
        elif isinstance(want, float) and isinstance(got, int | float) and not isinstance(got, bool):
            out += [] if abs(got - want) <= atol else [f"{path}: {got!r}, not {want!r}"]
        elif type(got) is not type(want) or got != want:
            out.append(f"{path}: {got!r}, not {want!r}")
    return out


def require_agreement(found: Mapping, expected: Mapping, name: str = "metadata", atol: float = 0.0) -> Mapping:
    """``found`` if it says what is expected."""
    if wrong := disagreements(found, expected, atol):
        raise CheckFailed(f"{name}: {'; '.join(wrong)}")
    return found


def outside_bands(df: DataFrame, keys: Sequence[str], bands: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """Warnings: (code, column, low, high) bands, both ends included; one row for each value outside."""
    each = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high")) for code, c, lo, hi in bands))
    return df.select(*keys, F.explode(each).alias("w")).select(*keys, "w.*").where(~F.col("value").between(F.col("low"), F.col("high")))


def union_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (c.select("check", F.col("violations").cast("long").alias("violations")) for c in checks))


def enforce(df: DataFrame, *checks: DataFrame) -> DataFrame:
    """``df``, or CheckFailed naming the violated checks. Collects one row a check."""
    failed = union_checks(*checks).where("violations > 0").collect() if checks else []
    if failed:
        raise CheckFailed("; ".join(f"{r['check']}: {r['violations']}" for r in failed))
    return df


def enforce_empty(df: DataFrame, name: str, found: DataFrame) -> DataFrame:
    """``df`` if ``found`` has no rows; else CheckFailed with the first few."""
    some = found.take(3)
    if some:
        raise CheckFailed(f"{name}: {', '.join(str(r.asDict()) for r in some)}")
    return df
