"""Comparison statistics and ordered picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import order_of


def errors(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn("error", F.col(a) - F.col(b))


def error_statistics(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation, mean bias and mean absolute error of a against b."""
    e = F.col(a) - F.col(b)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(a, b).alias("correlation"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"))


def paired_change(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Mean of paired differences, and difference of means."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(a) - F.col(b)).alias("paired"), (F.avg(a) - F.avg(b)).alias("unpaired"))


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("weighted_mean"))


def ratio_of_sums(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.try_divide(F.sum(a), F.sum(b)).alias("ratio"))


def extremes(df: DataFrame, value: str, ties: Sequence[str], carry: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the least and the largest value, the first by ``ties`` among equals; one aggregation."""
    row = F.struct(F.col(value).alias("value"), *(F.col(c) for c in carry))
    least = F.min_by(row, F.struct(F.col(value), *(F.col(t) for t in ties)))
    # the largest value with the least ties: the value is negated for a common order
    most = F.min_by(row, F.struct(-F.col(value), *(F.col(t) for t in ties)))
    got = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(least.alias("a"), most.alias("b"))
    sides = F.array(F.struct(F.lit("min").alias("side"), F.col("a").alias("r")), F.struct(F.lit("max").alias("side"), F.col("b").alias("r")))
    return got.where("a is not null").select(*keys, F.explode(sides).alias("s")).select(*keys, "s.side", "s.r.*")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a given order, by an aggregation that keeps one row a key and task."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*(F.col(c) for c in order), *(F.col(c) for c in rest if c not in order))
    return df.groupBy(*keys).agg(F.min(row).alias("r")).select(*keys, *(F.col(f"r.{c}") for c in rest))


def ordinals(df: DataFrame, category: str, order: Sequence[object], then: str, out: str = "ordinal") -> DataFrame:
    """0-based ordinals of distinct (category in a fixed order, then). Ranks are found on the distinct keys
    and joined back, so only keys meet in one task."""
    keys = df.select(category, then).distinct()
    ranked = keys.withColumn(out, F.row_number().over(Window.orderBy(order_of(F.col(category), order), then)) - 1)
    return df.join(ranked, [category, then])


def collected(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str], out: str = "records") -> DataFrame:
    """Group records as an ordered array of structs; only for groups of bounded size."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias(out))


def exactly_one(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The only value of a group, null if there are none or several."""
    return df.groupBy(*keys).agg(F.when(F.count("*") == 1, F.max(value)).alias(value), F.count("*").alias("rows"))


def sum_where(df: DataFrame, keys: Sequence[str], sums: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Several conditional sums in one pass: name -> (condition, value)."""
    return df.groupBy(*keys).agg(*(F.sum(F.when(c, v)).alias(n) for n, (c, v) in sums.items()))
