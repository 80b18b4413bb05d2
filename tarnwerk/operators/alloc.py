"""Shares, bridges, and capped flows over categorical stock tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_within(df: DataFrame, keys: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """value / sum of value within each group; a zero or null sum gives null. Groups are summed by an
    aggregation and joined back, so a large group is not one task."""
    if not keys:
        total = df.agg(F.sum(value).alias("__total"))
        joined = df.crossJoin(F.broadcast(total))
    else:
        joined = df.join(df.groupBy(*keys).agg(F.sum(value).alias("__total")), list(keys))
    return joined.withColumn(out, F.try_divide(F.col(value).cast("double"), F.col("__total").cast("double"))).drop("__total")


def share_within_small(df: DataFrame, keys: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """The same by a window, without a second pass, for groups known to be small."""
    return df.withColumn(out, F.try_divide(F.col(value).cast("double"), F.sum(value).over(Window.partitionBy(*keys)).cast("double")))


def bridge(df: DataFrame, weights: DataFrame, source: str, target: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Amounts by source class moved to target classes by weights (source, target, weight)."""
    return df.join(weights, source).groupBy(*keys, target).agg(F.sum(F.col(value) * F.col("weight")).alias(value))


def outer_product(a: DataFrame, b: DataFrame, share_a: str, share_b: str, on: Sequence[str] = (), out: str = "share") -> DataFrame:
    """Joint shares of independent marginals: all pairs within ``on``, or all pairs. Marginals are class
    tables; b is a few rows a group."""
    pairs = a.join(b, list(on)) if on else a.crossJoin(b)
    return pairs.withColumn(out, F.col(share_a) * F.col(share_b))


def unpivoted(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Wide to long, columns renamed by ``labels``."""
    long = df.select(*ids, *(F.col(v).cast("double").alias((labels or {}).get(v, v)) for v in values))
    return long.unpivot(list(ids), [(labels or {}).get(v, v) for v in values], name, value)


def category_matrix(df: DataFrame, keys: Sequence[str], category: str, categories: Sequence[str], value: Column, prefix: str) -> DataFrame:
    """By keys: one sum for each known category and their total."""
    sums = [F.sum(F.when(F.col(category) == c, value).otherwise(0)).alias(f"{prefix}{i}") for i, c in enumerate(categories)]
    return df.groupBy(*keys).agg(*sums, F.sum(value).alias(f"{prefix}total"))


def regional_split(df: DataFrame, region: str, category: str, modelled: Sequence[str], value: Column) -> DataFrame:
    """By region: amounts of modelled categories, the residual of all others, and shares of the modelled."""
    wide = category_matrix(df, [region], category, modelled, value, "n_")
    inside = sum((F.col(f"n_{i}") for i in range(1, len(modelled))), F.col("n_0"))
    wide = wide.withColumn("modelled", inside).withColumn("residual", F.col("n_total") - F.col("modelled"))
    return wide.withColumns({f"share_{i}": F.try_divide(F.col(f"n_{i}").cast("double"), F.col("modelled").cast("double")) for i in range(len(modelled))})


def with_total(df: DataFrame, label: str, total: DataFrame, name: str = "Total") -> DataFrame:
    """Group rows and a total row that comes from its own source, not from the sum of the parts."""
    return df.unionByName(total.withColumn(label, F.lit(name)).select(*df.columns))


def allocation(stock: DataFrame, region: str, share: str, weight: str, rates: Mapping[str, str], amount: str) -> DataFrame:
    """Priority-weighted shares of each region's flow: weight = share x priority, allocation = weight over
    the region's sum, flow_<scenario> = rate x regional amount x allocation."""
    w = stock.withColumn("raw_weight", F.col(share) * F.col(weight))
    out = share_within_small(w, [region], "raw_weight", "allocation")
    total = F.sum(amount).over(Window.partitionBy(region))
    return out.withColumn("region_total", total).withColumns({f"flow_{s}": F.col(r) * F.col("region_total") * F.col("allocation") for s, r in rates.items()})


def capped_states(stock: DataFrame, keys: Sequence[str], amount: str, rates: Mapping[str, str], years: float, base_share: Column | None = None, names: tuple[str, str] = ("as_is", "renovated")) -> DataFrame:
    """Two states for each row and scenario: moved = min(amount x base + rate x years x regional total x
    allocation, amount), and what stays. What a cap cuts off is not given to others. ``stock`` carries
    ``region_total`` and ``allocation``."""
    base = F.lit(0.0) if base_share is None else base_share
    scenario = F.explode(F.array(*(F.struct(F.lit(s).alias("scenario"), F.col(r).cast("double").alias("rate")) for s, r in rates.items())))
    each = stock.select(*keys, amount, "region_total", "allocation", base.alias("base_share"), scenario.alias("s")).select("*", "s.scenario", "s.rate").drop("s")
    wanted = F.col(amount) * F.col("base_share") + F.col("rate") * F.lit(float(years)) * F.col("region_total") * F.col("allocation")
    moved = each.withColumn("wanted", wanted).withColumn("moved", F.least("wanted", F.col(amount).cast("double"))).withColumn("capped", F.col("wanted") > F.col(amount) + 1e-10)
    two = F.explode(F.array(F.struct(F.lit(names[0]).alias("state"), (F.col(amount) - F.col("moved")).alias("dwellings")), F.struct(F.lit(names[1]).alias("state"), F.col("moved").alias("dwellings"))))
    return moved.withColumn("t", two).select(*keys, "scenario", "rate", "t.state", "t.dwellings", amount, "capped")


def crosscheck(states: DataFrame, region: str, amount: str, renovated: str = "renovated") -> DataFrame:
    """By region and scenario: renovated sum and fraction, bound caps, and a status."""
    moved = states.where(F.col("state") == renovated)
    out = moved.groupBy(region, "scenario").agg(F.sum("dwellings").alias("renovated"), F.sum(amount).alias("stock"), F.count_if("capped").alias("caps"))
    out = out.withColumn("fraction", F.try_divide(F.col("renovated"), F.col("stock").cast("double")))
    status = F.when(F.col("scenario") == "low", "below_policy_compatible_trajectory").when(F.col("scenario") == "central", "policy_compatible_scenario").when(F.col("caps") > 0, "accelerated_scenario_with_archetype_caps").otherwise("accelerated_scenario")
    return out.withColumn("status", status)
