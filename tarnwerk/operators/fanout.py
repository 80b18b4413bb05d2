"""Fan-outs of states into technology variants; the variants of a state always sum to it. Variant
layers are kept apart: they are never joined with each other on the state key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import reasons


def heating(states: DataFrame, shares: DataFrame, region: str, package: tuple[str, str], amount: str = "dwellings", as_is: str = "as_is") -> DataFrame:
    """As-is rows split by their region's shares (variant, share); renovated rows take one package."""
    old = states.where(F.col("state") == as_is).join(shares.select(region, "variant", "share"), region)
    new = states.where(F.col("state") != as_is).withColumn("variant", F.lit(package[0])).withColumn("share", F.lit(1.0))
    return old.unionByName(new).withColumn("variant_dwellings", F.col(amount) * F.col("share"))


def cooling(states: DataFrame, cases: DataFrame, region: str, amount: str = "dwellings") -> DataFrame:
    """Each case splits a state into active and inactive; rows of share 0 stay."""
    both = states.join(cases.select(region, "cooling_case", "active_share"), region).withColumn("active", F.explode(F.array(F.lit(False), F.lit(True))))
    share = F.when(F.col("active"), F.col("active_share")).otherwise(1 - F.col("active_share"))
    return both.withColumn("share", share).withColumn("variant_dwellings", F.col(amount) * F.col("share"))


def pv_projection(regions: DataFrame, base_year: int = 2024, target_year: int = 2030, end_year: int = 2050) -> DataFrame:
    """Capacity paths and participation rates of each region from small_n, small_mw, total_mw, target_gwh,
    yield_kwh, rooftop_mw, houses, apartments, apartment_buildings and ratio."""
    c = F.col
    out = regions.withColumn("mean_kwp", F.try_divide(c("small_mw") * 1000, c("small_n"))).withColumn("apartments_per_building", F.try_divide(c("apartments"), c("apartment_buildings")))
    out = out.withColumn("house_rate_base", F.least(F.lit(1.0), F.try_divide(c("small_n"), c("houses")))).withColumn("target_mw", F.try_divide(c("target_gwh") * 1000, c("yield_kwh")))
    grown = c("small_mw") + F.try_divide(c("small_mw"), c("total_mw")) * (c("target_mw") - c("total_mw"))
    out = out.withColumn("small_target_mw", F.greatest(c("small_mw"), grown))
    span = F.lit((end_year - base_year) / (target_year - base_year))
    out = out.withColumn("linear_mw", c("small_mw") + span * (c("small_target_mw") - c("small_mw"))).withColumn("apartment_kwp", F.try_divide(c("mean_kwp"), c("apartments_per_building")))
    per_rate = c("mean_kwp") * c("houses") + c("ratio") * c("apartment_kwp") * c("apartments")
    out = out.withColumn("eligible_mw", per_rate / 1000).withColumn("projected_mw", F.least("linear_mw", "rooftop_mw", "eligible_mw"))
    near = lambda x: F.abs(c(x) - c("projected_mw")) <= 1e-6
    bound = reasons([(near("linear_mw"), "linear_trajectory"), (near("rooftop_mw"), "official_rooftop_potential"), (near("eligible_mw"), "eligible_stock")])
    return out.withColumn("cap_reason", bound).withColumn("house_rate_end", F.try_divide(c("projected_mw") * 1000, per_rate)).withColumn("apartment_rate_end", c("ratio") * c("house_rate_end"))


def pv_assignments(projection: DataFrame, region: str, base_year: int = 2024, end_year: int = 2050) -> DataFrame:
    """Region x basis year x dwelling group: participation rate and capacity, which is 0 where the rate is."""
    c = F.col

    def row(year: int, group: str, rate: Column, kwp: Column, mw: Column, why: Column) -> Column:
        r = rate.cast("double")
        return F.struct(F.lit(year).alias("basis_year"), F.lit(group).alias("dwelling_group"), r.alias("participation_rate"), F.when(r == 0, F.lit(0.0)).otherwise(kwp).alias("capacity_kwp"), mw.alias("basis_mw"), why.alias("cap_reason"))

    seen = F.lit(f"observed_{base_year}_small_system_stock")
    rows = F.array(
        row(base_year, "house", c("house_rate_base"), c("mean_kwp"), c("small_mw"), seen),
        row(base_year, "apartment", F.lit(0.0), F.lit(0.0), c("small_mw"), seen),
        row(end_year, "house", c("house_rate_end"), c("mean_kwp"), c("projected_mw"), c("cap_reason")),
        row(end_year, "apartment", c("apartment_rate_end"), c("apartment_kwp"), c("projected_mw"), c("cap_reason")),
    )
    return projection.select(region, F.explode(rows).alias("r")).select(region, "r.*")


def pv_rows(states: DataFrame, assignments: DataFrame, region: str, amount: str = "dwellings", as_is: str = "as_is", base_year: int = 2024, end_year: int = 2050) -> DataFrame:
    """States split into installed and no_pv by the assignment of their basis year and dwelling group;
    rows of rate 0 stay."""
    basis = states.withColumn("basis_year", F.when(F.col("state") == as_is, base_year).otherwise(end_year))
    rated = basis.join(assignments.select(region, "basis_year", "dwelling_group", "participation_rate", "capacity_kwp"), [region, "basis_year", "dwelling_group"])
    out = rated.withColumn("pv_status", F.explode(F.array(F.lit("no_pv"), F.lit("installed"))))
    on = F.col("pv_status") == "installed"
    out = out.withColumn("share", F.when(on, F.col("participation_rate")).otherwise(1 - F.col("participation_rate"))).withColumn("variant_dwellings", F.col(amount) * F.col("share"))
    return out.withColumn("capacity_mw", F.when(on, F.col("variant_dwellings") * F.col("capacity_kwp") / 1000).otherwise(0.0))


def unreconstructed(variants: DataFrame, keys: Sequence[str], amount: str = "dwellings", atol: float = 1e-5) -> DataFrame:
    """States whose variants don't sum to them, or whose shares don't sum to 1."""
    out = variants.groupBy(*keys).agg(F.sum("variant_dwellings").alias("variants"), F.max(amount).alias("state_total"), F.sum("share").alias("shares"))
    return out.where((F.abs(F.col("variants") - F.col("state_total")) > atol) | (F.abs(F.col("shares") - 1) > 1e-10))


def states_of(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
