"""Agreement of a found mask with a reference: by cell, within a tolerance, and by patch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, focal, metrics


def tolerant_agreement(grid: DataFrame, found: Column, reference: Column, tolerance: int) -> DataFrame:
    """(found, confirmed, share, baseline, lift): found cells within the tolerance of the reference, against a random draw."""
    near = focal.near(grid, reference, tolerance, "__near")
    t = near.agg(F.count("*").alias("n"), F.count_if(found).alias("found"), F.count_if(found & F.col("__near")).alias("confirmed"), F.count_if("__near").alias("near"))
    share = F.col("confirmed") / F.greatest(F.col("found"), F.lit(1))
    base = F.col("near") / F.col("n")
    return t.select("found", "confirmed", share.alias("share"), base.alias("baseline"), F.try_divide(share, base).alias("lift"))


def agreement(grid: DataFrame, found: Column, reference: Column, area: Column, tolerance: int = 2, least: int = 10) -> DataFrame:
    """One row: the contingency table and its ratios, areas, and confirmation by cell, tolerance and patch with lifts."""
    table = metrics.ratios(metrics.contingency(grid, found, reference))
    areas = grid.agg(F.sum(area).alias("domain_area"), F.sum(F.when(found, area).otherwise(0.0)).alias("found_area"), F.sum(F.when(reference, area).otherwise(0.0)).alias("reference_area")).first()
    near = tolerant_agreement(grid, found, reference, tolerance).first()
    patch = components.confirmed_patches(grid.where(found).select("r", "c"), grid.where(reference).select("r", "c"), least, tolerance).first()
    extra = {k: areas[k] for k in ("domain_area", "found_area", "reference_area")} | {"gti_tolerant": near["share"], "baseline_tolerant": near["baseline"], "lift_tolerant": near["lift"], "n_patches": patch["n_patches"], "n_confirmed": patch["n_confirmed"]}
    return table.withColumns({k: F.lit(v) for k, v in extra.items()}).withColumn("lift", F.try_divide(F.col("precision"), F.col("prevalence")))
