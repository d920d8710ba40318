"""Monthly climatology, derived climate bands, and delta-change projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def monthly(df: DataFrame, cell: Sequence[str], ts: str, values: dict[str, Column]) -> DataFrame:
    """One row per cell and month of the year: mean of each value over all years."""
    return df.groupBy(*cell, F.month(ts).alias("month")).agg(*[F.avg(v).alias(k) for k, v in values.items()])


def climate_bands(months: DataFrame, cell: Sequence[str], pr: str, pet: str, temperature: str, dry: float = 60.0, base: float = 10.0, days: float = 30.4) -> DataFrame:
    """Annual sums, seasonality, dry months, wet-season sum, aridity, growing degree days, warmest and coldest quarter.

    Months of a cell meet in one aggregation; the quarters come from an array of twelve, so nothing is shuffled twice.
    """
    by = F.map_from_entries(F.collect_list(F.struct(F.col("month"), F.col(temperature))))
    out = months.groupBy(*cell).agg(
        F.sum(pr).alias("pr_annual"), F.sum(pet).alias("pet_annual"), F.stddev_pop(pr).alias("_sd"), F.avg(pr).alias("_m"),
        F.sum((F.col(pr) < dry).cast("int")).alias("dry_months"), F.collect_list(pr).alias("_pr"),
        F.sum(F.greatest(F.col(temperature) - base, F.lit(0.0)) * days).alias("gdd"), by.alias("_t"), F.count("*").alias("n_months"),
    )
    quarter = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: sum((F.try_element_at("_t", F.pmod(i + k, F.lit(12)) + 1) for k in range(3)), F.lit(0.0)) / 3)
    return out.select(
        *cell, "n_months", "pr_annual", "pet_annual", "dry_months", "gdd",
        (F.col("_sd") / F.greatest(F.col("_m"), F.lit(0.001))).alias("pr_cv"),
        F.aggregate(F.filter("_pr", lambda x: x >= F.col("_m")), F.lit(0.0), lambda a, x: a + x).alias("pr_wet"),
        (F.col("pr_annual") / F.greatest(F.col("pet_annual"), F.lit(0.001))).alias("aridity"),
        F.array_max(quarter).alias("warm_quarter"), F.array_min(quarter).alias("cold_quarter"),
    )


def change_factors(past: DataFrame, future: DataFrame, keys: Sequence[str], ratios: Sequence[str], differences: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """Ratio of future to past (past floored) and difference of future less past, per key."""
    f = future.select(*keys, *[F.col(c).alias(f"_f_{c}") for c in (*ratios, *differences)])
    j = past.join(f, list(keys))
    return j.select(*keys, *[(F.col(f"_f_{c}") / F.greatest(F.col(c), F.lit(floor))).alias(f"ratio_{c}") for c in ratios], *[(F.col(f"_f_{c}") - F.col(c)).alias(f"delta_{c}") for c in differences])


def ensemble(factors: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean over models of each factor: a mean of ratios, not a ratio of means."""
    return factors.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def apply_factors(baseline: DataFrame, factors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Future months: precipitation by ratio, temperatures by difference, evapotranspiration by the Hargreaves ratio."""
    j = baseline.join(factors, list(keys))
    tx, tn = F.col("tmmx") + F.col("delta_tmmx"), F.col("tmmn") + F.col("delta_tmmn")
    mean_b, mean_f = (F.col("tmmx") + F.col("tmmn")) / 2, (tx + tn) / 2
    wide_b, wide_f = F.greatest(F.col("tmmx") - F.col("tmmn"), F.lit(0.1)), F.greatest(tx - tn, F.lit(0.1))
    pet = F.col("pet") * (mean_f + 17.8) / (mean_b + 17.8) * F.sqrt(wide_f / wide_b)
    return j.select(*keys, (F.col("pr") * F.col("ratio_pr")).alias("pr"), pet.alias("pet"), tx.alias("tmmx"), tn.alias("tmmn"))


def agreement(models: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """(keys, ensemble, agreement): mean delta, and the share of models on its side of zero (zero is not positive)."""
    e = models.groupBy(*keys).agg(F.avg(delta).alias("ensemble"))
    return models.join(e, list(keys)).groupBy(*keys, "ensemble").agg(F.avg(((F.col(delta) > 0) == (F.col("ensemble") > 0)).cast("double")).alias("agreement"))


def transition(df: DataFrame, before: str, after: str, classes: int = 4) -> DataFrame:
    """(before, after, share_pct) for all class pairs, absent ones 0."""
    spine = df.sparkSession.range(classes * classes).select((F.col("id") / classes).cast("int").alias("before"), (F.col("id") % classes).cast("int").alias("after"))
    # nulls count as a class of their own that the spine lacks: a filter on them would work the classes out once more for every row
    known = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1))
    n = df.groupBy(known(before).alias("before"), known(after).alias("after")).agg(F.count("*").alias("n"))
    joined = spine.join(n, ["before", "after"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # one row per class pair
    return joined.select("before", "after", (100.0 * F.try_divide("n", F.sum("n").over(Window.partitionBy()))).alias("share_pct"))
