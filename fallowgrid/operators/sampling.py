"""Reproducible sampling and spatial hold-out, ordered by an integer hash that any engine can compute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(key: Column, seed: int) -> Column:
    """A fixed scramble of a non-negative key: portable arithmetic, below 2^31."""
    k = F.pmod(key.cast("long"), F.lit(1_000_003))
    return F.pmod(F.pmod(k * 48271 + seed * 16807 + 11, F.lit(2_147_483_647)) * 69621 + k, F.lit(2_147_483_647))


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest (order key, key)."""
    return df.withColumn("_o", order_key(F.col(key), seed)).orderBy("_o", key).limit(n).drop("_o")


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows per stratum, the smallest by order key; rows with null strata go.

    Strata are thinned under salts first, so no task sorts a whole hot stratum.
    """
    d = df.where(" AND ".join(f"{s} IS NOT NULL" for s in strata)).withColumn("_o", order_key(F.col(key), seed))
    salted = Window.partitionBy(*strata, F.pmod(F.col("_o"), F.lit(16))).orderBy("_o", key)
    d = d.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= n)
    whole = Window.partitionBy(*strata).orderBy("_o", key)
    return d.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= n).drop("_r", "_o")


def folds(df: DataFrame, block: str, k: int, seed: int = 42) -> DataFrame:
    """Whole blocks dealt to k folds in the order of their scrambled ids."""
    blocks = df.select(block).distinct().withColumn("_o", order_key(F.col(block), seed))
    dealt = blocks.withColumn("fold", F.pmod(F.row_number().over(Window.orderBy("_o", block)) - 1, F.lit(k)).cast("int")).drop("_o")
    return df.join(dealt, block)


def balanced_halves(blocks: DataFrame, block: str, stratum: str, area: str) -> DataFrame:
    """(block, stratum, area, half): within a stratum blocks are dealt from the largest down (ties by id), each to the half with less area so far, 0 of equals.

    The deal is a fold over the stratum's sorted blocks: blocks are spatial squares, so a stratum's list is short.
    """
    queue = F.sort_array(F.collect_list(F.struct((-F.col(area)).alias("less"), F.col(block).alias("id"))))
    ahead = F.col("_queue")
    start = F.struct(F.lit(0.0).alias("lead"), F.array().cast("array<int>").alias("halves"))
    # lead: area of half 0 less that of half 1
    deal = lambda acc, x: F.struct((acc["lead"] + F.when(acc["lead"] <= 0, -x["less"]).otherwise(x["less"])).alias("lead"), F.concat(acc["halves"], F.array((acc["lead"] > 0).cast("int"))).alias("halves"))
    dealt = blocks.groupBy(stratum).agg(queue.alias("_queue")).select(stratum, "_queue", F.aggregate(ahead, start, deal, lambda acc: acc["halves"]).alias("_halves"))
    return dealt.select(stratum, F.explode(F.arrays_zip("_queue", "_halves")).alias("x")).select(F.col("x._queue.id").alias(block), stratum, (-F.col("x._queue.less")).alias(area), F.col("x._halves").alias("half"))


def split_balance(blocks: DataFrame, stratum: str, area: str, half: str = "half", least: int = 1000, rows: str = "n") -> DataFrame:
    """(stratum, half, blocks, area, share_pct of the stratum, rows, thin): thin marks halves with fewer rows than `least`."""
    g = blocks.groupBy(stratum, half).agg(F.count("*").alias("blocks"), F.sum(area).alias("area"), F.sum(rows).alias("rows"))
    return g.withColumn("share_pct", 100 * F.col("area") / F.sum("area").over(Window.partitionBy(stratum))).withColumn("thin", F.col("rows") < least)


def halves(df: DataFrame, split: str) -> DataFrame:
    """Each row in its half and in `full`, so one aggregation serves all three domains."""
    return df.withColumn("half", F.explode(F.array(F.lit("full"), F.when(F.col(split) == 0, F.lit("calib")).otherwise(F.lit("val")))))
