"""Validation statistics as aggregations.

Ranks over a whole column would put all rows into one task; `average_ranks` instead counts distinct values,
cumulates the counts by range partitions and joins the few partition offsets back.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .pairs import pair_tallies
from .sampling import uniform_sample


def _cumulated(counts: DataFrame, by: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """`before`: the sum of n over smaller values of the same group, without a single-task sort.

    The counts are dealt into sorted ranges and written once with the number of their range, so that both uses
    see the same ranges.  Each range cumulates on its own; the ranges' totals (one row per range and group) are
    cumulated apart and joined back.
    """
    parted = stored(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = parted.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    totals = parted.groupBy("_part", *by).agg(F.sum(n).alias("_t"))
    over = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_off", F.coalesce(F.sum("_t").over(over), F.lit(0))).drop("_t")
    same = [F.col("l._part") == F.col("t._part"), *(F.col(f"l.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by)]
    return local.alias("l").join(totals.alias("t"), same).select("l.*", (F.col("_in") + F.col("_off")).alias("before")).drop("_part", "_in")


def percentiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """(by.., p0, p1, ..): exact percentiles with linear interpolation.

    A sketch of every group (one pass, a few kilobytes per group and task) gives two values between which each percentile lies, `4 / accuracy` of
    the rows apart; a second pass counts the rows below them, and only the rows between are counted by value and ranked.  A sketch that
    missed its guarantee would leave a rank outside, which is an error, never a wrong value.
    """
    d = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_v"))
    eps = 2 / accuracy
    probes = [x for p in shares for x in (max(0.0, float(p) - eps), min(1.0, float(p) + eps))]
    ends = d.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", probes, accuracy).alias("_q"))
    # in small groups a sketch's error and the step to the next rank are of one size: all rows lie between
    small = F.col("_n") <= 2 * accuracy
    low = [F.when(F.lit(float(p) <= eps) | small, F.col("_min")).otherwise(F.col("_q")[2 * i]) for i, p in enumerate(shares)]
    high = [F.when(F.lit(float(p) >= 1 - eps) | small, F.col("_max")).otherwise(F.col("_q")[2 * i + 1]) for i, p in enumerate(shares)]
    spans = ends.select(*by, "_n", F.array(*[F.struct(F.lit(i).alias("i"), a.alias("a"), b.alias("b")) for i, (a, b) in enumerate(zip(low, high, strict=True))]).alias("_s"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    # written first, so that its size (a row per group) is known and the rows stay where they are instead of meeting their whole group in one task
    j = d.alias("d").join(stored(spans, "spans").alias("s"), same).select("d.*", "_n", "_s") if by else d.crossJoin(F.broadcast(spans))  # without groups one row
    # each row once per span it lies in, or below: the rows below are only counted
    tall = j.select(*by, "_n", "_v", F.explode("_s").alias("x")).where(F.col("_v") <= F.col("x.b"))
    counts = tall.groupBy(*by, "_n", F.col("x.i").alias("_i"), F.when(F.col("_v") >= F.col("x.a"), F.col("_v")).alias("_w")).agg(F.count("*").alias("n"))
    # nulls (all rows below the span) come first
    ranked = _cumulated(counts, [*by, "_i"], "_w")
    place = F.element_at(F.array(*[F.lit(float(p)) for p in shares]), F.col("_i") + 1) * (F.col("_n") - 1)
    r = ranked.withColumn("_h", place).groupBy(*by, "_i").agg(*[F.max(F.when(F.col("_w").isNotNull() & (F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("_w"))).alias(c) for c, k in (("_lo", F.floor("_h")), ("_hi", F.ceil("_h")))], F.max(F.col("_h") - F.floor("_h")).alias("_f"))
    exact = F.when(F.col("_lo").isNotNull() & F.col("_hi").isNotNull(), F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo"))).otherwise(F.raise_error(F.lit("a percentile lies outside its sketch's bounds")).cast("double"))
    return r.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, exact)).alias(f"p{i}") for i in range(len(shares))])


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., value, n, rank): the average rank of each distinct value within its group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return _cumulated(counts, by, value).select(*by, value, "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., rho, n) over rows with both values."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))).groupBy(*by, x, y).agg(F.count("*").alias("w"))
    rx = _cumulated(pairs.groupBy(*by, x).agg(F.sum("w").alias("n")), by, x).select(*by, x, (F.col("before") + (F.col("n") + 1) / 2).alias("rx"))
    ry = _cumulated(pairs.groupBy(*by, y).agg(F.sum("w").alias("n")), by, y).select(*by, y, (F.col("before") + (F.col("n") + 1) / 2).alias("ry"))
    z = pairs.join(rx, [*by, x]).join(ry, [*by, y])
    w = F.col("w")
    m = z.groupBy(*by).agg(F.sum("w").alias("n"), *[F.sum(w * e).alias(k) for k, e in (("sx", F.col("rx")), ("sy", F.col("ry")), ("sxy", F.col("rx") * F.col("ry")), ("sxx", F.col("rx") ** 2), ("syy", F.col("ry") ** 2))])
    n = F.col("n")
    cov, vx, vy = (F.col(a) - F.col(b) * F.col(c) / n for a, b, c in (("sxy", "sx", "sy"), ("sxx", "sx", "sx"), ("syy", "sy", "sy")))
    return m.select(*by, F.try_divide(cov, F.sqrt(vx * vy)).alias("rho"), F.col("n"))


def auc(df: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., auc, n_pos, n_neg): Mann-Whitney with average ranks; null without both classes."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("p"))
    return auc_of_counts(counts, score, by)


def auc_of_counts(counts: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """The same from (by.., score, n, p): rows and positives of every distinct score."""
    ranked = _cumulated(counts, by, score).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    s = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("n_pos"), F.sum(F.col("n") - F.col("p")).alias("n_neg"))
    return s.select(*by, F.try_divide(F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(kappa, n) from the confusion counts of two labelings."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    ra, rb = c.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("na")), c.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("nb"))
    chance = ra.join(rb, "k").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("e"))
    t = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("o")).crossJoin(F.broadcast(chance))
    po, pe = F.col("o") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return t.select(F.try_divide(po - pe, 1 - pe).alias("kappa"), "n")


def anova(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., f, n, k): one-way analysis of variance over groups with at least two rows."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n >= 2")
    t = g.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    each = g.select(*by, F.col("n").alias("ng"), "m", "v")
    j = each.join(t, list(by)) if by else each.crossJoin(F.broadcast(t))
    s = j.groupBy(*by, "n", "k").agg(F.sum(F.col("ng") * (F.col("m") - F.col("mean")) ** 2).alias("b"), F.sum(F.col("ng") * F.col("v")).alias("w"))
    return s.select(*by, F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))).alias("f"), "n", "k")


def boyce(df: DataFrame, score: str, presence: str, bins: int = 10, width: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """(by.., centre, pe): predicted over expected share in moving windows over [0, 1]; windows without background go."""
    rows = df.where(F.col(score).isNotNull()).select(*by, score, F.lit(1).cast("long").alias("n"), F.coalesce(F.col(presence).cast("long"), F.lit(0)).alias("p"))
    return boyce_of_counts(rows, score, bins, width, by)


def boyce_of_counts(counts: DataFrame, score: str, bins: int = 10, width: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """The same from (by.., score, n, p): rows and presences of every distinct score, or several such rows."""
    centres = [width / 2 + i * (1 - width) / (bins - 1) for i in range(bins)]
    inside = [(F.col(score) >= c - width / 2) & (F.col(score) <= c + width / 2) for c in centres]
    row = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), *[F.sum(F.when(x, F.col(k)).otherwise(0)).alias(f"{k2}{i}") for k, k2 in (("n", "b"), ("p", "p")) for i, x in enumerate(inside)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("centre"), F.col(f"b{i}").alias("b"), F.col(f"p{i}").alias("q")) for i, c in enumerate(centres)])).alias("x")
    return row.select(*by, "n", "p", each).where("x.b > 0").select(*by, "x.centre", F.try_divide(F.try_divide("x.q", "p"), F.col("x.b") / F.col("n")).alias("pe"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari,) of two labelings, from their contingency counts."""
    c = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    two = lambda x: F.sum(x * (x - 1) / 2)
    ij = c.agg(two(F.col("n")).alias("ij"), F.sum("n").alias("n"))
    ra = c.groupBy(a).agg(F.sum("n").alias("m")).agg(two(F.col("m")).alias("i"))
    rb = c.groupBy(b).agg(F.sum("n").alias("m")).agg(two(F.col("m")).alias("j"))
    t = ij.crossJoin(F.broadcast(ra)).crossJoin(F.broadcast(rb))
    expected = F.col("i") * F.col("j") / (F.col("n") * (F.col("n") - 1) / 2)
    return t.select(F.try_divide(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected).alias("ari"))


def quantile_bins(df: DataFrame, x: str, bins: int, name: str = "bin") -> DataFrame:
    """`df` with the index of each row's equal-frequency bin of x (edges by exact percentiles, equal edges count once)."""
    inner = percentiles(df, x, [i / bins for i in range(1, bins)])
    ends = df.agg(F.min(x).cast("double").alias("_least"), F.max(x).cast("double").alias("_most"))
    edges = inner.crossJoin(F.broadcast(ends)).select(F.filter(F.array_distinct(F.array(*[F.col(f"p{i}") for i in range(bins - 1)])), lambda e: (e > F.col("_least")) & (e < F.col("_most"))).alias("_edges"))
    # one row of fixed size
    out = df.crossJoin(F.broadcast(edges))
    return out.withColumn(name, F.when(F.col(x).isNotNull(), F.size(F.filter("_edges", lambda e: e < F.col(x))))).drop("_edges")


def variogram(points: DataFrame, value: str, bins: int, longest: float, most_points: int | None = None, seed: int = 42) -> DataFrame:
    """(bin, lag, gamma, n) of point pairs (id, x, y) up to `longest` apart, of a sample of `most_points` points where given.

    All pairs within reach are tallied in blocks (see `pairs`): their number grows with the square of the points in a square of `longest`.
    """
    points = points if most_points is None else uniform_sample(points, "id", most_points, seed)

    def numbered(square: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        distance = np.sqrt(square)
        number = np.minimum(distance / (longest / bins), bins - 1).astype(np.intp)
        number[distance > longest] = bins
        return distance, [number]

    t = pair_tallies(points.select("id", "x", "y", F.col(value).alias("v")), ["x", "y"], ["v"], longest, bins, numbered)
    return t.select("bin", (F.col("lag") / F.col("n")).alias("lag"), (F.try_divide("s_v", "n_v") / 2).alias("gamma"), "n")


def variogram_range(gamma: DataFrame, share: float = 0.95) -> DataFrame:
    """(sill, range): running maximum of gamma, its mean over the last quarter of bins, the first lag that reaches `share`."""
    w = Window.orderBy("bin")
    env = gamma.withColumn("env", F.max("gamma").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy()))
    env = env.withColumn("sill", F.avg(F.when(F.col("k") > F.col("m") - F.ceil(F.col("m") / 4), F.col("env"))).over(Window.partitionBy()))
    return env.agg(F.max("sill").alias("sill"), F.min(F.when((F.col("env") >= share * F.col("sill")) & (F.col("m") >= 4), F.col("lag"))).alias("range"))


def monotonic(df: DataFrame, order: str, value: str) -> DataFrame:
    """(monotonic,): whether the value never falls along the order; null for fewer than two rows (a table of bins: few rows)."""
    w = Window.orderBy(order)
    d = df.select((F.col(value) - F.lag(value).over(w)).alias("d"))
    return d.agg(F.bool_and(F.col("d") >= 0).alias("monotonic"))


def gradient(df: DataFrame, x: str, y: str, bins: int = 5) -> DataFrame:
    """(bin, n, mean_x, mean_y, rho, monotonic): rank correlation and means by equal-frequency bins of x, over rows with both values."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = quantile_bins(both, x, bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))
    one = spearman(both, x, y).select("rho", F.col("n").alias("_all")).crossJoin(F.broadcast(monotonic(g, "bin", "mean_y")))
    return g.crossJoin(F.broadcast(one)).where(F.col("_all") >= bins).drop("_all")


def grouped_bins(df: DataFrame, x: str, bins: int, by: Sequence[str], name: str = "bin") -> DataFrame:
    """`df` with the index of each row's equal-frequency bin of x within its group: the groups' edges are a table that is joined back."""
    inner = percentiles(df, x, [i / bins for i in range(1, bins)], by)
    ends = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.min(x).cast("double").alias("_least"), F.max(x).cast("double").alias("_most"))
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by]
    edges = inner.alias("i").join(ends.alias("e"), same).select(*[F.col(f"i.{c}").alias(c) for c in by], F.filter(F.array_distinct(F.array(*[F.col(f"p{i}") for i in range(bins - 1)])), lambda e: (e > F.col("_least")) & (e < F.col("_most"))).alias("_edges"))
    out = df.alias("d").join(stored(edges, "edges").alias("e"), [F.col(f"d.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by], "left").select("d.*", "_edges")
    return out.withColumn(name, F.when(F.col(x).isNotNull(), F.size(F.filter("_edges", lambda e: e < F.col(x))))).drop("_edges")


def gradients(df: DataFrame, x: str, y: str, by: Sequence[str], bins: int = 5, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """((by.., bin, n, mean_x, mean_y), (by.., rho, n, monotonic)) of every group with at least `least` rows that have both values; rows without a group go."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).dropna(subset=list(by))
    g = grouped_bins(both, x, bins, by).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))
    rise = g.withColumn("_d", F.col("mean_y") - F.lag("mean_y").over(Window.partitionBy(*by).orderBy("bin"))).groupBy(*by).agg(F.bool_and(F.col("_d") >= 0).alias("monotonic"))
    r = spearman(both, x, y, by).where(F.col("n") >= least)
    whole = r.alias("r").join(rise.alias("m"), [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by]).select("r.*", "monotonic")
    table = g.alias("g").join(whole.select(*by).alias("w"), [F.col(f"g.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by], "left_semi")
    return table, whole


def boyce_index(df: DataFrame, score: str, presence: str, bins: int = 10, width: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """(by.., boyce, n): rank correlation of the windows' centres with their ratios."""
    return spearman(boyce(df, score, presence, bins, width, by), "centre", "pe", by).select(*by, F.col("rho").alias("boyce"), "n")


def interpolated(table: DataFrame, x: str, y: str, at: float) -> DataFrame:
    """(value,): y at a place between the table's points, by the line through its neighbours; the end's y outside."""
    low = F.max(F.when(F.col(x) <= at, F.struct(F.col(x), F.col(y)))).alias("lo")
    high = F.min(F.when(F.col(x) >= at, F.struct(F.col(x), F.col(y)))).alias("hi")
    a, b = F.col("lo"), F.col("hi")
    line = a[y] + F.coalesce(F.try_divide(F.lit(at) - a[x], b[x] - a[x]), F.lit(0.0)) * (b[y] - a[y])
    return table.agg(low, high).select(F.coalesce(line, a[y], b[y]).alias("value"))
