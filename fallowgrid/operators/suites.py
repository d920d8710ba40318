"""Validation suites: each gives rows (metric, segment, half, value, n, p) of all halves from one pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probability import correlation_p, variance_p
from ..sources.tables import stored
from . import stats
from .sampling import halves

COLUMNS = ("metric", "segment", "half", "value", "n", "p")
#: Significant digits of means that are ranked.
DIGITS = 12


def _record(df: DataFrame, metric: str, value: str, p=None) -> DataFrame:
    have = {"metric": F.lit(metric), "segment": F.col("segment") if "segment" in df.columns else F.lit("all"), "half": F.col("half"), "value": F.col(value).cast("double"), "n": F.col("n").cast("long"), "p": F.lit(None).cast("double") if p is None else p}
    return df.select(*[have[c].alias(c) for c in COLUMNS])


def unit_correlation(cells: DataFrame, unit: str, split: str, segments: Sequence[str], proxy: str) -> DataFrame:
    """Rank correlation of the units' mean scores with the proxy's mean; a unit counts in each half that holds cells of it.

    Cells are reduced to (unit, half) sums once for all segments; units without a mean of every band go.
    Means count to DIGITS digits, so that units of equal cells tie whatever the order of their sums.
    """
    m = halves(cells, split).groupBy(unit, "half").agg(*[F.avg(c).alias(c) for c in (*segments, proxy)]).dropna(subset=[*segments, proxy])
    m = m.select(unit, "half", *[F.format_string(f"%.{DIGITS - 1}e", F.col(c).cast("double")).cast("double").alias(c) for c in (*segments, proxy)])
    long = m.unpivot(["half", proxy], list(segments), "segment", "score")
    r = stats.spearman(long, "score", proxy, ["segment", "half"])
    return _record(r, "spearman", "rho", correlation_p(F.col("rho"), F.col("n")))


def presence(cells: DataFrame, split: str, scores: Mapping[str, tuple[str, object]], role: str, least: int = 30) -> DataFrame:
    """AUC and Boyce index of every segment (name: its score and its role's code) and half; with under `least` presences a presence_underpowered row instead."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("segment"), F.col(score).alias("s"), F.coalesce((F.col(role) == code).cast("long"), F.lit(0)).alias("y")) for name, (score, code) in scores.items()])).alias("x")
    # rows and presences of every distinct score, the halves side by side: they combine before the only shuffle of cells
    wide = cells.select(F.col(split).alias("_h"), each).select("_h", "x.*").where("s IS NOT NULL").groupBy("segment", "s").agg(*[F.sum(F.when(cond, value).otherwise(0)).alias(f"{k}_{half}") for half, cond in (("full", F.lit(True)), ("calib", F.col("_h") == 0), ("val", ~F.coalesce(F.col("_h") == 0, F.lit(False)))) for k, value in (("n", F.lit(1).cast("long")), ("p", F.col("y")))])
    halves_ = F.explode(F.array(*[F.struct(F.lit(h).alias("half"), F.col(f"n_{h}").alias("n"), F.col(f"p_{h}").alias("p")) for h in ("full", "calib", "val")])).alias("h")
    counts = stored(wide, "presence").select("segment", "s", halves_).select("segment", "s", "h.*").where("n > 0")
    keys = ["segment", "half"]
    a = stats.auc_of_counts(counts, "s", keys).withColumn("n", F.col("n_pos") + F.col("n_neg"))
    enough = a.where(F.col("n_pos") >= least)
    b = stats.spearman(stats.boyce_of_counts(counts, "s", by=keys), "centre", "pe", keys).select(*keys, F.col("rho").alias("boyce")).join(enough.select(*keys, "n"), keys)
    few = a.where(F.col("n_pos") < least).withColumn("none", F.lit(None).cast("double"))
    return _record(enough, "auc", "auc").unionByName(_record(b, "boyce", "boyce")).unionByName(_record(few, "presence_underpowered", "none"))


def within_crop(cells: DataFrame, split: str, scores: Mapping[str, tuple[str, object]], role: str, proxy: str, bins: int = 5, least: int = 50) -> DataFrame:
    """Rank correlation of every segment's score with the proxy over the cells of its own role, by half, with whether the proxy's mean
    never falls from bin to bin of the score: all segments and halves in the same pass; halves under `least` cells have no row."""
    each = F.explode(F.array(*[F.when(F.col(role) == code, F.struct(F.lit(name).alias("segment"), F.col(score).alias("s"))) for name, (score, code) in scores.items()])).alias("x")
    long = halves(cells, split).select("half", F.col(proxy).alias("y"), each).where("x IS NOT NULL").select("half", "y", "x.*")
    _, r = stats.gradients(long, "s", "y", ["segment", "half"], bins, least)
    rows = _record(r, "within_crop_rho", "rho", correlation_p(F.col("rho"), F.col("n")))
    return rows.join(r.select("segment", "half", "monotonic"), ["segment", "half"]).select(*COLUMNS, "monotonic")


def zone_variance(cells: DataFrame, zone: str, value: str, split: str) -> DataFrame:
    """The variance ratio across zones in each half that has two zones or more."""
    a = stats.anova(halves(cells, split), value, zone, ["half"]).where("k >= 2")
    return _record(a, "anova_f", "f", variance_p(F.col("f"), F.col("n"), F.col("k")))


def isolated(suites: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(rows of all suites that ran, errors by name): a suite that fails loses its own rows only.

    Each suite's rows are written as it ends, so that a later failure can't undo them.
    """
    out, failed = None, {}
    for name, build in suites.items():
        try:
            rows = stored(build(), "suite")
        except Exception as e:  # noqa: BLE001 - any failure is the suite's own
            failed[name] = f"{type(e).__name__}: {e}"
            continue
        out = rows if out is None else out.unionByName(rows)
    return out, failed
