"""Multi-criteria suitability: segments of factors, masks, comparison, sensitivity and variance shares."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.membership import EPS, aggregate, argmax_index, clamp, membership, suitability_class

MASKS = {"available": lambda s: s * F.col("mask_available"), "exclude_only": lambda s: s * (1 - F.col("mask_excluded")), "none": lambda s: s}


@dataclass(frozen=True)
class Factor:
    column: str
    shape: str
    points: tuple[float, ...]
    weight: float


@dataclass(frozen=True)
class Segment:
    name: str
    factors: tuple[Factor, ...]
    aggregate: str = "geomean"
    mask: str = "none"

    def memberships(self) -> list[Column]:
        return [membership(F.col(f.column), f.shape, f.points) for f in self.factors]

    def weights(self) -> list[float]:
        return [f.weight for f in self.factors]


def zero_mask(s: Column, policy: str) -> Column:
    """Masked cells become 0 and stay in denominators."""
    if policy not in MASKS:
        raise ValueError(f"unknown mask policy {policy!r}")
    return MASKS[policy](s)


def removal_mask(s: Column, keep: Column) -> Column:
    """Masked cells become null and leave denominators."""
    return F.when(keep, s)


def suitability(segment: Segment, weights: Sequence[float] | None = None) -> Column:
    return zero_mask(aggregate(segment.aggregate, segment.memberships(), weights or segment.weights()), segment.mask)


def with_segments(cells: DataFrame, segments: Sequence[Segment], keep: Sequence[str]) -> DataFrame:
    """suit_ and class_ columns of all segments, interleaved, in two projections: no shuffle."""
    out = cells.select(*keep, *[suitability(s).alias(f"suit_{s.name}") for s in segments])
    return out.select(*keep, *[c for s in segments for c in (F.col(f"suit_{s.name}"), suitability_class(F.col(f"suit_{s.name}")).alias(f"class_{s.name}"))])


def comparative(cells: DataFrame, columns: Sequence[str], floor: float = 1e-6, positive_only: bool = True) -> DataFrame:
    """z_ of each column by global mean and population deviation, and the index of the best.

    One row of statistics is broadcast; it has as many values as there are columns, whatever the table.
    """
    seen = [F.when(F.col(c) > 0, F.col(c)) if positive_only else F.col(c) for c in columns]
    stats = cells.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(seen) for n, f in (("_m", F.avg), ("_s", F.stddev_pop))])
    out = cells.crossJoin(F.broadcast(stats))
    out = out.withColumns({f"z_{c}": (F.col(c) - F.col(f"_m{i}")) / F.greatest(F.col(f"_s{i}"), F.lit(floor)) for i, c in enumerate(columns)})
    return out.withColumn("best_use", argmax_index([F.col(f"z_{c}") for c in columns])).drop(*[f"{n}{i}" for i in range(len(columns)) for n in ("_m", "_s")])


def perturbed_weights(weights: Sequence[float], delta: float = 0.2) -> list[list[float]]:
    """Rows of a matrix: one weight scaled by 1 + delta or 1 - delta (at most 1), the rest of the row's sum of 1 shared as before."""
    base = np.asarray(weights, float) / np.sum(weights)
    eye = np.repeat(np.eye(len(base), dtype=bool), 2, axis=0)
    scaled = np.clip(np.outer(base, [1 + delta, 1 - delta]).ravel(), 0, 1)
    rest = np.where(eye, 0.0, base)
    share = np.divide(rest, rest.sum(1, keepdims=True), out=np.zeros_like(rest), where=rest.any(1, keepdims=True))
    return (np.where(eye, scaled[:, None], 0.0) + share * (1 - scaled)[:, None]).tolist()


def sensitivity(segment: Segment, delta: float = 0.2) -> Column:
    """Largest less smallest suitability over the base weights and all perturbed ones, in one expression."""
    scenarios = [segment.weights(), *perturbed_weights(segment.weights(), delta)]
    values = [suitability(segment, w) for w in scenarios]
    return F.greatest(*values) - F.least(*values)


def variance_shares(cells: DataFrame, segment: Segment) -> DataFrame:
    """(factor, share): weight * Cov(term, total) / Var(total), all population moments, so shares sum to 1."""
    log = segment.aggregate == "geomean"
    total = sum(segment.weights())
    terms = [F.ln(clamp(m, EPS, 1.0)) if log else m for m in segment.memberships()]
    t = cells.select(*[x.alias(f"t{i}") for i, x in enumerate(terms)])
    t = t.withColumn("tot", sum((F.lit(w / total) * F.col(f"t{i}") for i, w in enumerate(segment.weights())), F.lit(0.0))).where("tot IS NOT NULL")
    row = t.agg(*[(F.lit(w / total) * F.covar_pop(f"t{i}", "tot") / F.nullif(F.var_pop("tot"), F.lit(0.0))).alias(f.column) for i, (f, w) in enumerate(zip(segment.factors, segment.weights(), strict=True))])
    return row.unpivot([], [f.column for f in segment.factors], "factor", "share")
