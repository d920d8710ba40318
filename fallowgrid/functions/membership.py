"""Fuzzy memberships and their aggregation, as Column factories.

`greatest` and `least` skip nulls, so an unguarded clamp would turn a missing factor into 1; every ramp keeps null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-3
CLASS_BREAKS = (0.25, 0.50, 0.75)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def rising(x: Column, a: float, b: float) -> Column:
    return clamp((x - F.lit(float(a))) / F.lit(float(b - a)), 0.0, 1.0)


def falling(x: Column, a: float, b: float) -> Column:
    return clamp((F.lit(float(b)) - x) / F.lit(float(b - a)), 0.0, 1.0)


def plateau(x: Column, a: float, b: float, c: float, d: float) -> Column:
    return F.when(x.isNotNull(), F.least(rising(x, a, b), falling(x, c, d)))


SHAPES: dict[str, tuple[int, Callable[..., Column]]] = {"increasing": (2, rising), "decreasing": (2, falling), "range": (4, plateau)}


def check_points(shape: str, points: Sequence[float]) -> None:
    if shape not in SHAPES:
        raise ValueError(f"unknown shape {shape!r}")
    if len(points) != SHAPES[shape][0]:
        raise ValueError(f"{shape} takes {SHAPES[shape][0]} points, not {len(points)}")
    ok = points[0] < points[1] if len(points) == 2 else points[0] < points[1] <= points[2] < points[3]
    if not ok:
        raise ValueError(f"points of {shape} are out of order: {list(points)}")


def membership(x: Column, shape: str, points: Sequence[float]) -> Column:
    check_points(shape, points)
    return SHAPES[shape][1](x.cast("double"), *points)


def _weighted(memberships: Sequence[Column], weights: Sequence[float], of: Callable[[Column], Column]) -> Column:
    total = float(sum(weights))
    if not memberships or total <= 0:
        raise ValueError("a segment needs factors with a positive sum of weights")
    return reduce(lambda a, b: a + b, [F.lit(w / total) * of(m) for m, w in zip(memberships, weights, strict=True)])


def weighted_geomean(memberships: Sequence[Column], weights: Sequence[float]) -> Column:
    """exp of the weighted mean of logarithms; memberships are floored at EPS, so 0 is a strong finite penalty."""
    return F.exp(_weighted(memberships, weights, lambda m: F.ln(clamp(m, EPS, 1.0))))


def weighted_arithmetic(memberships: Sequence[Column], weights: Sequence[float]) -> Column:
    return _weighted(memberships, weights, lambda m: m)


AGGREGATES = {"geomean": weighted_geomean, "arithmetic": weighted_arithmetic}


def aggregate(name: str, memberships: Sequence[Column], weights: Sequence[float]) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}")
    return AGGREGATES[name](memberships, weights)


def suitability_class(s: Column) -> Column:
    """0 (below 0.25) to 3 (0.75 and over), null for null; s stands in no condition, so it is worked out once for all breaks."""
    return reduce(lambda a, b: a + b, [(s >= F.lit(c)).cast("int") for c in CLASS_BREAKS])


def argmax_index(columns: Sequence[Column]) -> Column:
    """Index of the largest value, the first of equals; null if all are null."""
    a = F.array(*columns)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def quantize(x: Column, lo: float, hi: float, steps: int = 254, empty: int = 255) -> Column:
    """Values clamped to [lo, hi] and scaled to 0 .. steps; null becomes `empty`."""
    return F.coalesce(F.round((clamp(x, lo, hi) - lo) / (hi - lo) * steps).cast("int"), F.lit(empty))


def remap(x: Column, codes: dict[int, int], default: int) -> Column:
    table = F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])
    return F.coalesce(F.try_element_at(table, x), F.lit(default))


def circular_month(month: Column, shift: int) -> Column:
    return (F.pmod(month - 1 + shift, F.lit(12)) + 1).cast("int")


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
