"""Polygon union against exact sums over slabs."""

from fractions import Fraction

import numpy as np
import pytest

from fallowgrid.operators import overlay

SCHEMA = "unit string, rings array<array<struct<x:double,y:double>>>"


def covered(polygons):
    """Exact area of a union by even-odd rings of whole numbers: slabs between all corners and crossings."""
    edges = [(k, a, b) for k, rings in enumerate(polygons) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True) if a[0] != b[0]]
    at = lambda e, x: e[1][1] + Fraction(x - e[1][0]) * (e[2][1] - e[1][1]) / (e[2][0] - e[1][0])
    xs = {Fraction(p[0]) for _, a, b in edges for p in (a, b)}
    for i, e in enumerate(edges):
        for f in edges[:i]:
            s, t = Fraction(e[2][1] - e[1][1], e[2][0] - e[1][0]), Fraction(f[2][1] - f[1][1], f[2][0] - f[1][0])
            if s != t:
                x = ((f[1][1] - t * f[1][0]) - (e[1][1] - s * e[1][0])) / (s - t)
                if all(min(g[1][0], g[2][0]) <= x <= max(g[1][0], g[2][0]) for g in (e, f)):
                    xs.add(x)
    total, xs = Fraction(0), sorted(xs)
    for a, b in zip(xs, xs[1:], strict=False):
        here = [e for e in edges if min(e[1][0], e[2][0]) <= a and max(e[1][0], e[2][0]) >= b]
        here.sort(key=lambda e: at(e, (a + b) / 2))
        inside, last = set(), None
        for e in here:
            if inside:
                total += (at(e, (a + b) / 2) - last) * (b - a)
            inside ^= {e[0]}
            last = at(e, (a + b) / 2)
    return float(total)


def rows(unit, polygons):
    return [(unit, [[(float(x), float(y)) for x, y in r] for r in rings]) for rings in polygons]


def box(x, y, w, h):
    return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]


CASES = {
    "apart": [box(0, 0, 2, 2), box(5, 5, 1, 1)],
    "shared side": [box(0, 0, 2, 2), box(2, 0, 2, 2)],
    "part of a side": [box(0, 0, 2, 4), box(2, 1, 2, 2)],
    "crossing": [box(0, 2, 6, 2), box(2, 0, 2, 6)],
    "frame": [box(0, 0, 6, 2), box(0, 4, 6, 2), box(0, 0, 2, 6), box(4, 0, 2, 6)],
    "corner": [box(0, 0, 2, 2), box(2, 2, 2, 2)],
    "copies": [box(1, 1, 3, 3)] * 5,
    "hole filled": [box(0, 0, 6, 6) + box(2, 2, 2, 2), box(1, 1, 4, 4)],
    "hole kept": [box(0, 0, 6, 6) + box(2, 2, 2, 2)],
    "inside": [box(0, 0, 9, 9), [[(2, 2), (5, 3), (3, 6)]]],
    "none": [[[(0, 0), (3, 3)]], []],
}


def test_unions_of_boxes(spark):
    df = spark.createDataFrame([r for name, p in CASES.items() for r in rows(name, p)] + [("null", None)], SCHEMA)
    got = {r.unit: (r.area, r.rings, r.holes) for r in overlay.union_area(df, ["unit"]).collect()}
    want = {"apart": (5, 2, 0), "shared side": (8, 1, 0), "part of a side": (12, 1, 0), "crossing": (20, 1, 0), "frame": (32, 2, 1), "corner": (8, 2, 0), "copies": (9, 1, 0), "hole filled": (36, 1, 0), "hole kept": (32, 2, 1), "inside": (81, 1, 0)}
    assert got.keys() == want.keys()
    for k, (area, rings, holes) in want.items():
        assert (pytest.approx(area), rings, holes) == got[k], k


@pytest.mark.parametrize("per_strip", [1000, 11])
def test_unions_of_triangles_equal_slabs(spark, per_strip):
    rng = np.random.default_rng(3)
    shapes = {u: [[[tuple(map(int, p)) for p in rng.integers(0, 40, 2) + rng.integers(-9, 9, (3, 2))]] for _ in range(25)] for u in ("a", "b")}
    df = spark.createDataFrame([r for u, p in shapes.items() for r in rows(u, p)], SCHEMA)
    found = overlay.union_rings(df, ["unit"], grid=1e-6, per_strip=per_strip).collect()
    for u, p in shapes.items():
        assert sum(r.area for r in found if r.unit == u) == pytest.approx(covered(p), rel=1e-6)
    for r in found:  # corners stand in order: their own area is the ring's
        x, y = np.array([c.x for c in r.corners]), np.array([c.y for c in r.corners])
        assert (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2 == pytest.approx(r.area, rel=1e-9, abs=1e-9)


def test_cycles(spark):
    rng = np.random.default_rng(1)
    ids = rng.permutation(1000).tolist()
    links, start = [], 0
    for size in (1, 2, 37, 960):
        own = ids[start : start + size]
        links += list(zip(own, own[1:] + own[:1], strict=True))
        start += size
    after = dict(links)
    for r in overlay.cycles(spark.createDataFrame(links, "id long, next long")).collect():
        at = r.id
        for _ in range(r.ahead):
            at = after[at]
        assert at == r.ring
