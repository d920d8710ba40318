"""What must not grow faster than the input: plans that work a step out once, and pairs in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fallowgrid.functions.membership import suitability_class
from fallowgrid.operators import blocks, climate, stats
from fallowgrid.operators.pairs import pair_tallies
from fallowgrid.operators.suitability import suitability, with_segments
from fallowgrid.plans.suitability import CROPS


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_transition_works_classes_out_once(spark):
    cells = spark.createDataFrame([(40.0, 0.02, 20000.0), (5.0, 0.09, 900.0), (30.0, None, 20000.0), (None, 0.05, None)], "l_quantity double, l_discount double, l_extendedprice double")
    t = climate.transition(with_segments(cells, CROPS[:2], []), "class_alpha", "class_beta")
    assert _plan(t).count("EXP(") == 1
    rows = {(r.before, r.after): r.share_pct for r in t.collect()}
    one = cells.select(suitability_class(suitability(CROPS[0])).alias("p"), suitability_class(suitability(CROPS[1])).alias("f")).collect()
    both = [(r.p, r.f) for r in one if r.p is not None and r.f is not None]
    assert len(rows) == 16 and len(both) == 2 and {k: v for k, v in rows.items() if v} == {k: pytest.approx(100 * both.count(k) / 2) for k in both}
    assert {r.share_pct for r in climate.transition(cells.where("false").select(F.lit(1).alias("a"), F.lit(1).alias("b")), "a", "b").collect()} == {None}


def test_class_of_a_score_names_it_without_conditions(spark):
    df = spark.createDataFrame([(None,), (0.2,), (0.25,), (0.6,), (0.75,)], "s double").select(suitability_class(F.col("s")).alias("c"))
    assert [r.c for r in df.collect()] == [None, 0, 1, 2, 3] and "CASE" not in _plan(df)


def test_variogram_joins_no_points_and_equals_all_pairs(spark):
    r = np.random.default_rng(5)
    x, y, v = r.uniform(-1, 1, 700), r.uniform(-0.3, 0.3, 700), r.normal(size=700)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, v, strict=True))]
    odd = [(None, 0.0, 0.0, 9.0), (900, None, 0.0, 9.0), (901, float("nan"), 0.0, 9.0), (902, float("inf"), 0.0, 9.0), (0, 0.1, 0.1, 9.0)]
    df = spark.createDataFrame([*rows, *odd], "id long, x double, y double, v double")
    got = stats.variogram(df, "v", 8, 0.4)
    assert "(id < id2)" not in _plan(got).replace("#", "").lower() and "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    ids, px, py, pv = np.append(np.arange(700), 0), np.append(x, 0.1), np.append(y, 0.1), np.append(v, 9.0)
    d = np.sqrt((px[:, None] - px) ** 2 + (py[:, None] - py) ** 2)
    use = (np.triu(np.ones_like(d), 1) > 0) & (d <= 0.4) & (ids[:, None] != ids)
    k = np.minimum((d / 0.05).astype(int), 7)
    for row in got.collect():
        m = use & (k == row.bin)
        assert row.n == m.sum() and row.lag == pytest.approx(d[m].mean()) and row.gamma == pytest.approx(((pv[:, None] - pv) ** 2)[m].mean() / 2)


def test_blocks_of_any_size_tally_every_pair_once(spark):
    r = np.random.default_rng(6)
    rows = [(i, float(a), float(b), None if i % 7 == 0 else float(i % 5)) for i, (a, b) in enumerate(r.uniform(0, 1, (300, 2)))]
    df = spark.createDataFrame(rows, "id long, x double, y double, v double")

    def one(square):
        return np.sqrt(square), [np.where(square <= 0.25, 0, 1)]

    a, v = np.array([t[1:3] for t in rows]), np.array([np.nan if t[3] is None else t[3] for t in rows])
    near = np.triu(((a[:, None] - a) ** 2).sum(2) <= 0.25, 1)
    gap = (v[:, None] - v)[near] ** 2
    for block in (7, 4096):
        t = pair_tallies(df, ["x", "y"], ["v"], 0.5, 1, one, block).first()
        assert (t.n, t.n_v) == (near.sum(), np.isfinite(gap).sum()) and t.s_v == pytest.approx(np.nansum(gap))


def test_block_sizing_reads_every_point(spark):
    # 2,500 points: those beyond the first 2,000 of a sample would change every bin
    r = np.random.default_rng(7)
    lon, lat, v = r.uniform(-52, -50, 2500), r.uniform(-20, -17, 2500), r.normal(size=2500)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(lon, lat, v, strict=True))], "id long, lon double, lat double, f double")
    x, y = np.radians(lon), np.radians(lat)
    h = np.sin((y[:, None] - y) / 2) ** 2 + np.cos(y)[:, None] * np.cos(y) * np.sin((x[:, None] - x) / 2) ** 2
    d = 2 * 6371 * np.arcsin(np.sqrt(h))
    gap, upper = (v[:, None] - v) ** 2, np.triu(np.ones_like(d), 1) > 0
    for row in blocks.semivariograms(df, ["f"], (50.0, 100.0), None, 5).collect():
        m = upper & (d > row.bin * row.window / 5) & (d <= (row.bin + 1) * row.window / 5)
        assert row.n == m.sum() and row.gamma == pytest.approx(gap[m].mean() / 2) and row.centre == pytest.approx((row.bin + 0.5) * row.window / 5)


def test_rows_of_a_group_do_not_meet_in_one_task(spark, monkeypatch):
    df, plans, keep = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.rand(3).alias("v")), {}, stats.stored
    executed = lambda d: d._jdf.queryExecution().executedPlan().toString()

    def watched(d, tag):
        plans.setdefault(tag, executed(d))
        return keep(d, tag)

    monkeypatch.setattr(stats, "stored", watched)
    binned = stats.grouped_bins(df, "v", 4, ["g"])
    for plan in (plans["ranges"], executed(binned)):
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {(r.g, r.bin) for r in binned.select("g", "bin").distinct().collect()} == {(g, b) for g in range(3) for b in range(4)}
