"""Great-circle pairs, regression residuals, ranges and gates of block sizing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fallowgrid.operators import blocks, stats


@pytest.mark.parametrize("box,longest", [((-55, -45, -20, -10), 150), ((170, 190, -5, 5), 300), ((-180, 180, 80, 90), 400), ((-180, 180, -90, 90), 3000), ((-60, -59, 60, 75), 500)])
def test_pairs_equal_all_pairs(spark, box, longest):
    r = np.random.default_rng(1)
    lon, lat = r.uniform(box[0], box[1], 250), r.uniform(box[2], box[3], 250)
    lon = (lon + 180) % 360 - 180
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat, strict=True))], "id long, lon double, lat double")
    x, y = np.radians(lon), np.radians(lat)
    h = np.sin((y[:, None] - y[None]) / 2) ** 2 + np.cos(y)[:, None] * np.cos(y)[None] * np.sin((x[:, None] - x[None]) / 2) ** 2
    d = 2 * 6371 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
    want = {(i, j) for i, j in zip(*np.nonzero(d <= longest), strict=True) if i < j}
    got = [(r.a_id, r.b_id) for r in blocks.close_pairs(df.withColumn("id2", F.col("id")), longest, ["id2"]).select(F.col("a_id2").alias("a_id"), F.col("b_id2").alias("b_id")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_residuals_are_least_squares(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 2))
    y = 3 + x @ np.array([2.0, -1.0]) + r.normal(size=300)
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))] + [(999, None, 1.0, 1.0)], "id long, a double, b double, y double")
    got = [v[0] for v in df.where("id < 999").orderBy("id").select(blocks.residuals(df, "y", ["a", "b"])).collect()]
    full = np.column_stack([np.ones(300), x])
    assert got == pytest.approx((y - full @ np.linalg.lstsq(full, y, rcond=None)[0]).tolist(), abs=1e-9)


def _gamma(spark, values):
    return spark.createDataFrame([("f", 100.0, i, 5.0 + 10 * i, None if v is None else float(v), 1) for i, v in enumerate(values)], "field string, window double, bin int, centre double, gamma double, n long")


def test_ranges_follow_the_envelope(spark):
    def of(values, block=22.0):
        return blocks.ranges(_gamma(spark, values), block, bins=10).first()

    r = of([1, 2, 3, 4, 3, 4.0, 4, 4, 4, 4])
    assert (r.sill, r.range) == (4, 35) and r.nugget_share == 0.25 and r.shared == pytest.approx((4 - 2.7) / 3)
    assert of([1, 2, 3, 4, 5, 6, 7, 8, 9, 10.0]).range is None  # still climbing
    assert of([None, 2, None, 4, 4, 4, 4, 4, 4, None]).nugget_share == 0.5
    few = of([1.0, None, None, 2, None, None, None, None, None, 3])
    assert few.sill is None and few.range is None and few.nugget_share is None
    assert of([0.0] * 10).range is None
    words = spark.createDataFrame([("residual", 5.0, 0.2), ("residual", 15.0, 0.2), ("residual", 25.0, 0.2), ("residual", None, 0.2), ("fit", 5.0, 0.2), ("residual", 5.0, 0.99)], "f string, r double, n double")
    assert [v[0] for v in words.select(blocks.verdict(F.col("f"), F.col("r"), F.col("n"), 10.0)).collect()] == ["ok", "caveat", "fail", "no plateau in window", "context only", "uninterpretable"]


def test_gate_on_a_field_of_known_range(spark):
    r = np.random.default_rng(3)
    lon, lat = r.uniform(-53, -47, 900), r.uniform(-19, -13, 900)
    x, y = (lon + 50) * 108, (lat + 16) * 111
    field = sum(np.cos(a * x / 25 + b * y / 25 + c) for a, b, c in r.normal(size=(40, 3)) * [1, 1, 9]) / 9
    rows = [(i, float(a), float(b), 0.5, float(v)) for i, (a, b, v) in enumerate(zip(lon, lat, field, strict=True))]
    df = spark.createDataFrame([*rows, (5000, None, 1.0, 0.5, 1.0)], "id long, lon double, lat double, s double, y double")
    for sides, word in ((4, "go"), (12, "caveat"), (60, "no-go")):
        rows, gate = blocks.block_sizing(df, {"c": ("s", "y")}, sides, 900, (200.0,), 20)
        assert gate == word, [tuple(r) for r in rows.collect()]
    assert blocks.block_km(df.where("id < 5000"), 6) == pytest.approx((lon.max() - lon.min()) * 111 * math.cos(math.radians((lat.min() + lat.max()) / 2)) / 6)
    empty, gate = blocks.block_sizing(df.where("false"), {"c": ("s", "y")}, 4, 10, (200.0,), 20)
    assert gate == "no-go" and {r.range for r in empty.collect()} == {None}


def test_gradients_of_groups_equal_single_ones(spark):
    r = np.random.default_rng(4)
    rows = [(g, float(x) if i % 9 else None, float(x * (1 if g == "a" else -1) + r.normal())) for i, (g, x) in enumerate(zip(r.choice(["a", "b", None], 600), r.integers(0, 30, 600), strict=True))]
    df = spark.createDataFrame([*rows, *[("few", 1.0, 2.0)] * 10], "g string, x double, y double")
    table, whole = stats.gradients(df, "x", "y", ["g"])
    found = {r.g: (r.rho, r.n, r.monotonic) for r in whole.collect()}
    assert found.keys() == {"a", "b"}
    for g in found:
        one = stats.gradient(df.where(F.col("g").eqNullSafe(F.lit(g))), "x", "y").collect()
        mine = sorted((r.bin, r.n, r.mean_x, r.mean_y) for r in table.where(F.col("g").eqNullSafe(F.lit(g))).collect())
        assert mine == [pytest.approx(v) for v in sorted((r.bin, r.n, r.mean_x, r.mean_y) for r in one)]
        assert found[g][0] == pytest.approx(one[0].rho) and found[g][2] == one[0].monotonic
