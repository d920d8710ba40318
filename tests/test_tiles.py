"""Tiles: order, images, levels, archives in two phases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fallowgrid.operators import tiles
from fallowgrid.sources import tile_archive

PALETTE = tiles.ramp([(0, 0, 0), (255, 255, 255)])


def test_hilbert_numbers_follow_neighbours():
    for z in range(6):
        n = 1 << z
        x, y = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(n)))
        h = tiles.hilbert(np.full(n * n, z), x, y)
        base = (4**z - 1) // 3
        assert sorted(h.tolist()) == list(range(base, base + n * n))
        order = np.argsort(h)
        assert (np.abs(np.diff(x[order])) + np.abs(np.diff(y[order])) == 1).all()
    mixed = tiles.hilbert(np.array([0, 1, 1, 3]), np.array([0, 0, 1, 5]), np.array([0, 0, 1, 2]))
    assert mixed.tolist() == [0, 1, 3, int(tiles.hilbert(np.array([3]), np.array([5]), np.array([2]))[0])]


def test_images_keep_their_values():
    v = np.random.default_rng(0).integers(0, 256, (256, 256)).astype(np.uint8)
    image = tiles.png(v, PALETTE)
    assert (tiles.values_of(image) == v).all() and image[1:4] == b"PNG" and len(PALETTE) == 255 and PALETTE[-1] == (255, 255, 255)


def _cells(spark):
    return spark.range(900).select((F.col("id") % 30).cast("int").alias("gx"), F.floor(F.col("id") / 30).cast("int").alias("gy"), F.when(F.col("id") % 7 > 0, F.pmod(F.hash("id"), F.lit(255))).cast("int").alias("v"))


def test_pixels_and_levels_equal_loops(spark):
    west, north, step, zoom = -50.3, -11.7, 0.5, 3
    at = {(r.gx, r.gy): r.v for r in _cells(spark).collect()}
    n = 256 << zoom
    want = {}
    for px in range(n):
        lon = (px + 0.5) * 360 / n - 180
        if not west - 1 < lon < west + 30 * step + 1:
            continue
        for py in range(n):
            lat = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (py + 0.5) / n))))
            v = at.get((int(np.floor((lon - west) / step)), int(np.floor((north - lat) / step))))
            if v is not None:
                want[px, py] = v
    level = tiles.pixels(_cells(spark), "v", zoom, west, north, step)
    assert {(r.px, r.py): r.value for r in level.collect()} == want and len(want) > 3000
    for categorical in (True, False):
        groups = {}
        for (px, py), v in want.items():
            groups.setdefault((px // 2, py // 2), []).append(v)
        up = {k: min(v, key=lambda x: (-v.count(x), x)) if categorical else int(np.floor(sum(v) / len(v) + 0.5)) for k, v in groups.items()}  # noqa: B023
        assert {(r.px, r.py): r.value for r in tiles.overview(level, categorical).collect()} == up
    assert tiles.pixels(_cells(spark).where("false"), "v", zoom, west, north, step).count() == 0


def test_archives_are_read_back_and_pruned(spark, tmp_path):
    tile_archive.register(spark)
    path = str(tmp_path / "layer")
    level = tiles.pixels(_cells(spark), "v", 4, -50.3, -11.7, 0.5)
    found = tiles.pyramid(_cells(spark), "v", 4, -50.3, -11.7, 0.5, PALETTE)
    found.repartitionByRange(3, "id").sortWithinPartitions("id").write.format("tile_archive").mode("overwrite").save(path)
    back = spark.read.format("tile_archive").load(path)
    assert {(r.px, r.py): r.value for r in tiles.read_values(back.where("z = 4")).collect()} == {(r.px, r.py): r.value for r in level.collect()}
    ids = sorted(r.id for r in back.collect())
    assert len(ids) == len(set(ids)) and {r.z for r in back.select("z").distinct().collect()} == {0, 1, 2, 3, 4}
    some = back.where(f"id >= {ids[2]} AND id < {ids[-1]}")
    assert sorted(r.id for r in some.collect()) == ids[2:-1] and back.where(f"id = {ids[1]}").rdd.getNumPartitions() == 1 < back.rdd.getNumPartitions()
    assert [r.id for r in back.where("id > 4000000").collect()] == []
    # a failed write leaves the archive as it was
    before = set(os.listdir(path))
    bad = found.select("id", "z", "x", "y", F.when(F.col("z") == 0, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("data")).alias("data"))
    with pytest.raises(Exception, match="broken"):
        bad.repartitionByRange(3, "id").sortWithinPartitions("id").write.format("tile_archive").mode("overwrite").save(path)
    assert set(os.listdir(path)) == before
    with pytest.raises(Exception, match="sorted"):
        found.coalesce(1).orderBy(F.desc("id")).write.format("tile_archive").mode("overwrite").save(path)
    # appended tiles must not overlap; a new write replaces all parts
    with pytest.raises(Exception, match="overlap"):
        found.repartitionByRange(1, "id").sortWithinPartitions("id").write.format("tile_archive").mode("append").save(path)
    assert set(os.listdir(path)) == before and spark.read.format("tile_archive").load(path).count() == len(ids)
    found.where("z > 2").repartitionByRange(2, "id").sortWithinPartitions("id").write.format("tile_archive").mode("overwrite").save(path)
    assert {r.z for r in spark.read.format("tile_archive").load(path).select("z").distinct().collect()} == {3, 4} and before.isdisjoint(set(os.listdir(path)) - {"_current"})
