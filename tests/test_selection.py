import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fallowgrid.operators import ahp, bands, grid, reports, selection, stats, zoning
from fallowgrid.sources import tables
from fallowgrid.streaming.climatology import window_means


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 0.3, (60, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    return spark.createDataFrame([(i, i % 2, *map(float, v), i // 60) for i, v in enumerate(x)], "id int, split int, a double, b double, true int")


def test_panel_and_hold_out_find_the_groups(blobs):
    got = {r.k: r for r in selection.panel(blobs, ["a", "b"], (2, 3), references=2).collect()}
    assert got[3].silhouette > got[2].silhouette and got[3].davies_bouldin < got[2].davies_bouldin and got[3].gap > got[2].gap
    x = np.array([(r.a, r.b, r.true) for r in blobs.orderBy("id").collect()])
    inertia = sum(((x[x[:, 2] == k, :2] - x[x[:, 2] == k, :2].mean(0)) ** 2).sum() for k in range(3))
    assert got[3].inertia == pytest.approx(inertia)
    assert selection.holdout(blobs, "split", ["a", "b"], (3,)).first()["ari"] == pytest.approx(1)
    assert selection.stability(blobs, "id", ["a", "b"], 3, fits=3) == pytest.approx(1)
    with pytest.raises(ValueError):
        selection.holdout(blobs.where("id < 40"), "split", ["a", "b"], (2,))


def test_samples_agree_and_centres_match(blobs):
    ari, matched = selection.compare_samples(blobs.where("id % 3 = 0"), blobs.where("id % 3 = 1"), blobs, ["a", "b"], 3)
    assert ari == pytest.approx(1) and len({j for _, j, _ in matched}) == 3 and all(d < 1 for *_, d in matched)
    assert [(i, j) for i, j, _ in selection.match_centroids(np.array([[0.0], [1.0]]), np.array([[0.4], [0.0]]))] == [(0, 1), (1, 0)]


def test_inflation_equals_regressions(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 3)) @ np.array([[1, 0.6, 0], [0, 1, 0.3], [0, 0, 1]])
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    got = selection.inflation(df, ["a", "b", "c"])
    for k, name in enumerate("abc"):
        z = np.column_stack([np.delete(x, k, 1), np.ones(len(x))])
        rest = x[:, k] - z @ np.linalg.lstsq(z, x[:, k], rcond=None)[0]
        assert got[name] == pytest.approx(x[:, k].var() / rest.var())
    assert selection.redundant(df, "a", ["b", "c"], 0.4).first()["nearest"] == "b"


def test_forest_learns_a_threshold(spark):
    df = spark.range(600).select(((F.col("id") * 37) % 101).cast("double").alias("x"), (F.col("id") % 2 == 0).alias("calib"), (F.col("id") % 3).alias("fold")).withColumn("y", (F.col("x") > 50).cast("int"))
    assert selection.forest_kappa(df, ["x"], "y", "y", "calib", trees=5).first()["kappa"] > 0.95
    assert [r.n for r in selection.forest_folds(df, ["x"], "y", "y", "fold", 3, trees=3).collect()] == [200, 200, 200]


def test_anchored_weights():
    assert [ahp.tercile(r, 7) for r in (1, 2, 3, 5, 7)] == [1, 1, 2, 3, 3]
    assert ahp.allowed_steps(2, 6) == (1, 2) and ahp.allowed_steps(None, None) == (1, 4)
    m = ahp.anchored_matrix([1, 2, 4], [0.4, 0.2, None], ["s", "s", None])
    assert m[0, 1] == 2 and m[1, 2] == 5 and m[2, 0] == pytest.approx(1 / 7) and np.allclose(m * m.T, 1)
    bands_, m, moves = ahp.revise_bands([2, 1, 4], [(1, 2), (1, 3), (3, 4)], [0.75, 0.25, None], ["s", "s", None])
    assert ahp.consistency_ratio(m) <= 0.1 and 0 < len(moves) <= 3 and all(a <= b <= c for b, (a, c) in zip(bands_, [(1, 2), (1, 3), (3, 4)], strict=True))
    # of all allowed bands only (1, 3, 3) is consistent, and it is three moves away
    case = ([1, 1, 4], [(1, 2), (1, 3), (3, 4)], [0.9, 0.1, None], ["s", "s", None])
    assert ahp.revise_bands(*case)[0] == [1, 3, 3]
    with pytest.raises(ValueError):
        ahp.revise_bands(*case, most=2)
    with pytest.raises(ValueError):
        ahp.revise_bands([1, 1, 4], [(1, 1), (1, 1), (4, 4)], *case[2:])
    # a free factor of the worst pair moves before a ranked one
    assert {f for f, _ in ahp.revise_bands([1, 1, 4], [(1, 2), (1, 4), (3, 4)], *case[2:])[2][:1]} == {1}
    assert ahp.drifted([0.5, 0.5], [0.5, 0.5001]) == [1]


def test_side_tables_are_checked():
    assert [bands.side_of(c, ["site"], ["clim_a"]) for c in ("lc_x", "site_y", "clim_a")] == ["landcover", "site", "stack"]
    with pytest.raises(ValueError):
        bands.side_of("other", [], [])
    with pytest.raises(ValueError):
        bands.check_sides(["site_a"], [], ["site", "cons"])
    assert bands.year_band(["classification_2020", "x"], 2020) == "classification_2020"
    with pytest.raises(ValueError):
        bands.year_band(["classification_2020"], 2021)


def test_variogram_range_and_report_helpers(spark):
    g = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 3.0), (2, 3.0, 2.0), (3, 4.0, 3.1)], "bin int, lag double, gamma double")
    assert tuple(stats.variogram_range(g).first()) == (3.1, 2.0)
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 1.0), ("b", 5.0, 1.0)], "g string, v double, w double")
    assert {tuple(r) for r in reports.top_per_group(df, ["g"], [F.desc("v")], 1).select("g", "v").collect()} == {("a", 3.0), ("b", 5.0)}
    assert df.agg(reports.weighted_share(F.col("v"), F.col("w")).alias("s")).first()["s"] == 2.5
    v = spark.createDataFrame([(0.3, 0.0, 0.0), (0.3, 0.1, 0.0), (0.3, 0.3, 0.0)], "a double, b double, c double")
    assert [r[0] for r in v.select(reports.sigma_verdict(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["FAIL", "WARN", "OK"]
    with pytest.raises(ValueError):
        reports.require_columns(df, ["half"])
    assert stats.monotonic(df, "v", "w").first()["monotonic"] is False


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, None, 3)], "k int, v string, p int")
    assert {tuple(r) for r in tables.latest(df, "k", "p", "v").collect()} == {(1, "y")}
    calls = []
    build = lambda: calls.append(1) or df
    path = str(tmp_path / "made")
    assert tables.cached(spark, path, build).count() == tables.cached(spark, path, build).count() == 3 and len(calls) == 1
    tables.cached(spark, path, build, fresh=True)
    assert len(calls) == 2
    tables.write_csv(df, str(tmp_path / "b" / "t"))
    assert tables.first_csv(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "t", "k int, v string, p int").count() == 3
    with pytest.raises(FileNotFoundError):
        tables.first_csv(spark, [str(tmp_path / "a")], "t", "k int")
    tables.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    (tmp_path / "c.json").write_text(json.dumps({"edge": 250}))
    assert tables.config(str(tmp_path / "c.json")) == {"edge": 250}


def test_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "value", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = window_means(stream, "ts", "value", "event_type", "5 days").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    rows = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 4)) for r in df.collect())
    assert rows(spark.table("windows")) == rows(window_means(events, "ts", "value", "event_type", "5 days"))


def test_depths_fills_and_theme_weights(spark):
    df = spark.createDataFrame([(1.0, 2.0, 6.0), (1.0, None, 2.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(bands.depth_mean({"x": (("a", "b", "c"), 0.1)})["x"]).collect()]
    assert got[0] == pytest.approx(0.3) and got[1] is None
    assert [r[0] for r in df.select(bands.valid(F.col("c"), 5, 2.0)).collect()] == [None, 4.0]
    assert zoning.theme_weights(["clim_a", "clim_b", "soil_a"]) == pytest.approx([2**-0.5, 2**-0.5, 1])
    flat = spark.createDataFrame([(x, y, 5.0) for x in range(5) for y in range(5)], "gx int, gy int, v double")
    assert {r.v for r in bands.local_deviation(flat, ["v"], 1).collect()} == {0.0} and grid.circle(1) == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
