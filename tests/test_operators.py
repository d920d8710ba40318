import numpy as np
import pytest
from pyspark.sql import functions as F

from fallowgrid.functions.membership import aggregate, check_points, membership, suitability_class
from fallowgrid.operators import ahp, grid, sampling, stats, zoning
from fallowgrid.operators.suitability import perturbed_weights, zero_mask


@pytest.mark.parametrize(("shape", "points"), [("range", (1, 2, 3)), ("increasing", (2, 2)), ("range", (1, 3, 2, 4)), ("bell", (1, 2))])
def test_bad_points_are_refused(shape, points):
    with pytest.raises(ValueError):
        check_points(shape, points)


def test_membership_keeps_null_and_clamps(spark):
    df = spark.createDataFrame([(None,), (0.0,), (5.0,), (7.0,), (99.0,)], "x double")
    got = [r[0] for r in df.select(membership(F.col("x"), "range", (3, 5, 5, 9))).collect()]
    assert got == [None, 0.0, 1.0, 0.5, 0.0]


def test_class_breaks_are_inclusive(spark):
    df = spark.createDataFrame([(0.25,), (0.5,), (0.75,), (0.2,)], "s double")
    assert [r[0] for r in df.select(suitability_class(F.col("s"))).collect()] == [1, 2, 3, 0]


def test_unknown_names_are_refused():
    with pytest.raises(ValueError):
        aggregate("median", [], [])
    with pytest.raises(ValueError):
        zero_mask(None, "some")


def test_perturbed_weights_sum_to_one():
    for w in perturbed_weights([3, 1, 1]):
        assert sum(w) == pytest.approx(1)


def test_consistent_matrix_returns_its_weights():
    w, top = ahp.principal(np.array([[1, 2, 4], [0.5, 1, 2], [0.25, 0.5, 1]]))
    assert np.allclose(w, [4 / 7, 2 / 7, 1 / 7])
    assert top == pytest.approx(3)
    assert ahp.snap(2.9) == 3
    assert ahp.round_to_unit([1 / 3] * 3).sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        ahp.adapt([0.5, 0.5], [0, 0])


def test_revision_lowers_inconsistency():
    b = np.array([[0, 2, -2], [-2, 0, 2], [2, -2, 0]])
    with pytest.raises(ValueError):
        ahp.make_consistent(b, steps=1)


def test_distance_without_sources_is_null(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "gx int, gy int, s int")
    assert {r.d2 for r in grid.squared_distance(df, "s").collect()} == {None}


def test_balanced_halves(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 0, 3.0), (3, 0, 2.0), (4, 1, 1.0)], "b int, s int, a double")
    assert {r.b: r.half for r in sampling.balanced_halves(df, "b", "s", "a").collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ranks_over_many_ranges(spark, adaptive):
    """A million distinct values over 200 partitions: ranks, AUC and percentiles equal those of a plain sort."""
    for k, v in (("spark.sql.shuffle.partitions", "200"), ("spark.sql.adaptive.enabled", adaptive)):
        spark.conf.set(k, v)
    try:
        df = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_003).cast("double").alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 2).alias("g"))
        i = np.arange(1_000_000)
        s, y, g = (i * 7919) % 1_000_003, i % 3 == 0, i % 2
        for name, want in ((None, slice(None)), (0, g == 0)):
            d = df if name is None else df.where(f"g = {name}")
            rank = np.empty(len(s[want]))
            rank[np.argsort(s[want])] = np.arange(1, len(rank) + 1)
            p = y[want].sum()
            auc = (rank[y[want]].sum() - p * (p + 1) / 2) / (p * (len(rank) - p))
            assert stats.auc(d, "s", "y").first()["auc"] == pytest.approx(auc, abs=1e-12)
        got = {r.g: (r.p0, r.p1) for r in stats.percentiles(df, "s", [0.1, 0.5], ["g"]).collect()}
        assert all(got[k] == pytest.approx(np.percentile(s[g == k], [10, 50])) for k in (0, 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_fits_equal_plain_ones(spark):
    """Principal shares against the covariance's eigenvalues; zones against their centres."""
    r = np.random.default_rng(2)
    x = r.normal(0, [3, 1, 0.5], (400, 3)) + r.choice([0, 12], (400, 1))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double")
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(zoning.fit_pca(df, ["a", "b", "c"])[2], values / values.sum())
    labelled, centres = zoning.fit_kmeans(df, ["a", "b", "c"], 2, "a", restarts=2)
    zone = np.array([z.zone for z in labelled.orderBy("id").collect()])
    assert (zone == ((x[:, None] - np.array(centres)[None]) ** 2).sum(2).argmin(1)).all()
    assert np.allclose(centres, [x[zone == k].mean(0) for k in (0, 1)]) and centres[0][0] > centres[1][0]
