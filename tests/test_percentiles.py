"""Exact percentiles from sketches and ranks of what lies between."""

import numpy as np
import pytest

from fallowgrid.operators import stats

SHARES = [0, 0.05, 0.25, 0.5, 0.9, 0.999, 1]


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "few"])
@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_percentiles_equal_numpy(spark, kind, accuracy):
    r = np.random.default_rng(6)
    draw = {"normal": lambda n: r.normal(size=n), "ties": lambda n: r.choice([1.0, 2.0, 2.0, 2.0, 7.5], n), "heavy": lambda n: np.exp(r.normal(size=n) * 8), "few": lambda n: r.normal(size=3)}[kind]
    groups = {"a": draw(4000), "b": draw(1), "c": draw(333), None: draw(50)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: list(r)[1:] for r in stats.percentiles(df, "v", SHARES, ["g"], accuracy).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        assert got[g] == pytest.approx(np.quantile(x, SHARES).tolist(), rel=1e-12)
    whole = np.concatenate(list(groups.values()))
    assert list(stats.percentiles(df, "v", SHARES, (), accuracy).first()) == pytest.approx(np.quantile(whole, SHARES).tolist(), rel=1e-12)


def test_only_what_lies_between_is_ranked(spark, monkeypatch):
    """Of 200,000 different values a few hundred reach the ranking."""
    seen = []
    plain = stats._cumulated
    monkeypatch.setattr(stats, "_cumulated", lambda counts, by, value, n="n": seen.append(counts.count()) or plain(counts, by, value, n))
    df = spark.range(200_000).selectExpr("CAST(id * 7919 % 200003 AS DOUBLE) AS v")
    want = np.quantile(np.arange(200_000) * 7919 % 200_003, [0.1, 0.5])
    assert list(stats.percentiles(df, "v", [0.1, 0.5]).first()) == pytest.approx(want.tolist())
    assert seen[0] < 1000
