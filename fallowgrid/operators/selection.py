"""Choosing the number of zones, checking their stability, and the forest that tests a classification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats, zoning
from .sampling import order_key


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="_v").transform(df)


def _fit(df: DataFrame, columns: Sequence[str], k: int, seed: int) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="zone").fit(_vectors(df, columns))


def _zones(model: KMeansModel, df: DataFrame, columns: Sequence[str], name: str = "zone") -> DataFrame:
    return model.transform(_vectors(df, columns)).drop("_v").withColumnRenamed("zone", name)


def panel(df: DataFrame, columns: Sequence[str], ks: Sequence[int], seed: int = 42, references: int = 10) -> DataFrame:
    """(k, inertia, silhouette, davies_bouldin, gap, s_k), one row per k."""
    rows = []
    for k in ks:
        model = _fit(df, columns, k, seed)
        labelled = _zones(model, df, columns)
        gap, s = zoning.gap_statistic(df, columns, k, references, seed)
        rows.append((k, float(model.summary.trainingCost), zoning.silhouette(labelled, columns), zoning.davies_bouldin(labelled, columns), gap, s))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, davies_bouldin double, gap double, s_k double")


def _part(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    return df.where(order_key(F.col(key), seed) < int(share * 2_147_483_647))


def stability(df: DataFrame, key: str, columns: Sequence[str], k: int, fits: int = 20, share: float = 0.8, seed: int = 42) -> float:
    """Mean adjusted Rand index of all pairs of fits on parts of the rows, each labelling all rows.

    Rows are labelled by all fits in one scan, which tallies the contingencies of all pairs; fits^2 k^2 / 2 counters a task are what moves.
    """
    labelled = df
    for b in range(fits):
        labelled = _zones(_fit(_part(df, key, share, seed + b), columns, k, seed + b), labelled, columns, f"_z{b}")
    pairs = [(a, b) for a in range(fits) for b in range(a)]

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(pairs), k * k), np.int64)
        for batch in batches:
            z = batch.to_numpy(np.int64)
            for i, (a, b) in enumerate(pairs):
                total[i] += np.bincount(z[:, a] * k + z[:, b], minlength=k * k)
        i, cell = np.nonzero(total)
        yield pd.DataFrame({"pair": i, "cell": cell, "n": total[i, cell]})

    rows = labelled.select(*[f"_z{b}" for b in range(fits)]).mapInPandas(tally, "pair long, cell long, n long").groupBy("pair", "cell").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((len(pairs), k, k))
    for r in rows:
        table[r.pair, r.cell // k, r.cell % k] = r.n
    two = lambda x: x * (x - 1) / 2
    both, one, other, every = two(table).sum((1, 2)), two(table.sum(2)).sum(1), two(table.sum(1)).sum(1), two(table.sum((1, 2)))
    expected = one * other / np.maximum(every, 1)
    spread = (one + other) / 2 - expected
    known = spread != 0
    return float(((both - expected)[known] / spread[known]).mean()) if known.any() else float("nan")


def holdout(df: DataFrame, split: str, columns: Sequence[str], ks: Sequence[int], least: int = 50, seed: int = 42) -> DataFrame:
    """(k, silhouette, davies_bouldin, ari) on the unseen half (split 1): zones of the other half's fit, and their agreement with an own fit."""
    seen, unseen = df.where(F.col(split) == 0), df.where(F.col(split) == 1)
    n = df.groupBy(split).count().collect()
    if len([r for r in n if r[split] in (0, 1) and r["count"] >= least]) < 2:
        raise ValueError(f"each half needs at least {least} rows")
    rows = []
    for k in ks:
        labelled = _zones(_fit(seen, columns, k, seed), unseen, columns)
        both = _zones(_fit(unseen, columns, k, seed), labelled.withColumnRenamed("zone", "_given"), columns, "_own")
        ari = stats.adjusted_rand(both, "_given", "_own").first()["ari"]
        rows.append((k, zoning.silhouette(labelled, columns), zoning.davies_bouldin(labelled, columns), float(ari)))
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, davies_bouldin double, ari double")


def match_centroids(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, float]]:
    """(row of a, row of b, distance), in the order of a: the nearest pair of all first, then the nearest of what is left."""
    pairs = sorted((float(np.linalg.norm(x - y)), i, j) for i, x in enumerate(np.asarray(a)) for j, y in enumerate(np.asarray(b)))
    out: dict[int, tuple[int, float]] = {}
    for far, i, j in pairs:
        if i not in out and j not in {k for k, _ in out.values()}:
            out[i] = (j, far)
    return [(i, *out[i]) for i in sorted(out)]


def compare_samples(first: DataFrame, second: DataFrame, third: DataFrame, columns: Sequence[str], k: int, seed: int = 42) -> tuple[float, list[tuple[int, int, float]]]:
    """Two samples' fits: the agreement of their labels on a third sample, and their matched centres."""
    a, b = _fit(first, columns, k, seed), _fit(second, columns, k, seed)
    both = _zones(b, _zones(a, third, columns, "_a"), columns, "_b")
    return float(stats.adjusted_rand(both, "_a", "_b").first()["ari"]), match_centroids(np.array(a.clusterCenters()), np.array(b.clusterCenters()))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of all pairs of columns, from one aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    row = df.agg(*[F.corr(columns[i], columns[j]).alias(f"r{i}_{j}") for i, j in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"r{i}_{j}").alias("r")) for i, j in pairs])).alias("x")).select("x.*")


def inflation(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Variance inflation of each column against the others: the diagonal of the inverse correlation matrix."""
    m = np.eye(len(columns))
    for x in correlations(df, columns).collect():
        i, j = columns.index(x["a"]), columns.index(x["b"])
        m[i, j] = m[j, i] = x["r"]
    return dict(zip(columns, np.diag(np.linalg.inv(m)).tolist(), strict=True))


def redundant(df: DataFrame, candidate: str, incumbents: Sequence[str], threshold: float) -> DataFrame:
    """(nearest, max_abs_r, redundant): the incumbent most like the candidate, and whether that reaches the threshold."""
    r = correlations(df, [candidate, *incumbents]).where(F.col("a") == candidate).select("b", F.abs("r").alias("m"))
    return r.agg(F.max(F.struct("m", "b")).alias("x")).select(F.col("x.b").alias("nearest"), F.col("x.m").alias("max_abs_r"), (F.col("x.m") >= threshold).alias("redundant"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    m = np.eye(len(columns))
    for x in correlations(df, columns).collect():
        i, j = columns.index(x["a"]), columns.index(x["b"])
        m[i, j] = m[j, i] = x["r"]
    return m


def components(m: np.ndarray, names: Sequence[str], keep: float = 0.9) -> int:
    """Principal components that hold `keep` of the variance of theme-weighted standard scores with correlations m."""
    w = np.array(zoning.theme_weights(names))
    share = np.sort(np.linalg.eigvalsh(m * np.outer(w, w)))[::-1]
    return int(np.searchsorted(np.cumsum(share) / share.sum(), keep - 1e-12) + 1)


def probe_candidates(df: DataFrame, incumbents: Sequence[str], candidates: dict[str, bool], discarded: Sequence[tuple[str, str]], k: int, keep: float = 0.9, seed: int = 42) -> DataFrame:
    """(candidate, admissible, nearest, max_abs_r, redundant, inflation, components, components_with, new_component, ari, verdict), a row per candidate axis.

    Four gates in this order: whether the band may be an axis at all (`candidates` says so beforehand); whether it repeats an incumbent, by the least
    |r| of the pairs that were `discarded` as repeats; whether it adds a principal component; and how much it moves the partition: the adjusted
    Rand index of zones without it and with it, on the same rows.  All correlations come from one aggregation over rows without nulls, and
    the components of every set of bands are read off its part of that matrix; only the partitions need a fit each.
    """
    incumbents = list(incumbents)
    every = list(dict.fromkeys([*incumbents, *candidates, *(c for pair in discarded for c in pair)]))
    rows = zoning.zscored(df.dropna(subset=every), every)
    m = correlation_matrix(rows, every)
    at = {c: i for i, c in enumerate(every)}
    threshold = min((abs(m[at[a], at[b]]) for a, b in discarded), default=1.0)
    own = [at[c] for c in incumbents]
    before = components(m[np.ix_(own, own)], incumbents, keep)

    def weighted(names: Sequence[str], tag: str) -> tuple[DataFrame, list[str]]:
        w = zoning.theme_weights(names)
        return rows.withColumns({f"_{tag}{i}": F.col(c) * x for i, (c, x) in enumerate(zip(names, w, strict=True))}), [f"_{tag}{i}" for i in range(len(names))]

    base, columns = weighted(incumbents, "p")
    model, out = _fit(base, columns, k, seed), []
    for c, admissible in candidates.items():
        r = np.abs(m[at[c], own])
        sub = [*own, at[c]]
        after = components(m[np.ix_(sub, sub)], [*incumbents, c], keep)
        vif = float(np.linalg.pinv(m[np.ix_(sub, sub)])[-1, -1])
        more, wide = weighted([*incumbents, c], "q")
        both = _zones(_fit(more, wide, k, seed), more, wide, "_with").withColumns({x: F.col(b) * w for x, b, w in zip(columns, incumbents, zoning.theme_weights(incumbents), strict=True)})
        ari = stats.adjusted_rand(_zones(model, both, columns, "_without"), "_without", "_with").first()["ari"]
        redundant = bool(r.max() >= threshold)
        verdict = "not admissible" if not admissible else "redundant" if redundant else "no new component" if after <= before else "moves the partition" if ari < 1 else "no effect"
        out.append((c, bool(admissible), incumbents[int(r.argmax())], float(r.max()), redundant, vif, before, after, after > before, None if ari is None else float(ari), verdict))
    return df.sparkSession.createDataFrame(out, "candidate string, admissible boolean, nearest string, max_abs_r double, redundant boolean, inflation double, components int, components_with int, new_component boolean, ari double, verdict string")


def forest_kappa(df: DataFrame, features: Sequence[str], presence: str, given: str, train: str, trees: int = 100, cut: float = 0.5, seed: int = 42) -> DataFrame:
    """(kappa, n): a forest's classes (trained on rows where `train` is true, probability at least `cut`) against the given 0/1 class, on the other rows."""
    v = _vectors(df.withColumn("_y", F.col(presence).cast("double")), features)
    model = RandomForestClassifier(numTrees=trees, seed=seed, featuresCol="_v", labelCol="_y").fit(v.where(train))
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(v.where(f"NOT ({train})")).withColumn("_class", (vector_to_array("probability")[1] >= cut).cast("int"))
    return stats.kappa(scored, "_class", given)


def forest_folds(df: DataFrame, features: Sequence[str], presence: str, given: str, fold: str, k: int, trees: int = 200, seed: int = 42) -> DataFrame:
    """(fold, kappa, n): the same out of each fold of whole blocks."""
    out = None
    for f in range(k):
        one = forest_kappa(df, features, presence, given, f"{fold} <> {f}", trees, seed=seed).select(F.lit(f).alias("fold"), "kappa", "n")
        out = one if out is None else out.union(one)
    return out
