"""Decorrelation and clustering, with reproducible zone labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.membership import argmax_index
from .sampling import order_key


def theme_weights(columns: Sequence[str]) -> list[float]:
    """1 / sqrt(bands of the theme), the theme being the prefix up to the first underscore."""
    themes = [c.split("_")[0] for c in columns]
    return [1 / themes.count(t) ** 0.5 for t in themes]


def zscored(df: DataFrame, columns: Sequence[str], floor: float = 1e-9) -> DataFrame:
    stats = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("_m", F.avg), ("_s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"_m{i}")) / F.greatest(F.col(f"_s{i}"), F.lit(floor)) for i, c in enumerate(columns)}).drop(*[f"{n}{i}" for i in range(len(columns)) for n in ("_m", "_s")])


def scores(vector: Sequence[Column], loadings: Sequence[Sequence[float]], means: Sequence[float]) -> list[Column]:
    """Principal scores as linear expressions of literals."""
    return [sum(((x - F.lit(m)) * F.lit(a) for x, m, a in zip(vector, means, row, strict=True)), F.lit(0.0)) for row in loadings]


def nearest(vector: Sequence[Column], centroids: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest centroid, the first of equals."""
    return argmax_index([-sum(((x - F.lit(c)) * (x - F.lit(c)) for x, c in zip(vector, row, strict=True)), F.lit(0.0)) for row in centroids])


def fit_pca(df: DataFrame, columns: Sequence[str], keep: float = 0.9) -> tuple[np.ndarray, list[float], list[float]]:
    """(loadings, means, explained shares) of the fewest components that hold `keep` of the variance; centred first."""
    v = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(df)
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v)
    model = PCA(k=len(columns), inputCol="_c", outputCol="_p").fit(scaler.transform(v))
    share = model.explainedVariance.toArray()
    n = int(np.searchsorted(np.cumsum(share), keep) + 1)
    return model.pc.toArray().T[: min(n, len(share))], list(scaler.mean), share.tolist()


def fit_kmeans(df: DataFrame, columns: Sequence[str], k: int, order_by: str, restarts: int = 10, seed: int = 42) -> tuple[DataFrame, list[list[float]]]:
    """Best of `restarts` fits by cost; zones 0.. in descending mean of `order_by`."""
    v = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(df).cache()
    models = [KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="_z").fit(v) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    v.unpersist()
    labelled = best.transform(v)
    rank = [r["_z"] for r in labelled.groupBy("_z").agg(F.avg(order_by).alias("m")).orderBy(F.desc("m"), "_z").collect()]
    zone = F.array_position(F.array(*[F.lit(z) for z in rank]), F.col("_z")) - 1
    return labelled.withColumn("zone", zone.cast("int")).drop("_v", "_z"), [best.clusterCenters()[z].tolist() for z in rank]


def silhouette(df: DataFrame, columns: Sequence[str], zone: str = "zone", most: int = 5000, key: str | None = None, seed: int = 42) -> float:
    """Mean silhouette by Euclidean distance in the space of `columns`, which needn't be the one that was clustered.

    Over all rows up to `most`, else over a sample of that size (by hashes of `key`, or of the columns).  Every row needs its distances to all
    others, so the sample, `most` rows at the highest, goes to the tasks, which work block by block.  Rows with a null are left out; a row
    alone in its zone has 0; fewer than two zones give nan.
    """
    d = df.select(F.col(zone).alias("_zone"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)], order_key(F.col(key) if key else F.xxhash64(*columns), seed).alias("_order")).dropna()
    sample = d.orderBy("_order", *[f"_{i}" for i in range(len(columns))]).limit(most).drop("_order").toPandas()
    codes, names = pd.factorize(sample["_zone"])
    if len(names) < 2:
        return float("nan")
    x = sample.drop(columns="_zone").to_numpy(float)
    member = (codes[:, None] == np.arange(len(names))[None]).astype(float)
    size = member.sum(0)

    def widths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = 0.0
            for at in np.array_split(batch["id"].to_numpy(), -(-len(batch) // 256)):
                far = np.sqrt(np.maximum(((x[at][:, None] - x[None]) ** 2).sum(2), 0)) @ member
                own = codes[at]
                alone = size[own] < 2
                inner = far[np.arange(len(at)), own] / np.maximum(size[own] - 1, 1)
                mean = far / size
                mean[np.arange(len(at)), own] = np.inf
                outer = mean.min(1)
                total += float(np.where(alone, 0.0, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300)).sum())
            yield pd.DataFrame({"total": [total]})

    got = df.sparkSession.range(0, len(x), 1, max(1, len(x) // 512)).mapInPandas(widths, "total double").agg(F.sum("total")).first()[0]
    return float(got / len(x))


def davies_bouldin(df: DataFrame, columns: Sequence[str], zone: str = "zone") -> float:
    """Mean over zones of the worst (spread + spread) / distance; only k rows reach the driver."""
    c = df.groupBy(zone).agg(*[F.avg(x).alias(f"c{i}") for i, x in enumerate(columns)])
    d = df.join(F.broadcast(c), zone).withColumn("_d", F.sqrt(sum(((F.col(x) - F.col(f"c{i}")) ** 2 for i, x in enumerate(columns)), F.lit(0.0))))
    rows = d.groupBy(zone).agg(F.avg("_d").alias("s"), *[F.first(f"c{i}").alias(f"c{i}") for i in range(len(columns))]).collect()
    s, x = np.array([r["s"] for r in rows]), np.array([[r[f"c{i}"] for i in range(len(columns))] for r in rows])
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    return float(((s[:, None] + s[None]) / gap).max(1).mean())


def gap_statistic(df: DataFrame, columns: Sequence[str], k: int, references: int = 10, seed: int = 42) -> tuple[float, float]:
    """(gap, s_k) against uniform references over the columns' ranges."""
    def dispersion(x: DataFrame) -> float:
        v = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(x)
        return float(np.log(max(KMeans(k=k, seed=seed, featuresCol="_v").fit(v).summary.trainingCost, 1e-12)))

    box = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))]).first()
    spark, ref = df.sparkSession, []
    for r in range(references):
        u = spark.range(box["n"]).select(*[(F.rand(seed + 100 * r + i) * (box[f"b{i}"] - box[f"a{i}"]) + box[f"a{i}"]).alias(c) for i, c in enumerate(columns)])
        ref.append(dispersion(u))
    return float(np.mean(ref) - dispersion(df)), float(np.std(ref) * (1 + 1 / references) ** 0.5)


def profile(df: DataFrame, zone: str, bands: Sequence[str], segments: Sequence[str], top: int = 3) -> DataFrame:
    """Per zone (1-based): rows, band means, dominant segment, its comparative first and second with margin, top bands by |z|."""
    z = zscored(df.withColumns({f"_z_{c}": F.col(c).cast("double") for c in (*bands, *segments)}), [f"_z_{c}" for c in (*bands, *segments)])
    g = z.groupBy((F.col(zone) + 1).alias("zone")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in (*bands, *segments)], *[F.avg(f"_z_{c}").alias(f"_z_{c}") for c in (*bands, *segments)])
    ranked = lambda names, value: F.sort_array(F.array(*[F.struct(-value(c), F.lit(i).alias("i"), F.lit(c).alias("name"), value(c).alias("v")) for i, c in enumerate(names)]))
    seg, absolute, features = ranked(segments, lambda c: F.col(f"_z_{c}")), ranked(segments, lambda c: F.col(c)), ranked(bands, lambda c: F.abs(F.col(f"_z_{c}")))
    return g.select("zone", "n", *[F.col(c) for c in (*bands, *segments)], absolute[0]["name"].alias("dominant"), seg[0]["name"].alias("comparative"), seg[1]["name"].alias("comparative_2"), F.round(seg[0]["v"] - seg[1]["v"], 4).alias("margin"), F.concat_ws(", ", F.transform(F.slice(features, 1, top), lambda x: x["name"])).alias("top_features"))


def relabel(df: DataFrame, zone: str, value: str) -> DataFrame:
    """Zones renumbered 1.. by descending group mean."""
    m = df.groupBy(zone).agg(F.avg(value).alias("_m"))
    r = m.withColumn("canonical", F.dense_rank().over(Window.orderBy(F.desc("_m"), zone)).cast("int")).drop("_m")
    return df.join(F.broadcast(r), zone)


def embedding_columns(n: int, column: str = "embedding") -> list[Column]:
    return [F.col(column)[i].cast("double") for i in range(n)]




def compare_spaces(df: DataFrame, spaces: dict[str, tuple[Sequence[str], bool]], zone: str, keep: float = 0.9, most: int = 3000, key: str | None = None) -> DataFrame:
    """(space, component, share, low, high, needed, silhouette): how given zones separate on the first three components of several sets of bands.

    A space is (columns, whether bands weigh 1 / sqrt(bands of their theme)); `low` and `high` are the 2nd and 98th percentiles of the scores,
    `needed` the components that hold `keep` of the variance, and the silhouette that of `zone` on the three scores.
    """
    out = None
    for name, (columns, themed) in spaces.items():
        weights = theme_weights(columns) if themed else [1.0] * len(columns)
        scaled = df.select(zone, *([key] if key else []), *[(F.col(c) * w).alias(f"_w{i}") for i, (c, w) in enumerate(zip(columns, weights, strict=True))])
        own = [f"_w{i}" for i in range(len(columns))]
        loadings, means, share = fit_pca(scaled, own, 1.0)
        n = min(3, len(loadings))
        scored = scaled.select(zone, *([key] if key else []), *[c.alias(f"_pc{i}") for i, c in enumerate(scores([F.col(c) for c in own], loadings[:n], means))])
        needed = int(np.searchsorted(np.cumsum(share), keep) + 1)
        width = silhouette(scored, [f"_pc{i}" for i in range(n)], zone, most, key)
        ends = scored.agg(*[F.percentile(f"_pc{i}", q).alias(f"{end}{i}") for i in range(n) for end, q in (("a", 0.02), ("b", 0.98))])
        rows = ends.select(F.explode(F.array(*[F.struct(F.lit(name).alias("space"), F.lit(i + 1).alias("component"), F.lit(float(share[i])).alias("share"), F.col(f"a{i}").alias("low"), F.col(f"b{i}").alias("high"), F.lit(needed).alias("needed"), F.lit(width).alias("silhouette")) for i in range(n)])).alias("r")).select("r.*")
        out = rows if out is None else out.union(rows)
    return out
