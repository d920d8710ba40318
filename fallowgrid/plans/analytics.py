"""Queries of climatology, projection, grids, statistics, zoning, sampling and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.membership import haversine_km
from ..operators import climate, grid, reports, sampling, stats, zoning
from ..sources.tables import between, table
from ..streaming.climatology import window_means


def _months(spark, d):
    x = between(table(spark, d, "lineitem"), "l_shipdate", "1995-01-01", "2002-01-01")
    return climate.monthly(x, ["l_suppkey"], "l_shipdate", {"pr": F.col("l_quantity"), "pet": F.col("l_extendedprice") / 1000, "t": 20 * F.col("l_discount") / 0.1 + 5})


MONTHS = "m AS (SELECT l_suppkey, month(l_shipdate)::INT AS month, avg(l_quantity) AS pr, avg(l_extendedprice / 1000) AS pet, avg(20 * l_discount / 0.1 + 5) AS t FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '2002-01-01' GROUP BY 1, 2)"


def monthly_climatology(spark, d):
    return _months(spark, d).select("l_suppkey", "month", *[F.round(c, 9).alias(c) for c in ("pr", "pet", "t")])


def climate_bands(spark, d):
    b = climate.climate_bands(_months(spark, d), ["l_suppkey"], "pr", "pet", "t", dry=25.0)
    return b.select("l_suppkey", F.col("dry_months"), *[F.round(c, 6).alias(c) for c in ("pr_annual", "pet_annual", "pr_cv", "pr_wet", "aridity", "gdd", "warm_quarter", "cold_quarter")]).where("warm_quarter IS NOT NULL")


def change_factors(spark, d):
    x = table(spark, d, "lineitem").withColumn("month", F.month("l_shipdate"))
    values = {"pr": F.col("l_quantity"), "tx": F.col("l_discount") * 300}
    agg = lambda y: y.groupBy(F.col("l_returnflag").alias("model"), "month").agg(*[F.avg(v).alias(k) for k, v in values.items()])
    f = climate.change_factors(agg(x.where(F.year("l_shipdate") <= 1997)), agg(x.where(F.year("l_shipdate") > 1997)), ["model", "month"], ["pr"], ["tx"])
    e = climate.ensemble(f, ["month"], ["ratio_pr", "delta_tx"])
    return e.select("month", *[F.round(c, 7).alias(c) for c in ("ratio_pr", "delta_tx")])


def future_months(spark, d):
    x = table(spark, d, "lineitem").withColumn("month", F.month("l_shipdate"))
    values = {"pr": F.col("l_quantity"), "pet": F.col("l_extendedprice") / 1000, "tmmx": F.col("l_discount") * 300, "tmmn": F.col("l_tax") * 100}
    agg = lambda y: y.groupBy("month").agg(*[F.avg(v).alias(k) for k, v in values.items()])
    past = agg(x.where(F.year("l_shipdate") <= 1997))
    f = climate.change_factors(past, agg(x.where(F.year("l_shipdate") > 1997)), ["month"], ["pr"], ["tmmx", "tmmn"])
    return climate.apply_factors(past, f, ["month"]).select("month", *[F.round(c, 6).alias(c) for c in ("pr", "pet", "tmmx", "tmmn")])


def delta_and_agreement(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg((F.avg(F.when(F.year("l_shipdate") > 1997, F.col("l_quantity"))) - F.avg(F.when(F.year("l_shipdate") <= 1997, F.col("l_quantity")))).alias("delta")).where("delta IS NOT NULL")
    return climate.agreement(x, ["l_suppkey"], "delta").select("l_suppkey", F.round("ensemble", 7).alias("ensemble"), F.round("agreement", 6).alias("agreement"))


def zonal_mean(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    bridge = n.select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    return reports.zonal_means(s, bridge, "s_nationkey", ["n_name", "r_name"], {"bal": F.col("s_acctbal")}).withColumn("bal", F.round("bal", 6))


def zone_area_share(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return reports.area_shares(o, ["c_nationkey"], "o_totalprice").select("c_nationkey", F.round("area", 2).alias("area"), F.round("share_pct", 6).alias("share_pct"))


def percentile_table(spark, d):
    x = sampling.halves(table(spark, d, "lineitem").withColumn("split", F.pmod("l_orderkey", F.lit(2)).cast("int")), "split")
    ps = (5, 10, 25, 50, 75, 90, 95)
    g = stats.percentiles(x, "l_extendedprice", [p / 100 for p in ps], ["l_linestatus", "half"])
    return g.select("l_linestatus", "half", *[F.round(f"p{i}", 6).alias(f"p{p}") for i, p in enumerate(ps)])


def role_mode(spark, d):
    return grid.majority(table(spark, d, "events"), ["user_id"], "event_type")


def spearman(spark, d):
    return stats.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", F.round("rho", 7).alias("rho"), "n")


def auc_rank(spark, d):
    x = table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return stats.auc(x, "l_quantity", "y").select(F.round("auc", 7).alias("auc"), "n_pos", "n_neg")


def block_auc(spark, d):
    x = table(spark, d, "lineitem").withColumn("y", (F.col("l_discount") > 0.05).cast("int")).withColumn("block", F.floor(F.col("l_suppkey") / 10).cast("int"))
    b = stats.auc(x, "l_extendedprice", "y", ["block"]).where("n_pos >= 5 AND n_neg >= 5")
    return b.agg(F.count("*").alias("blocks"), F.round(F.avg("auc"), 7).alias("mean_auc"), F.round(F.stddev_pop("auc"), 7).alias("sd_auc"))


def kappa(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("a"), (F.col("l_extendedprice") > 35000).cast("int").alias("b"))
    return stats.kappa(x, "a", "b").select(F.round("kappa", 8).alias("kappa"), "n")


def anova_f(spark, d):
    return stats.anova(table(spark, d, "orders"), "o_totalprice", "o_orderpriority").select(F.round("f", 6).alias("f"), "n", "k")


def boyce(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return stats.boyce(x, "s", "y").select(F.round("centre", 6).alias("centre"), F.round("pe", 6).alias("pe"))


def quantile_gradient(spark, d):
    x = stats.quantile_bins(table(spark, d, "lineitem"), "l_extendedprice", 5)
    return x.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_q"))


def ari_contingency(spark, d):
    return stats.adjusted_rand(table(spark, d, "embeddings").withColumn("other", F.pmod("vec_id", F.lit(7))), "label", "other").select(F.round("ari", 9).alias("ari"))


def variogram(spark, d):
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("embedding")[2].cast("double").alias("v"))
    return stats.variogram(p, "v", 8, 0.4).select("bin", F.round("lag", 6).alias("lag"), F.round("gamma", 6).alias("gamma"), "n")


_C = [[0.05 * ((i * 7 + j * 3) % 5 - 2) for j in range(6)] for i in range(4)]


def nearest_centroid(spark, d):
    return table(spark, d, "embeddings").select("vec_id", zoning.nearest(zoning.embedding_columns(6), _C).alias("zone"))


def pc_scores(spark, d):
    s = zoning.scores(zoning.embedding_columns(6), _C[:2], [0.01] * 6)
    return table(spark, d, "embeddings").select("vec_id", *[F.round(x, 8).alias(f"pc{i}") for i, x in enumerate(s, 1)])


def zone_profile(spark, d):
    x = table(spark, d, "embeddings").select("label", *[c.alias(f"b{i}") for i, c in enumerate(zoning.embedding_columns(4))], *[F.col("embedding")[i].cast("double").alias(f"s{i}") for i in (4, 5, 6)])
    p = zoning.profile(x, "label", [f"b{i}" for i in range(4)], ["s4", "s5", "s6"])
    return p.select(F.col("zone").cast("int").alias("zone"), "n", *[F.round(f"b{i}", 7).alias(f"b{i}") for i in range(4)], "dominant", "comparative", "comparative_2", F.round("margin", 4).alias("margin"))


def _ordinal_sql() -> str:
    cols = ", ".join(f"avg(e{i}) AS m{i}, stddev_pop(e{i}) AS s{i}" for i in (4, 5, 6))
    z = {i: f"avg((e{i} - m{i}) / greatest(s{i}, 1e-9))" for i in (4, 5, 6)}
    e = ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(7))
    return f"""WITH x AS (SELECT label, {e} FROM embeddings), t AS (SELECT {cols} FROM x),
g AS (SELECT label + 1 AS zone, count(*) AS n, {', '.join(f'avg(e{i}) AS b{i}' for i in range(7))}, {', '.join(f'{z[i]} AS z{i}' for i in z)} FROM x, t GROUP BY 1),
u AS (SELECT zone, unnest(['s4', 's5', 's6']) AS name, unnest([b4, b5, b6]) AS v, unnest([z4, z5, z6]) AS z FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY v DESC, name) AS rv, row_number() OVER (PARTITION BY zone ORDER BY z DESC, name) AS rz FROM u)
SELECT g.zone::INT AS zone, n, {', '.join(f'round(b{i}, 7) AS b{i}' for i in range(4))}, a.name AS dominant, b.name AS comparative, c.name AS comparative_2, round(b.z - c.z, 4) AS margin
FROM g JOIN r a ON a.zone = g.zone AND a.rv = 1 JOIN r b ON b.zone = g.zone AND b.rz = 1 JOIN r c ON c.zone = g.zone AND c.rz = 2"""


def strat_sample(spark, d):
    o = table(spark, d, "orders")
    return sampling.stratified_sample(o, ["o_orderpriority", "o_orderstatus"], "o_orderkey", 5).select("o_orderkey", "o_orderpriority", "o_orderstatus")


def uniform_sample(spark, d):
    return sampling.uniform_sample(table(spark, d, "customer"), "c_custkey", 50).select("c_custkey", "c_name")


def block_folds(spark, d):
    return sampling.folds(table(spark, d, "customer"), "c_nationkey", 5).groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("blocks"))


_O = "(((k * 48271 + 42 * 16807 + 11) % 2147483647) * 69621 + k) % 2147483647"


def grid_strata(spark, d):
    e = table(spark, d, "embeddings")
    g = grid.grid_id(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), (-0.3, -0.3, 0.3, 0.3), 8)
    return e.groupBy(g.alias("strat")).agg(F.count("*").alias("n"))


def one_to_one_join_gap(spark, d):
    return reports.one_to_one(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


def topk_opportunity(spark, d):
    return reports.top_k(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), 10, [F.desc("c_acctbal"), F.asc("c_custkey")])


def unpivot_regex(spark, d):
    w = table(spark, d, "part").agg(F.avg("p_size").alias("rough_size_r250"), F.avg("p_retailprice").alias("rough_price_r750"), F.stddev_pop("p_retailprice").alias("rough_price_r4750"))
    u = w.unpivot([], list(w.columns), "name", "value")
    return u.select(F.regexp_extract("name", "rough_(.+)_r([0-9]+)", 1).alias("grp"), F.regexp_extract("name", "rough_(.+)_r([0-9]+)", 2).cast("int").alias("radius"), F.round("value", 6).alias("value"))


def _grid(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 48).cast("int").alias("gx"), (F.col("l_partkey") % 48).cast("int").alias("gy")).agg(F.avg("l_quantity").alias("v"), F.max((F.col("l_quantity") > 49).cast("int")).alias("src"))


GRID = "c AS (SELECT (l_orderkey % 48)::INT AS gx, (l_partkey % 48)::INT AS gy, avg(l_quantity) AS v, max((l_quantity > 49)::INT) AS src FROM lineitem GROUP BY 1, 2)"


def focal_stats(spark, d):
    f = grid.focal(_grid(spark, d).select("gx", "gy", "v"), 2, {"mean": F.avg("v"), "sd": F.stddev_pop("v"), "n": F.count("v")})
    return f.select("gx", "gy", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


def distance_transform(spark, d):
    return grid.squared_distance(_grid(spark, d), "src")


def bilinear(spark, d):
    fine = _grid(spark, d)
    coarse = grid.coarsen(fine, 8, {"v": F.avg("v")}).select(F.col("cx").alias("gx"), F.col("cy").alias("gy"), "v")
    return grid.bilinear(fine, coarse, 8, "v").select("gx", "gy", F.round("v", 7).alias("v"))


def slope_gradient(spark, d):
    return grid.gradient(_grid(spark, d), "v", 10.0).select("gx", "gy", F.round("slope", 6).alias("slope"))


def haversine(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(haversine_km(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), F.col("embedding")[2].cast("double"), F.col("embedding")[3].cast("double")), 5).alias("km"))


def regression_diff(spark, d):
    a = table(spark, d, "part").select("p_partkey", F.col("p_retailprice"), F.col("p_size").cast("double").alias("p_size"))
    b = a.withColumn("p_retailprice", F.col("p_retailprice") + F.when(F.col("p_partkey") % 100 == 0, 0.5).otherwise(0.0))
    return reports.difference(a, b, "p_partkey", ["p_retailprice", "p_size"]).select("column", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"), "changed")


def zscore_columns(spark, d):
    return zoning.zscored(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"]).select("p_partkey", F.round("p_size", 7).alias("p_size"), F.round("p_retailprice", 7).alias("p_retailprice"))


def window_climatology(spark, d):
    return window_means(table(spark, d, "events"), "ts", "value", "event_type", "5 days").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 5).alias("total"))


def canonical_zones(spark, d):
    x = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("v"))
    return zoning.relabel(x, "label", "v").groupBy("label", "canonical").agg(F.count("*").alias("n"))


def kmeans_fit(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", *[c.alias(f"e{i}") for i, c in enumerate(zoning.embedding_columns(6))])
    labelled, _ = zoning.fit_kmeans(x, [f"e{i}" for i in range(6)], 4, "e0", restarts=2)
    return labelled.select("vec_id", "zone")


def pca_fit(spark, d):
    x = table(spark, d, "embeddings").select(*[c.alias(f"e{i}") for i, c in enumerate(zoning.embedding_columns(6))])
    _, _, share = zoning.fit_pca(x, [f"e{i}" for i in range(6)])
    return spark.range(len(share)).select((F.col("id") + 1).alias("component"), F.array(*[F.lit(float(s)) for s in share])[F.col("id").cast("int")].alias("share"))


_E = ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(6))
_D = [" + ".join(f"(e{j} - ({c}))^2" for j, c in enumerate(row)) for row in _C]
_QUARTER = ", ".join(f"(t{i} + t{i % 12 + 1} + t{(i + 1) % 12 + 1}) / 3" for i in range(1, 13))
QUERIES = {
    "monthly_climatology": (monthly_climatology, f"WITH {MONTHS} SELECT l_suppkey, month, round(pr, 9) AS pr, round(pet, 9) AS pet, round(t, 9) AS t FROM m"),
    "climate_bands": (climate_bands, f"WITH {MONTHS}, a AS (SELECT l_suppkey, avg(pr) AS mean FROM m GROUP BY 1), b AS (SELECT m.l_suppkey, sum((pr < 25)::INT)::BIGINT AS dry_months, sum(pr) AS pr_annual, sum(pet) AS pet_annual, stddev_pop(pr) / greatest(avg(pr), 0.001) AS pr_cv, sum(CASE WHEN pr >= mean THEN pr ELSE 0 END) AS pr_wet, sum(greatest(t - 10, 0) * 30.4) AS gdd, {', '.join(f'max(t) FILTER (month = {i}) AS t{i}' for i in range(1, 13))}, count(*) AS n FROM m JOIN a USING (l_suppkey) GROUP BY 1) SELECT l_suppkey, dry_months, round(pr_annual, 6) AS pr_annual, round(pet_annual, 6) AS pet_annual, round(pr_cv, 6) AS pr_cv, round(pr_wet, 6) AS pr_wet, round(pr_annual / greatest(pet_annual, 0.001), 6) AS aridity, round(gdd, 6) AS gdd, round(greatest({_QUARTER}), 6) AS warm_quarter, round(least({_QUARTER}), 6) AS cold_quarter FROM b"),
    "change_factors": (change_factors, "WITH a AS (SELECT l_returnflag AS model, month(l_shipdate)::INT AS month, avg(l_quantity) FILTER (year(l_shipdate) <= 1997) AS p, avg(l_quantity) FILTER (year(l_shipdate) > 1997) AS f, avg(l_discount * 300) FILTER (year(l_shipdate) <= 1997) AS tp, avg(l_discount * 300) FILTER (year(l_shipdate) > 1997) AS tf FROM lineitem GROUP BY 1, 2) SELECT month, round(avg(f / greatest(p, 1e-6)), 7) AS ratio_pr, round(avg(tf - tp), 7) AS delta_tx FROM a GROUP BY 1"),
    "future_months": (future_months, "WITH a AS (SELECT month(l_shipdate)::INT AS month, " + ", ".join(f"avg({e}) FILTER (year(l_shipdate) {op} 1997) AS {k}{n}" for k, e in (("pr", "l_quantity"), ("pet", "l_extendedprice / 1000"), ("x", "l_discount * 300"), ("n", "l_tax * 100")) for n, op in (("b", "<="), ("f", ">"))) + " FROM lineitem GROUP BY 1) SELECT month, round(prb * prf / greatest(prb, 1e-6), 6) AS pr, round(petb * ((xf + nf) / 2 + 17.8) / ((xb + nb) / 2 + 17.8) * sqrt(greatest(xf - nf, 0.1) / greatest(xb - nb, 0.1)), 6) AS pet, round(xf, 6) AS tmmx, round(nf, 6) AS tmmn FROM a"),
    "delta_and_agreement": (delta_and_agreement, "WITH x AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) FILTER (year(l_shipdate) > 1997) - avg(l_quantity) FILTER (year(l_shipdate) <= 1997) AS delta FROM lineitem GROUP BY 1, 2), e AS (SELECT l_suppkey, avg(delta) AS ens FROM x WHERE delta IS NOT NULL GROUP BY 1) SELECT x.l_suppkey, round(ens, 7) AS ensemble, round(avg(((delta > 0) = (ens > 0))::INT), 6) AS agreement FROM x JOIN e ON x.l_suppkey = e.l_suppkey WHERE delta IS NOT NULL GROUP BY 1, ens"),
    "zonal_mean": (zonal_mean, "SELECT n_name, r_name, round(avg(s_acctbal), 6) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "zone_area_share": (zone_area_share, "WITH g AS (SELECT c_nationkey, sum(o_totalprice) AS area FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT c_nationkey, round(area, 2) AS area, round(100.0 * area / (SELECT sum(area) FROM g), 6) AS share_pct FROM g"),
    "percentile_table": (percentile_table, "WITH x AS (SELECT l_linestatus, CASE WHEN l_orderkey % 2 = 0 THEN 'calib' ELSE 'val' END AS half, l_extendedprice AS v FROM lineitem UNION ALL SELECT l_linestatus, 'full', l_extendedprice FROM lineitem) SELECT l_linestatus, half, " + ", ".join(f"round(quantile_cont(v, {p / 100}), 6) AS p{p}" for p in (5, 10, 25, 50, 75, 90, 95)) + " FROM x GROUP BY 1, 2"),
    "role_mode": (role_mode, "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) WHERE r = 1"),
    "spearman": (spearman, "WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 7) AS rho, count(*) AS n FROM r GROUP BY 1"),
    "auc_rank": (auc_rank, "WITH r AS (SELECT l_returnflag = 'R' AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rk FROM lineitem) SELECT round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)::DOUBLE), 7) AS auc, count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg FROM r"),
    "block_auc": (block_auc, "WITH r AS (SELECT l_suppkey // 10 AS block, l_discount > 0.05 AS y, rank() OVER (PARTITION BY l_suppkey // 10 ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey // 10, l_extendedprice) - 1) / 2.0 AS rk FROM lineitem), b AS (SELECT block, (sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)::DOUBLE) AS auc, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM r GROUP BY 1) SELECT count(*) AS blocks, round(avg(auc), 7) AS mean_auc, round(stddev_pop(auc), 7) AS sd_auc FROM b WHERE p >= 5 AND q >= 5"),
    "kappa": (kappa, "WITH x AS (SELECT l_quantity > 25 AS a, l_extendedprice > 35000 AS b FROM lineitem), t AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg(a::INT) * avg(b::INT) + (1 - avg(a::INT)) * (1 - avg(b::INT)) AS pe FROM x) SELECT round((po - pe) / (1 - pe), 8) AS kappa, n FROM t"),
    "anova_f": (anova_f, "WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean FROM g) SELECT round((sum(g.n * (m - mean) ^ 2) / (any_value(k) - 1)) / (sum(g.n * v) / (any_value(t.n) - any_value(k))), 6) AS f, any_value(t.n)::BIGINT AS n, any_value(k) AS k FROM g, t"),
    "boyce": (boyce, "WITH x AS (SELECT l_quantity / 50 AS s, (l_returnflag = 'R')::INT AS y FROM lineitem), c AS (SELECT 0.05 + i * 0.9 / 9 AS centre FROM range(10) t(i)), w AS (SELECT centre, count(*) AS b, sum(y) AS q FROM c JOIN x ON s >= centre - 0.05 AND s <= centre + 0.05 GROUP BY 1) SELECT round(centre, 6)::DOUBLE AS centre, round((q / (SELECT sum(y) FROM x)) / (b / (SELECT count(*) FROM x)), 6) AS pe FROM w"),
    "quantile_gradient": (quantile_gradient, "WITH e AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM lineitem) SELECT ((l_extendedprice > e[1])::INT + (l_extendedprice > e[2])::INT + (l_extendedprice > e[3])::INT + (l_extendedprice > e[4])::INT)::INT AS bin, count(*) AS n, round(avg(l_quantity), 6) AS mean_q FROM lineitem, e GROUP BY 1"),
    "ari_contingency": (ari_contingency, "WITH c AS (SELECT label AS a, vec_id % 7 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), ij AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS n FROM c), i AS (SELECT sum(m * (m - 1) / 2) AS y FROM (SELECT sum(n) AS m FROM c GROUP BY a)), j AS (SELECT sum(m * (m - 1) / 2) AS z FROM (SELECT sum(n) AS m FROM c GROUP BY b)) SELECT round((x - y * z / (n * (n - 1) / 2)) / ((y + z) / 2 - y * z / (n * (n - 1) / 2)), 9) AS ari FROM ij, i, j"),
    "variogram": (variogram, "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS v FROM embeddings), d AS (SELECT sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS dist, (a.v - b.v) ^ 2 AS g FROM p a JOIN p b ON a.id < b.id) SELECT least(floor(dist / (0.4 / 8)), 7)::INT AS bin, round(avg(dist), 6) AS lag, round(avg(g) / 2, 6) AS gamma, count(*) AS n FROM d WHERE dist <= 0.4 GROUP BY 1"),
    "nearest_centroid": (nearest_centroid, f"WITH x AS (SELECT vec_id, {_E} FROM embeddings), d AS (SELECT vec_id, {', '.join(f'{e} AS d{i}' for i, e in enumerate(_D))} FROM x) SELECT vec_id, (CASE WHEN d0 <= d1 AND d0 <= d2 AND d0 <= d3 THEN 0 WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END)::INT AS zone FROM d"),
    "pc_scores": (pc_scores, f"WITH x AS (SELECT vec_id, {_E} FROM embeddings) SELECT vec_id, " + ", ".join(f"round({' + '.join(f'(e{j} - 0.01) * ({a})' for j, a in enumerate(_C[i]))}, 8) AS pc{i + 1}" for i in range(2)) + " FROM x"),
    "zone_profile": (zone_profile, _ordinal_sql()),
    "strat_sample": (strat_sample, f"WITH o AS (SELECT *, o_orderkey % 1000003 AS k FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY {_O}, o_orderkey) AS r FROM o) SELECT o_orderkey, o_orderpriority, o_orderstatus FROM r WHERE r <= 5"),
    "uniform_sample": (uniform_sample, f"WITH o AS (SELECT *, c_custkey % 1000003 AS k FROM customer) SELECT c_custkey, c_name FROM o ORDER BY {_O}, c_custkey LIMIT 50"),
    "block_folds": (block_folds, f"WITH b AS (SELECT DISTINCT c_nationkey, c_nationkey::BIGINT % 1000003 AS k FROM customer), f AS (SELECT c_nationkey, ((row_number() OVER (ORDER BY {_O}, c_nationkey) - 1) % 5)::INT AS fold FROM b) SELECT fold, count(*) AS n, count(DISTINCT c_nationkey) AS blocks FROM customer JOIN f USING (c_nationkey) GROUP BY 1"),
    "grid_strata": (grid_strata, "WITH g AS (SELECT greatest(0, least(7, floor((embedding[1]::DOUBLE + 0.3) / (0.6 / 8))))::INT * 8 + greatest(0, least(7, floor((embedding[2]::DOUBLE + 0.3) / (0.6 / 8))))::INT AS strat FROM embeddings) SELECT strat, count(*) AS n FROM g GROUP BY 1"),
    "one_to_one_join_gap": (one_to_one_join_gap, "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT 'matched' AS side, count(*) AS rows FROM a WHERE k IN (SELECT k FROM b) UNION ALL SELECT 'left_only', count(*) FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'right_only', count(*) FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT 'left_repeated', count(*) FROM a WHERE n > 1 UNION ALL SELECT 'right_repeated', count(*) FROM b WHERE n > 1"),
    "topk_opportunity": (topk_opportunity, "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10"),
    "unpivot_regex": (unpivot_regex, "SELECT 'size' AS grp, 250 AS radius, round(avg(p_size), 6) AS value FROM part UNION ALL SELECT 'price', 750, round(avg(p_retailprice), 6) FROM part UNION ALL SELECT 'price', 4750, round(stddev_pop(p_retailprice), 6) FROM part"),
    "focal_stats": (focal_stats, f"WITH {GRID} SELECT a.gx, a.gy, round(avg(b.v), 6) AS mean, round(stddev_pop(b.v), 6) AS sd, count(*) AS n FROM c a JOIN c b ON (a.gx - b.gx) ^ 2 + (a.gy - b.gy) ^ 2 <= 4 GROUP BY 1, 2"),
    "distance_transform": (distance_transform, f"WITH {GRID} SELECT a.gx, a.gy, (SELECT min((a.gx - b.gx) ^ 2 + (a.gy - b.gy) ^ 2)::DOUBLE FROM c b WHERE b.src = 1) AS d2 FROM c a"),
    "bilinear": (bilinear, f"WITH {GRID}, k AS (SELECT gx // 8 AS cx, gy // 8 AS cy, avg(v) AS v FROM c GROUP BY 1, 2), f AS (SELECT gx, gy, (gx + 0.5) / 8 - 0.5 AS x, (gy + 0.5) / 8 - 0.5 AS y FROM c), w AS (SELECT gx, gy, (1 - abs(x - cx)) * (1 - abs(y - cy)) AS w, v FROM f JOIN k ON cx IN (floor(x), floor(x) + 1) AND cy IN (floor(y), floor(y) + 1)) SELECT gx, gy, round((sum(w * v) / sum(w))::DOUBLE, 7) AS v FROM w GROUP BY 1, 2"),
    "slope_gradient": (slope_gradient, f"WITH {GRID}, s AS (SELECT a.gx, a.gy, count(*) AS n, sum(b.v * (b.gx - a.gx) * CASE WHEN b.gy = a.gy THEN 2 ELSE 1 END) / 80 AS dx, sum(b.v * (b.gy - a.gy) * CASE WHEN b.gx = a.gx THEN 2 ELSE 1 END) / 80 AS dy FROM c a JOIN c b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 GROUP BY 1, 2) SELECT gx, gy, round(degrees(atan(sqrt(dx ^ 2 + dy ^ 2))), 6) AS slope FROM s WHERE n = 9"),
    "haversine": (haversine, "WITH x AS (SELECT vec_id, radians(embedding[1]::DOUBLE) AS o1, radians(embedding[2]::DOUBLE) AS a1, radians(embedding[3]::DOUBLE) AS o2, radians(embedding[4]::DOUBLE) AS a2 FROM embeddings) SELECT vec_id, round(2 * 6371.0088 * asin(sqrt(sin((a2 - a1) / 2) ^ 2 + cos(a1) * cos(a2) * sin((o2 - o1) / 2) ^ 2)), 5) AS km FROM x"),
    "regression_diff": (regression_diff, "WITH a AS (SELECT p_retailprice AS o, p_retailprice + CASE WHEN p_partkey % 100 = 0 THEN 0.5 ELSE 0.0 END AS n, p_size::DOUBLE AS so, p_size::DOUBLE AS sn FROM part), x AS (SELECT 'p_retailprice' AS \"column\", min(n - o) AS a, max(n - o) AS b FROM a UNION ALL SELECT 'p_size', min(sn - so), max(sn - so) FROM a) SELECT \"column\", round(a, 6)::DOUBLE AS lowest, round(b, 6)::DOUBLE AS highest, greatest(abs(a), abs(b)) > 1e-6 AS changed FROM x"),
    "zscore_columns": (zscore_columns, "WITH t AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS b, avg(p_retailprice) AS c, stddev_pop(p_retailprice) AS d FROM part) SELECT p_partkey, round((p_size - a) / greatest(b, 1e-9), 7) AS p_size, round((p_retailprice - c) / greatest(d, 1e-9), 7) AS p_retailprice FROM part, t"),
    "window_climatology": (window_climatology, "SELECT strftime(to_timestamp(floor(epoch(ts) / 432000)::BIGINT * 432000), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 5) AS total FROM events GROUP BY 1, 2"),
    "canonical_zones": (canonical_zones, "WITH m AS (SELECT label, avg(embedding[1]::DOUBLE) AS m, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, (row_number() OVER (ORDER BY m DESC, label))::INT AS canonical, n FROM m"),
    "kmeans_fit": (kmeans_fit, None),
    "pca_fit": (pca_fit, None),
}
