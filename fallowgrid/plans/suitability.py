"""Queries of the suitability engine, masks, comparison and class tables on line items as cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.membership import argmax_index, membership, plateau, quantize, remap, suitability_class, weighted_arithmetic, weighted_geomean
from ..operators import climate, reports, stats
from ..operators.sampling import halves
from ..operators.suitability import Factor, Segment, comparative, removal_mask, sensitivity, suitability, variance_shares, with_segments, zero_mask
from ..sources.tables import table

QTY, DISC, PRICE = Factor("l_quantity", "increasing", (5, 40), 0.5), Factor("l_discount", "decreasing", (0.02, 0.09), 0.3), Factor("l_extendedprice", "range", (2000, 15000, 45000, 70000), 0.2)
CROPS = (Segment("alpha", (QTY, DISC, PRICE)), Segment("beta", (QTY, PRICE), aggregate="arithmetic"), Segment("gamma", (DISC, PRICE)))
KEY = ["l_orderkey", "l_linenumber"]


def up(x: str, a: float, b: float) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x} - {a}) / ({b} - {a})::DOUBLE)) END"


def down(x: str, a: float, b: float) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({b} - {x}) / ({b} - {a})::DOUBLE)) END"


def flat(x: str, a: float, b: float, c: float, d: float) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE least({up(x, a, b)}, {down(x, c, d)}) END"


MU = f"{up('l_quantity', 5, 40)} AS m1, {down('l_discount', 0.02, 0.09)} AS m2, {flat('l_extendedprice', 2000, 15000, 45000, 70000)} AS m3"
LN = "ln(greatest(1e-3::DOUBLE, {}))"
ALPHA = f"exp(0.5 * {LN.format('m1')} + 0.3 * {LN.format('m2')} + 0.2 * {LN.format('m3')})"
BETA = "(0.5 * m1 + 0.2 * m3) / 0.7"
GAMMA = f"exp((0.3 * {LN.format('m2')} + 0.2 * {LN.format('m3')}) / 0.5)"
CLS = "(({0} >= 0.25)::INT + ({0} >= 0.5)::INT + ({0} >= 0.75)::INT)"
CELLS = f"WITH mu AS (SELECT *, {MU} FROM lineitem), s AS (SELECT *, {ALPHA} AS a, {BETA} AS b, {GAMMA} AS g FROM mu)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def membership_shapes(spark, d):
    x = _items(spark, d)
    return x.select(*KEY, *[F.round(membership(F.col(f.column), f.shape, f.points), 9).alias(f"m{i}") for i, f in enumerate((QTY, DISC, PRICE), 1)])


def suit_geomean(spark, d):
    x = _items(spark, d).withColumn("s", suitability(CROPS[0]))
    return x.withColumn("cls", suitability_class(F.col("s"))).groupBy("l_returnflag", "cls").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean_s"))


def suit_arithmetic(spark, d):
    x = _items(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = [membership(F.col("p_size"), "increasing", (5, 40)), plateau(F.col("p_retailprice"), 900, 1000, 1400, 1800), membership(F.col("l_discount"), "decreasing", (0.02, 0.09))]
    return x.select("p_brand", weighted_arithmetic(m, [0.4, 0.4, 0.2]).alias("a"), weighted_geomean(m, [0.4, 0.4, 0.2]).alias("g")).groupBy("p_brand").agg(F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("g"), 6).alias("mean_g"), F.count("*").alias("n"))


def fao_class_share(spark, d):
    x = _items(spark, d).withColumn("c", suitability_class(suitability(CROPS[0])))
    return x.groupBy("l_returnflag").agg(F.round(F.avg((F.col("c") >= 2).cast("double")), 6).alias("share_s2"), F.round(F.avg((F.col("c") == 0).cast("double")), 6).alias("share_n"))


def mask_zero_vs_null(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 500000).alias("s"), (F.col("o_orderstatus") == "O").cast("int").alias("mask_available"), (F.col("o_orderstatus") == "P").cast("int").alias("mask_excluded"))
    o = o.select("o_orderpriority", zero_mask(F.col("s"), "available").alias("za"), zero_mask(F.col("s"), "exclude_only").alias("ze"), zero_mask(F.col("s"), "none").alias("zn"), removal_mask(F.col("s"), F.col("mask_available") == 1).alias("r"))
    return o.groupBy("o_orderpriority").agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("za", "ze", "zn", "r")], F.count("r").alias("n_kept"))


def multi_segment_wide(spark, d):
    w = with_segments(_items(spark, d), CROPS, KEY)
    return w.select(*KEY, *[F.round(f"suit_{s.name}", 7).alias(f"suit_{s.name}") for s in CROPS], *[f"class_{s.name}" for s in CROPS], argmax_index([F.round(f"suit_{s.name}", 9) for s in CROPS]).alias("best_use"))


def comparative_best_use(spark, d):
    w = comparative(with_segments(_items(spark, d), CROPS, [*KEY, "l_returnflag"]), [f"suit_{s.name}" for s in CROPS])
    return w.groupBy("l_returnflag").agg(*[F.round(F.avg(f"z_suit_{s.name}"), 6).alias(f"z_{s.name}") for s in CROPS], F.count("*").alias("n"))


def sensitivity_band(spark, d):
    p = table(spark, d, "part")
    seg = Segment("p", (Factor("p_size", "increasing", (5, 40), 0.6), Factor("p_retailprice", "range", (900, 1000, 1400, 1800), 0.4)), aggregate="arithmetic")
    return p.select("p_partkey", F.round(sensitivity(seg), 7).alias("band"))


def variance_shares_q(spark, d):
    return variance_shares(_items(spark, d), CROPS[0]).select("factor", F.round("share", 6).alias("share"))


def membership_stats(spark, d):
    x = _items(spark, d).withColumn("m", membership(F.col("l_quantity"), "increasing", (5, 40))).withColumn("era", (F.year("l_shipdate") >= 1998).cast("int"))
    g = x.groupBy("era").agg(*reports.saturation("m"))
    a, b = g.where("era = 0"), g.where("era = 1").select(*[F.col(c).alias(f"{c}_f") for c in ("mean", "sigma", "saturated", "vetoed")])
    j = a.crossJoin(F.broadcast(b))
    return j.select(*[F.round(c, 7).alias(c) for c in ("mean", "sigma", "saturated", "vetoed", "mean_f", "sigma_f")], F.round(reports.pooled_sigma(F.col("sigma"), F.col("mean"), F.col("sigma_f"), F.col("mean_f")), 7).alias("pooled"))


def underuse(spark, d):
    x = _items(spark, d).withColumn("c", suitability_class(suitability(CROPS[0])))
    role = remap(F.ascii("l_returnflag"), {65: 1, 78: 2}, 0)
    return x.groupBy(role.alias("role")).agg(F.sum(((F.col("c") >= 2) & (role != 1)).cast("long")).alias("unused"), F.count("*").alias("n"))


def quantized_band(spark, d):
    c = table(spark, d, "customer").withColumn("v", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")))
    return c.select("c_custkey", quantize(F.col("v"), 0.0, 9000.0).alias("q"))


def class_transition(spark, d):
    x = with_segments(_items(spark, d), CROPS[:2], [])
    return climate.transition(x, "class_alpha", "class_beta").withColumn("share_pct", F.round("share_pct", 6))


def downgrade_share(spark, d):
    x = _items(spark, d).select("l_linestatus", suitability_class(suitability(CROPS[0])).alias("p"), suitability_class(suitability(CROPS[1])).alias("f"))
    return x.groupBy("l_linestatus").agg(F.round(F.avg((F.col("f") < F.col("p")).cast("double")), 6).alias("downgrade_share"))


def half_domains(spark, d):
    x = _items(spark, d).withColumn("split", F.pmod("l_orderkey", F.lit(2)).cast("int"))
    return halves(x, "split").groupBy("half").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_q"), F.round(F.stddev_pop("l_discount"), 8).alias("sd"))


def pivot_half_delta(spark, d):
    x = halves(_items(spark, d).withColumn("split", F.pmod("l_orderkey", F.lit(2)).cast("int")), "split")
    m = x.groupBy("l_returnflag", "half").agg(F.avg("l_quantity").alias("value"))
    p = reports.half_delta(m, ["l_returnflag"])
    return p.select("l_returnflag", *[F.round(c, 7).alias(c) for c in ("calib", "val", "full", "delta")])


def lambda_robustness(spark, d):
    """One membership table reweighted for five powers: AUC of each."""
    x = _items(spark, d).select(*[membership(F.col(f.column), f.shape, f.points).alias(f"m{i}") for i, f in enumerate((QTY, DISC, PRICE))], (F.col("l_returnflag") == "R").cast("int").alias("y"))
    spread = (0.3, 0.36, 0.22)
    scored = []
    for p in (0.0, 0.25, 0.5, 0.75, 1.0):
        w = [f.weight * s**p for f, s in zip((QTY, DISC, PRICE), spread, strict=True)]
        scored.append(F.struct(F.lit(p).alias("power"), F.round(weighted_geomean([F.col(f"m{i}") for i in range(3)], w), 9).alias("s")))
    x = x.select("y", F.explode(F.array(*scored)).alias("x")).select("y", "x.*")
    return stats.auc(x, "s", "y", ["power"]).select("power", F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


def _lambda_sql() -> str:
    spread, weight, parts = (0.3, 0.36, 0.22), (0.5, 0.3, 0.2), []
    for p in (0.0, 0.25, 0.5, 0.75, 1.0):
        w = [a * s**p for a, s in zip(weight, spread, strict=True)]
        t = sum(w)
        e = " + ".join(f"{x / t!r} * {LN.format(f'm{i}')}" for i, x in enumerate(w, 1))
        parts.append(f"SELECT {p}::DOUBLE AS power, round(exp({e}), 9) AS s, (l_returnflag = 'R')::INT AS y FROM mu")
    return f"WITH mu AS (SELECT *, {MU} FROM lineitem), x AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, rank() OVER (PARTITION BY power ORDER BY s) + (count(*) OVER (PARTITION BY power, s) - 1) / 2.0 AS rk FROM x) SELECT power, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)::DOUBLE), 6) AS auc, (count(*) FILTER (y = 1))::BIGINT AS n_pos, (count(*) FILTER (y = 0))::BIGINT AS n_neg FROM r GROUP BY power"


P1, P2 = up("p_size", 5, 40), flat("p_retailprice", 900, 1000, 1400, 1800)
_W = [(0.6, 0.4), (0.48, 0.52), (0.72, 0.28), (0.68, 0.32), (0.52, 0.48)]
QUERIES = {
    "membership_shapes": (membership_shapes, f"WITH mu AS (SELECT *, {MU} FROM lineitem) SELECT l_orderkey, l_linenumber, round(m1, 9) AS m1, round(m2, 9) AS m2, round(m3, 9) AS m3 FROM mu"),
    "suit_geomean": (suit_geomean, f"{CELLS} SELECT l_returnflag, {CLS.format('a')}::INT AS cls, count(*) AS n, round(avg(a), 6) AS mean_s FROM s GROUP BY 1, 2"),
    "suit_arithmetic": (suit_arithmetic, f"WITH mu AS (SELECT p_brand, {P1} AS m1, {P2} AS m2, {down('l_discount', 0.02, 0.09)} AS m3 FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT p_brand, round(avg(0.4 * m1 + 0.4 * m2 + 0.2 * m3), 6) AS mean_a, round(avg(exp(0.4 * {LN.format('m1')} + 0.4 * {LN.format('m2')} + 0.2 * {LN.format('m3')})), 6) AS mean_g, count(*) AS n FROM mu GROUP BY 1"),
    "fao_class_share": (fao_class_share, f"{CELLS} SELECT l_returnflag, round(avg(({CLS.format('a')} >= 2)::INT), 6) AS share_s2, round(avg(({CLS.format('a')} = 0)::INT), 6) AS share_n FROM s GROUP BY 1"),
    "mask_zero_vs_null": (mask_zero_vs_null, "WITH x AS (SELECT o_orderpriority, o_totalprice / 500000 AS s, o_orderstatus = 'O' AS a, o_orderstatus = 'P' AS e FROM orders) SELECT o_orderpriority, round(avg(CASE WHEN a THEN s ELSE 0 END), 6) AS mean_za, round(avg(CASE WHEN e THEN 0 ELSE s END), 6) AS mean_ze, round(avg(s), 6) AS mean_zn, round(avg(s) FILTER (a), 6) AS mean_r, count(*) FILTER (a) AS n_kept FROM x GROUP BY 1"),
    "multi_segment_wide": (multi_segment_wide, f"{CELLS} SELECT l_orderkey, l_linenumber, round(a, 7) AS suit_alpha, round(b, 7) AS suit_beta, round(g, 7) AS suit_gamma, {CLS.format('a')}::INT AS class_alpha, {CLS.format('b')}::INT AS class_beta, {CLS.format('g')}::INT AS class_gamma, (CASE WHEN round(a, 9) >= round(b, 9) AND round(a, 9) >= round(g, 9) THEN 0 WHEN round(b, 9) >= round(g, 9) THEN 1 ELSE 2 END)::INT AS best_use FROM s"),
    "comparative_best_use": (comparative_best_use, f"{CELLS}, t AS (SELECT avg(a) FILTER (a > 0) AS ma, stddev_pop(a) FILTER (a > 0) AS sa, avg(b) FILTER (b > 0) AS mb, stddev_pop(b) FILTER (b > 0) AS sb, avg(g) FILTER (g > 0) AS mg, stddev_pop(g) FILTER (g > 0) AS sg FROM s) SELECT l_returnflag, round(avg((a - ma) / greatest(sa, 1e-6)), 6) AS z_alpha, round(avg((b - mb) / greatest(sb, 1e-6)), 6) AS z_beta, round(avg((g - mg) / greatest(sg, 1e-6)), 6) AS z_gamma, count(*) AS n FROM s, t GROUP BY 1"),
    "sensitivity_band": (sensitivity_band, f"WITH m AS (SELECT p_partkey, {P1} AS m1, {P2} AS m2 FROM part) SELECT p_partkey, round(greatest({', '.join(f'{a} * m1 + {b} * m2' for a, b in _W)}) - least({', '.join(f'{a} * m1 + {b} * m2' for a, b in _W)}), 7) AS band FROM m"),
    "variance_shares": (variance_shares_q, f"WITH mu AS (SELECT {MU} FROM lineitem), t AS (SELECT {LN.format('m1')} AS t1, {LN.format('m2')} AS t2, {LN.format('m3')} AS t3, 0.5 * {LN.format('m1')} + 0.3 * {LN.format('m2')} + 0.2 * {LN.format('m3')} AS tot FROM mu) " + " UNION ALL ".join(f"SELECT '{n}' AS factor, round({w} * covar_pop(t{i}, tot) / var_pop(tot), 6) AS share FROM t" for i, (n, w) in enumerate((("l_quantity", 0.5), ("l_discount", 0.3), ("l_extendedprice", 0.2)), 1))),
    "membership_stats": (membership_stats, f"WITH m AS (SELECT {up('l_quantity', 5, 40)} AS m, year(l_shipdate) >= 1998 AS f FROM lineitem), g AS (SELECT avg(m) FILTER (NOT f) AS mean, stddev_pop(m) FILTER (NOT f) AS sigma, avg((m >= 0.999)::INT) FILTER (NOT f) AS saturated, avg((m <= 0.001)::INT) FILTER (NOT f) AS vetoed, avg(m) FILTER (f) AS mean_f, stddev_pop(m) FILTER (f) AS sigma_f FROM m) SELECT round(mean, 7) AS mean, round(sigma, 7) AS sigma, round(saturated, 7) AS saturated, round(vetoed, 7) AS vetoed, round(mean_f, 7) AS mean_f, round(sigma_f, 7) AS sigma_f, round(sqrt((sigma ^ 2 + sigma_f ^ 2) / 2 + (mean - mean_f) ^ 2 / 4), 7) AS pooled FROM g"),
    "underuse": (underuse, f"{CELLS} SELECT (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END)::INT AS role, (count(*) FILTER ({CLS.format('a')} >= 2 AND l_returnflag <> 'A'))::BIGINT AS unused, count(*) AS n FROM s GROUP BY 1"),
    "quantized_band": (quantized_band, "SELECT c_custkey, coalesce(round(greatest(0, least(9000, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END)) / 9000 * 254), 255)::INT AS q FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, 255 FROM customer WHERE c_custkey % 10 = 0"),
    "class_transition": (class_transition, f"{CELLS}, c AS (SELECT {CLS.format('a')}::INT AS p, {CLS.format('b')}::INT AS f, count(*) AS n FROM s GROUP BY 1, 2) SELECT x.i::INT AS before, y.i::INT AS after, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM lineitem), 6) AS share_pct FROM range(4) x(i) CROSS JOIN range(4) y(i) LEFT JOIN c ON p = x.i AND f = y.i"),
    "downgrade_share": (downgrade_share, f"{CELLS} SELECT l_linestatus, round(avg(({CLS.format('b')} < {CLS.format('a')})::INT), 6) AS downgrade_share FROM s GROUP BY 1"),
    "half_domains": (half_domains, "WITH x AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN 'calib' ELSE 'val' END AS half FROM lineitem) SELECT half, count(*) AS n, round(avg(l_quantity), 6) AS mean_q, round(stddev_pop(l_discount), 8) AS sd FROM x GROUP BY 1 UNION ALL SELECT 'full', count(*), round(avg(l_quantity), 6), round(stddev_pop(l_discount), 8) FROM x"),
    "pivot_half_delta": (pivot_half_delta, "WITH x AS (SELECT l_returnflag, avg(l_quantity) FILTER (l_orderkey % 2 = 0) AS calib, avg(l_quantity) FILTER (l_orderkey % 2 = 1) AS val, avg(l_quantity) AS full_ FROM lineitem GROUP BY 1) SELECT l_returnflag, round(calib, 7) AS calib, round(val, 7) AS val, round(full_, 7) AS \"full\", round(val - calib, 7) AS delta FROM x"),
    "lambda_robustness": (lambda_robustness, _lambda_sql()),
}
