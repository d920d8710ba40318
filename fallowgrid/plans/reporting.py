"""Queries of test probabilities, validation suites, report tables and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.membership import argmax_index, membership
from ..functions.probability import correlation_p, variance_p
from ..operators import reports, stats, suites
from ..operators.sampling import halves
from ..sources import vectors
from ..sources.tables import table
from .analytics import _grid
from .features import _C, shift_table
from .features import QUERIES as _FEATURES


def _beta(a: str, b: str, y: str) -> str:
    """Upper tail of the incomplete beta function by its power series: another way than the engine's fraction."""
    return f"greatest(0, 1 - (SELECT sum(exp(lgamma({a} + {b} + k) - lgamma({b}) - lgamma({a} + 1 + k) + ({a} + k) * ln({y}) + {b} * ln(1 - {y}))) FROM range(3000) t(k)))"


RHO_P = _beta("0.5", "((n - 2) / 2.0)", "(rho * rho)")
F_P = _beta("((k0 - 1) / 2.0)", "((n - k0) / 2.0)", "((k0 - 1) * f / ((k0 - 1) * f + n - k0))")
HALF = "unnest(['full', CASE WHEN l_orderkey % 2 = 0 THEN 'calib' ELSE 'val' END]) AS half"


def _split(spark, d):
    return table(spark, d, "lineitem").withColumn("split", F.pmod("l_orderkey", F.lit(2)).cast("int"))


def spearman_p(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_totalprice", F.col("o_custkey").cast("double").alias("c"))
    r = stats.spearman(o, "o_totalprice", "c", ["o_orderpriority"])
    return r.select("o_orderpriority", F.round("rho", 7).alias("rho"), F.round(correlation_p(F.col("rho"), F.col("n")), 5).alias("p"), "n")


def anova_p(spark, d):
    a = stats.anova(table(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return a.select(F.round("f", 6).alias("f"), F.round(variance_p(F.col("f"), F.col("n"), F.col("k")), 5).alias("p"))


def _rounded(df):
    return df.select("metric", "segment", "half", F.round("value", 6).alias("value"), "n", F.round("p", 5).alias("p"))


def unit_correlation(spark, d):
    x = _split(spark, d).select("l_suppkey", "split", (F.col("l_extendedprice") / 50000).alias("alpha"), (F.col("l_extendedprice") * F.col("l_discount")).alias("beta"), (F.col("l_extendedprice") * F.col("l_tax")).alias("npp"))
    return _rounded(suites.unit_correlation(x, "l_suppkey", "split", ["alpha", "beta"], "npp"))


def presence_suite(spark, d):
    x = _split(spark, d).select("split", (F.col("l_quantity") / 50).alias("a"), (F.col("l_extendedprice") / 110000).alias("b"), F.when((F.col("l_orderkey") == 1) & (F.col("l_linenumber") == 1), "X").otherwise(F.col("l_returnflag")).alias("role"))
    return _rounded(suites.presence(x, "split", {"alpha": ("a", "R"), "beta": ("b", "A"), "gamma": ("a", "X")}, "role"))


def zone_variance(spark, d):
    return _rounded(suites.zone_variance(_split(spark, d), "l_linenumber", "l_extendedprice", "split"))


_QTY = lambda c: membership(c, "increasing", (5, 40))
_TAX = lambda c: membership(c, "decreasing", (0.01, 0.07))


def discrimination_table(spark, d):
    x = halves(_split(spark, d), "split").select("half", _QTY(F.col("l_quantity")).alias("m1"), _TAX(F.col("l_tax")).alias("m2"), _QTY(F.col("l_quantity") * 1.2).alias("f1"), _TAX(F.col("l_tax") + 0.01).alias("f2"))
    t = reports.discrimination(x, {"qty": "m1", "tax": "m2"}, {"qty": "f1", "tax": "f2"})
    return t.select("half", "factor", *[F.round(c, 6).alias(c) for c in ("mean", "sigma", "saturated", "vetoed", "mean_future", "sigma_future", "sigma_horizon")])


def best_use_flip(spark, d):
    """Share of cells whose best use changes; present is future less the change."""
    p = table(spark, d, "part").select("p_brand", (F.col("p_size") / 50 * 1.2).alias("fa"), (F.col("p_size") / 50 * 0.2).alias("da"), (F.col("p_retailprice") / 2000).alias("fb"), ((F.col("p_partkey") % 100) / 100).alias("fc"))
    best = lambda cols: argmax_index([F.round(c, 9) for c in cols])
    flip = best([F.col("fa") - F.col("da"), F.col("fb"), F.col("fc")]) != best([F.col("fa"), F.col("fb"), F.col("fc")])
    return p.groupBy("p_brand").agg(F.round(F.avg(flip.cast("double")), 6).alias("flip_share"))


def home_stats(spark, d):
    """The headline numbers: units, mean score, the zone of most area with its share, and the worst mean change."""
    units = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.avg("l_quantity") / 50).alias("s")).agg(F.count("*").alias("n_units"), F.round(F.avg("s"), 6).alias("mean_s"))
    area = reports.area_shares(table(spark, d, "customer").withColumn("a", F.abs("c_acctbal")), ["c_nationkey"], "a")
    top = area.agg(F.max_by("c_nationkey", "area").alias("top_zone"), F.round(F.max("share_pct"), 6).alias("top_share_pct"), F.count("*").alias("n_zones"))
    worst = shift_table(spark, d).agg(F.min_by("segment", "delta_s").alias("worst_segment"), F.min("delta_s").alias("worst_delta"))
    return units.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(worst))  # one row each


def _square(x, y, edge):
    corner = lambda i, j: F.struct((x + i * edge).alias("x"), (y + j * edge).alias("y"))
    return F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)))


def dissolved_outline(spark, d):
    c = _grid(spark, d).select(F.floor(F.col("v") / 10).cast("int").alias("zone"), _square(F.col("gx").cast("double"), F.col("gy").cast("double"), 1.0).alias("rings"))
    return vectors.dissolved(c, ["zone"]).withColumnRenamed("by_", "by")


def bounds_filter(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", _square(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), 0.05).alias("rings"))
    return vectors.in_bounds(vectors.with_bounds(e), (0.0, 0.0, 0.2, 0.2)).select("vec_id", "xmin", "ymax")


def mercator(spark, d):
    x, y = vectors.mercator(F.col("embedding")[0].cast("double") * 100, F.col("embedding")[1].cast("double") * 50)
    return table(spark, d, "embeddings").select("vec_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def localised_numbers(spark, d):
    v = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", reports.localised(v, 2).alias("num"), reports.signed(v, 2).alias("signed"))


def theme_squares(spark, d):
    e = table(spark, d, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)])
    return reports.squares_by_theme(e, {"one": ["e0", "e1"], "two": ["e2", "e3"]}).withColumn("squares", F.round("squares", 9))


def text_search(spark, d):
    return reports.search(table(spark, d, "customer").dropna(subset=["c_mktsegment"]), "c_mktsegment", "uil").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def cross_checks(spark, d):
    labels = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("zone"))
    zones = table(spark, d, "customer").select((F.col("c_nationkey") + 1).alias("zone"))
    return reports.cross_checks(labels, zones, table(spark, d, "lineitem").select(F.col("l_returnflag").alias("role")), ["A", "N"])


def eligible_cells(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "O").cast("int").alias("mask_available"), (F.col("o_orderstatus") == "P").cast("int").alias("mask_excluded"))
    return o.groupBy("o_orderpriority").agg(*[F.count_if(reports.eligible(p)).alias(p) for p in ("available", "exclude_only", "none")])


_RANK = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0"
_MU = lambda x: f"greatest(0, least(1, ({x} - 5) / 35))"
_NU = lambda x: f"greatest(0, least(1, (0.07 - ({x})) / (0.07 - 0.01)))"

def _discrimination_sql() -> str:
    one = lambda f, m, t: f"SELECT half, '{f}' AS factor, avg({m}) AS a, stddev_pop({m}) AS s, avg(({m} >= 0.999)::INT) AS sat, avg(({m} <= 0.001)::INT) AS vet, avg({t}) AS b, stddev_pop({t}) AS u FROM x GROUP BY 1"
    return f"WITH x AS (SELECT {HALF}, {_MU('l_quantity')} AS m1, {_NU('l_tax')} AS m2, {_MU('l_quantity * 1.2')} AS f1, {_NU('l_tax + 0.01')} AS f2 FROM lineitem), g AS ({one('qty', 'm1', 'f1')} UNION ALL {one('tax', 'm2', 'f2')}) SELECT half, factor, round(a, 6) AS mean, round(s, 6) AS sigma, round(sat, 6) AS saturated, round(vet, 6) AS vetoed, round(b, 6) AS mean_future, round(u, 6) AS sigma_future, round(sqrt((s * s + u * u) / 2 + (a - b) ^ 2 / 4), 6) AS sigma_horizon FROM g"


def _presence_sql() -> str:
    return f"""WITH c AS (SELECT *, CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN 'X' ELSE l_returnflag END AS role, {HALF} FROM lineitem),
x AS (SELECT half, 'alpha' AS segment, l_quantity / 50 AS s, (role = 'R')::INT AS y FROM c UNION ALL SELECT half, 'beta', l_extendedprice / 110000, (role = 'A')::INT FROM c UNION ALL SELECT half, 'gamma', l_quantity / 50, (role = 'X')::INT FROM c),
r AS (SELECT *, {_RANK.format('segment, half', 's')} AS rk FROM x),
a AS (SELECT segment, half, sum(y)::BIGINT AS p, count(*) AS n, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y))::DOUBLE, 0) AS auc FROM r GROUP BY 1, 2),
k AS (SELECT 0.05 + i * 0.9 / 9 AS centre FROM range(10) t(i)),
w AS (SELECT x.segment, x.half, centre, (sum(y) / any_value(a.p)) / (count(*) / any_value(a.n)) AS pe FROM k JOIN x ON s >= centre - 0.05 AND s <= centre + 0.05 JOIN a ON a.segment = x.segment AND a.half = x.half GROUP BY 1, 2, 3),
v AS (SELECT segment, half, {_RANK.format('segment, half', 'centre')} AS rc, {_RANK.format('segment, half', 'pe')} AS rp FROM w),
b AS (SELECT segment, half, corr(rc, rp) AS boyce FROM v GROUP BY 1, 2)
SELECT 'auc' AS metric, segment, half, round(auc, 6) AS value, n, NULL::DOUBLE AS p FROM a WHERE a.p >= 30
UNION ALL SELECT 'boyce', b.segment, b.half, round(boyce, 6), a.n, NULL FROM b JOIN a ON a.segment = b.segment AND a.half = b.half WHERE a.p >= 30
UNION ALL SELECT 'presence_underpowered', segment, half, NULL, n, NULL FROM a WHERE a.p < 30"""


def _flip_sql() -> str:
    best = lambda a: f"CASE WHEN {a} >= fb AND {a} >= fc THEN 0 WHEN fb >= fc THEN 1 ELSE 2 END"
    return f"WITH p AS (SELECT p_brand, round(p_size / 50 * 1.2, 9) AS fa, round(p_size / 50 * 1.2 - p_size / 50 * 0.2, 9) AS pa, round(p_retailprice / 2000, 9) AS fb, round((p_partkey % 100) / 100, 9) AS fc FROM part) SELECT p_brand, round(avg((({best('fa')}) <> ({best('pa')}))::INT), 6) AS flip_share FROM p GROUP BY 1"


_SHIFT_SQL = _FEATURES["shift_table"][1]
_EDGES = ", ".join(f"(gx + {a}, gy + {b}, gx + {c}, gy + {e})" for a, b, c, e in ((0, 0, 1, 0), (1, 0, 1, 1), (0, 1, 1, 1), (0, 0, 0, 1)))
QUERIES = {
    "spearman_p": (spearman_p, f"WITH r AS (SELECT o_orderpriority, {_RANK.format('o_orderpriority', 'o_totalprice')} AS a, {_RANK.format('o_orderpriority', 'o_custkey')} AS b FROM orders), g AS (SELECT o_orderpriority, corr(a, b) AS rho, count(*) AS n FROM r GROUP BY 1) SELECT o_orderpriority, round(rho, 7) AS rho, round({RHO_P}, 5)::DOUBLE AS p, n FROM g"),
    "anova_p": (anova_p, f"WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean FROM g), h AS (SELECT (sum(g.n * (m - mean) ^ 2) / (any_value(k) - 1)) / (sum(g.n * v) / (any_value(t.n) - any_value(k))) AS f, any_value(t.n)::DOUBLE AS n, any_value(k) AS k0 FROM g, t) SELECT round(f, 6) AS f, round({F_P}, 5)::DOUBLE AS p FROM h"),
    "unit_correlation": (unit_correlation, f"WITH x AS (SELECT l_suppkey, {HALF}, l_extendedprice / 50000 AS a, l_extendedprice * l_discount AS b, l_extendedprice * l_tax AS c FROM lineitem), m AS (SELECT l_suppkey, half, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM x GROUP BY 1, 2), l AS (SELECT 'alpha' AS segment, half, a AS s, c FROM m UNION ALL SELECT 'beta', half, b, c FROM m), r AS (SELECT segment, half, {_RANK.format('segment, half', 's')} AS rs, {_RANK.format('segment, half', 'c')} AS rc FROM l), g AS (SELECT segment, half, corr(rs, rc) AS rho, count(*) AS n FROM r GROUP BY 1, 2) SELECT 'spearman' AS metric, segment, half, round(rho, 6) AS value, n, round({RHO_P}, 5)::DOUBLE AS p FROM g"),
    "presence_suite": (presence_suite, _presence_sql()),
    "zone_variance": (zone_variance, f"WITH x AS (SELECT {HALF}, l_linenumber AS z, l_extendedprice AS v FROM lineitem), g AS (SELECT half, z, count(*) AS n, avg(v) AS m, var_pop(v) AS v FROM x GROUP BY 1, 2 HAVING count(*) >= 2), t AS (SELECT half, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean FROM g GROUP BY 1), h AS (SELECT half, (sum(g.n * (m - mean) ^ 2) / (any_value(k) - 1)) / (sum(g.n * v) / (any_value(t.n) - any_value(k))) AS f, any_value(t.n)::BIGINT AS n, any_value(k) AS k0 FROM g JOIN t USING (half) GROUP BY 1) SELECT 'anova_f' AS metric, 'all' AS segment, half, round(f, 6) AS value, n, round({F_P}, 5)::DOUBLE AS p FROM h"),
    "discrimination_table": (discrimination_table, _discrimination_sql()),
    "best_use_flip": (best_use_flip, _flip_sql()),
    "home_stats": (home_stats, f"WITH u AS (SELECT avg(l_quantity) / 50 AS s FROM lineitem GROUP BY l_suppkey), z AS (SELECT c_nationkey, sum(abs(c_acctbal)) AS a FROM customer GROUP BY 1), w AS ({_SHIFT_SQL}) SELECT (SELECT count(*) FROM u) AS n_units, (SELECT round(avg(s), 6) FROM u) AS mean_s, (SELECT arg_max(c_nationkey, a) FROM z) AS top_zone, (SELECT round(100.0 * max(a) / sum(a), 6) FROM z) AS top_share_pct, (SELECT count(*) FROM z) AS n_zones, arg_min(segment, delta_s) AS worst_segment, min(delta_s) AS worst_delta FROM w"),
    "dissolved_outline": (dissolved_outline, f"WITH {_C}, e AS (SELECT floor(v / 10)::INT AS zone, unnest([{_EDGES}]) AS e FROM c), o AS (SELECT zone, e, count(*) AS n FROM e GROUP BY 1, 2) SELECT zone, e[1]::DOUBLE AS ax, e[2]::DOUBLE AS ay, e[3]::DOUBLE AS bx, e[4]::DOUBLE AS by FROM o WHERE n % 2 = 1"),
    "bounds_filter": (bounds_filter, "WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT vec_id, x AS xmin, y + 0.05::DOUBLE AS ymax FROM p WHERE x <= 0.2 AND x + 0.05::DOUBLE >= 0 AND y <= 0.2 AND y + 0.05::DOUBLE >= 0"),
    "mercator": (mercator, "WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 50 AS y FROM embeddings) SELECT vec_id, round(radians(x) * 6378137.0::DOUBLE, 3) AS x, round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137.0::DOUBLE, 3) AS y FROM p"),
    "localised_numbers": (localised_numbers, "WITH x AS (SELECT c_custkey, c_acctbal AS v, translate(format('{:,.2f}', c_acctbal), ',.', '.,') AS num, translate(format('{:,.2f}', abs(c_acctbal)), ',.', '.,') AS a FROM customer) SELECT c_custkey, num, CASE WHEN round(v, 2) = 0 THEN a WHEN v < 0 THEN '-' || a ELSE '+' || a END AS signed FROM x"),
    "theme_squares": (theme_squares, "WITH x AS (SELECT " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(4)) + " FROM embeddings) SELECT 'one' AS theme, round(avg(e0 * e0 + e1 * e1), 9) AS squares FROM x UNION ALL SELECT 'two', round(avg(e2 * e2 + e3 * e3), 9) FROM x"),
    "text_search": (text_search, "SELECT c_mktsegment, count(*) AS n FROM customer WHERE contains(lower(c_mktsegment), 'uil') GROUP BY 1"),
    "cross_checks": (cross_checks, "WITH a AS (SELECT n_nationkey + 1 AS z FROM nation), b AS (SELECT DISTINCT c_nationkey + 1 AS z FROM customer) SELECT 'labels' AS \"check\", (SELECT count(*) FROM a WHERE z NOT IN (SELECT z FROM b)) + (SELECT count(*) FROM b WHERE z NOT IN (SELECT z FROM a)) + (SELECT count(*) - count(DISTINCT z) FROM a) = 0 AS ok UNION ALL SELECT 'order', min(z) = 1 AND max(z) = count(*) FROM b UNION ALL SELECT 'roles', count(*) = 0 FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')"),
    "eligible_cells": (eligible_cells, "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS available, count(*) FILTER (o_orderstatus <> 'P') AS exclude_only, count(*) AS none FROM orders GROUP BY 1"),
}
