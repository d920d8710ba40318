"""Queries of band builders, projections on swapped stacks, weight anchors, gates and model selection."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.membership import membership
from ..operators import bands, reports, sampling, selection, stats, zoning
from ..operators.suitability import Factor, Segment, suitability, variance_shares
from ..sources.tables import table
from .analytics import _grid


def soil_bands(spark, d):
    x = table(spark, d, "lineitem").withColumn("b30", 100 * F.col("l_tax"))
    layers = bands.depth_mean({"clay": (("l_quantity", "l_linenumber", "b30"), 0.1), "ph": (("l_linenumber", "b30", "l_quantity"), 0.01)})
    return x.groupBy("l_suppkey").agg(*[F.round(F.avg(c), 7).alias(k) for k, c in layers.items()])


def landcover_bands(spark, d):
    x = bands.landcover(table(spark, d, "events"), ["user_id"], "event_type", {"buy": ["purchase"], "look": ["view", "click"]}, ["view"])
    return x.select("user_id", "mode", F.round("buy_frac", 7).alias("buy_frac"), F.round("look_frac", 7).alias("look_frac"), "mask_excluded", "mask_available")


def realized_use(spark, d):
    x = table(spark, d, "lineitem").withColumn("role", F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(5))
    x = bands.landcover(x, ["l_suppkey"], "role", {"soybean": [1], "cane": [2], "pasture": [5], "managed": [1, 2, 3, 5]}, [5])
    return x.select("l_suppkey", F.col("mode").cast("int").alias("mode"), *[F.round(f"{c}_frac", 7).alias(f"{c}_frac") for c in ("soybean", "cane", "pasture", "managed")], "mask_available")


def productivity(spark, d):
    x = bands.productivity(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", 60000, 0.0001)
    return x.select("l_suppkey", F.round("value", 8).alias("value"), "n")


def season_productivity(spark, d):
    x = bands.season(table(spark, d, "lineitem"), "l_shipdate", (10, 11, 12, 1, 2, 3), (1996, 1998))
    return bands.productivity(x, ["l_returnflag"], "l_extendedprice", 60000, 0.0001).select("l_returnflag", F.round("value", 8).alias("value"), "n")


def _latitudes(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") * 2.5 - 30).alias("lat"), "s_acctbal")


def radiation(spark, d):
    return _latitudes(spark, d).select("s_suppkey", F.round(bands.radiation(F.col("lat")), 5).alias("ra"))


def siting_bands(spark, d):
    kt = bands.clearness(F.col("s_acctbal") / 20, bands.radiation(F.col("lat")))
    return _latitudes(spark, d).select("s_suppkey", F.round(kt, 7).alias("clearness"))


def swapped_stack(spark, d):
    """Suitability of the stack with its first two bands replaced by those of a scenario, and its change."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("clim_a"), "p_retailprice", (F.col("p_size") % 7).cast("double").alias("clim_b"))
    future = p.select("p_partkey", (F.col("clim_a") * 1.1).alias("clim_a"), (F.col("clim_b") - 1).alias("clim_b"))
    s = Segment("s", (Factor("clim_a", "increasing", (5, 40), 0.5), Factor("clim_b", "decreasing", (1, 6), 0.3), Factor("p_retailprice", "increasing", (900, 1800), 0.2)), "arithmetic")
    j = p.select("p_partkey", suitability(s).alias("now")).join(bands.swap_columns(p, future, ["p_partkey"], ["clim_a", "clim_b"]).select("p_partkey", suitability(s).alias("then")), "p_partkey")
    return j.select("p_partkey", F.round("then", 7).alias("future"), F.round(F.col("then") - F.col("now"), 7).alias("delta"))


def mask_swap(spark, d):
    a = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).cast("int").alias("mask_available"), "c_mktsegment")
    b = a.where("c_custkey % 5 <> 0").select("c_custkey", (F.col("c_custkey") % 2).cast("int").alias("mask_available"))
    return bands.swap_columns(a, b, ["c_custkey"], ["mask_available"])


def water_bands(spark, d):
    """Distances at two thresholds (permanent and semi-permanent), and the drained share around each cell."""
    from ..operators import grid

    c = _grid(spark, d).withColumn("occ", F.col("v") * 2)
    near, far = (bands.water_distance(c, "occ", t, 250.0).withColumnRenamed("distance", f"d{t}") for t in (80, 50))
    density = grid.focal(c.withColumn("w", (F.col("occ") > 50).cast("double")).select("gx", "gy", "w"), 2, {"density": F.avg("w")})
    j = near.join(far, ["gx", "gy"]).join(density, ["gx", "gy"])
    return j.select("gx", "gy", F.round("d80", 4).alias("d80"), F.round("d50", 4).alias("d50"), F.round("density", 7).alias("density"))


def theme_roughness(spark, d):
    c = _grid(spark, d).select("gx", "gy", F.col("v").alias("a"), (F.col("v") * F.col("gx")).alias("b"), F.col("gy").cast("double").alias("c"))
    return bands.roughness_summary(bands.theme_roughness(c, {"one": ["a", "b"], "two": ["c"]}, (1, 2))).select("grp", "radius", F.round("mean_std", 6).alias("mean_std"), F.round("sd_std", 6).alias("sd_std"), "n")


RINGS = {1: [(-0.2, -0.2), (0.2, -0.2), (0.0, 0.25)], 2: [(0.0, 0.0), (0.3, 0.0), (0.3, 0.3), (0.1, 0.1), (0.0, 0.3)], 3: [(-0.4, -0.4), (-0.1, -0.4), (-0.1, 0.4), (-0.4, 0.4)]}


def polygon_burn(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    rings = spark.createDataFrame([(i, r) for i, r in RINGS.items()], "id int, ring array<struct<x:double,y:double>>")
    return bands.burn(p, rings, 0.1).select("vec_id", "polygon")


def _burn_sql() -> str:
    edges = ", ".join(f"({i}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for i, r in RINGS.items() for a, b in zip(r, r[1:] + r[:1], strict=True))
    return f"WITH e(polygon, ax, ay, cx, cy) AS (VALUES {edges}), p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT vec_id, polygon::INT AS polygon FROM p, e WHERE (ay > y) <> (cy > y) AND x < ax + (y - ay) * (cx - ax) / (cy - ay) GROUP BY 1, 2 HAVING count(*) % 2 = 1"


def relative_change(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg((F.year("l_shipdate") <= 1997).cast("double")).alias("a"), F.avg((F.col("l_quantity") > 30).cast("double")).alias("b"))
    return g.select("l_returnflag", *[F.round(c, 7).alias(n) for c, n in zip(reports.relative_change(F.col("a"), F.col("b")), ("change_pp", "change_pct"), strict=True)])


def interpolated(spark, d):
    t = table(spark, d, "part").groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    return stats.interpolated(t, "x", "y", 17.25).select(F.round("value", 7).alias("value"))


def within_gradient(spark, d):
    g = stats.gradient(table(spark, d, "orders").select(F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y")), "x", "y", 5)
    return g.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("mean_x", "mean_y", "rho")], "monotonic")


def boyce_index(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return stats.boyce_index(x, "s", "y").select(F.round("boyce", 7).alias("boyce"), "n")


def hindcast_bias(spark, d):
    """Mean of the models' yearly sums less the observed one."""
    x = table(spark, d, "lineitem").withColumn("month", F.month("l_shipdate")).where(F.year("l_shipdate") <= 1997)
    yearly = lambda df, keys: df.groupBy(*keys, "month").agg(F.avg("l_quantity").alias("pr"), F.avg("l_discount").alias("t")).groupBy(*keys).agg(F.sum("pr").alias("pr"), F.avg("t").alias("t"))
    models = yearly(x, ["l_returnflag"]).agg(F.avg("pr").alias("mp"), F.avg("t").alias("mt"))
    return models.crossJoin(F.broadcast(yearly(x, []))).select(F.round(F.col("mp") - F.col("pr"), 7).alias("bias_pr"), F.round(F.col("mt") - F.col("t"), 9).alias("bias_t"))


def _shift(spark, d):
    x = table(spark, d, "lineitem")
    s = lambda c, p: membership(F.col(c), "increasing", p)
    return x.select("l_returnflag", "l_linestatus", s("l_quantity", (5, 40)).alias("f1"), (s("l_quantity", (5, 40)) - s("l_quantity", (1, 30))).alias("d1"), s("l_discount", (0.01, 0.09)).alias("f2"), (s("l_discount", (0.01, 0.09)) - s("l_discount", (0.02, 0.08))).alias("d2"))


SHIFT = "m AS (SELECT l_returnflag, l_linestatus, greatest(0, least(1, (l_quantity - 5) / 35)) AS f1, greatest(0, least(1, (l_quantity - 5) / 35)) - greatest(0, least(1, (l_quantity - 1) / 29)) AS d1, greatest(0, least(1, (l_discount - 0.01) / (0.09 - 0.01))) AS f2, greatest(0, least(1, (l_discount - 0.01) / (0.09 - 0.01))) - greatest(0, least(1, (l_discount - 0.02) / (0.08 - 0.02))) AS d2 FROM lineitem)"


def shift_table(spark, d):
    """Mean change, and the shares at or over one half before and after, per segment; before is after less the change."""
    x = _shift(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), F.col(f"f{n}").alias("f"), F.col(f"d{n}").alias("d")) for n in (1, 2)])).alias("x")
    g = x.select(each).select("x.*").groupBy("segment").agg(F.avg("d").alias("delta_s"), F.avg((F.round(F.col("f") - F.col("d"), 9) >= 0.5).cast("double")).alias("present_share"), F.avg((F.round("f", 9) >= 0.5).cast("double")).alias("future_share"))
    return g.select("segment", *[F.round(c, 6).alias(c) for c in ("delta_s", "present_share", "future_share")])


def zone_shift(spark, d):
    g = _shift(spark, d).groupBy("l_linestatus").agg(F.avg("d1").alias("alpha"), F.avg("d2").alias("beta"))
    return g.unpivot(["l_linestatus"], ["alpha", "beta"], "segment", "delta_s").withColumn("delta_s", F.round("delta_s", 7))


def renormalised_priorities(spark, d):
    x = table(spark, d, "supplier").withColumn("r", F.abs("s_acctbal"))
    return x.select("s_suppkey", F.round(reports.renormalised(x, "r", ["s_nationkey"]), 8).alias("r_star"))


def balanced_split(spark, d):
    b = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum(F.abs("c_acctbal")), 2).alias("area"), F.count("*").alias("n")).withColumn("stratum", F.col("c_nationkey") % 4)
    return sampling.balanced_halves(b, "c_nationkey", "stratum", "area").select("c_nationkey", "stratum", F.round("area", 2).alias("area"), "half")


BLOCKS = "b AS (SELECT c_nationkey, round(sum(abs(c_acctbal)), 2) AS area, count(*) AS n, c_nationkey % 4 AS stratum FROM customer GROUP BY 1), q AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY area DESC, c_nationkey) AS k FROM b), r AS (SELECT c_nationkey, stratum, area, n, k, 0 AS half, area AS lead FROM q WHERE k = 1 UNION ALL SELECT q.c_nationkey, q.stratum, q.area, q.n, q.k, CASE WHEN r.lead <= 0 THEN 0 ELSE 1 END, CASE WHEN r.lead <= 0 THEN r.lead + q.area ELSE r.lead - q.area END FROM r JOIN q ON q.stratum = r.stratum AND q.k = r.k + 1)"


def split_balance(spark, d):
    n = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    b = balanced_split(spark, d).join(n, "c_nationkey")
    return sampling.split_balance(b, "stratum", "area", least=100).select("stratum", "half", "blocks", F.round("area", 2).alias("area"), "rows", F.round("share_pct", 6).alias("share_pct"), "thin")


def breakpoint_shift(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("value_now"), F.avg("p_retailprice").alias("m"), (F.max("p_retailprice") - F.min("p_retailprice")).alias("span"))
    g = g.withColumn("value_proposed", F.col("value_now") + F.when(F.substring("p_brand", -1, 1).cast("int") % 2 == 0, 0.04).otherwise(0.06) * F.col("span"))
    return reports.breakpoint_gate(g).select("p_brand", F.round("delta_over_span", 7).alias("delta_over_span"), "move_breakpoint", "rewrite_note")


def footprint(spark, d):
    c = _grid(spark, d).select((F.col("gx") * 250.0).alias("x"), (F.col("gy") * 250.0 + F.when(F.col("gx") == 7, 100.0).otherwise(0.0)).alias("y"))
    return reports.footprint(c, "x", "y", 250.0)


def zone_gate(spark, d):
    return reports.zone_gate(table(spark, d, "customer").withColumn("a", F.when(F.col("c_nationkey") < 3, 0.0).otherwise(F.abs("c_acctbal"))), "c_nationkey", "a", 25).select("c_nationkey", F.round("area", 2).alias("area"), F.round("share_pct", 6).alias("share_pct"), "collapsed")


def unit_ranking(spark, d):
    u = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.round(F.avg("l_quantity") / 50, 9).alias("suit"), F.avg((F.col("l_returnflag") != "R").cast("double")).alias("unused"), F.avg("l_linenumber").alias("z"), F.round(F.avg(F.col("l_discount") - F.col("l_tax")), 9).alias("delta"))
    return reports.ranking(u, "suit", "unused", "z", "delta").select("list", "place", "unit", F.round("opportunity", 6).alias("opportunity"), "zone_id", F.round("delta", 6).alias("delta"))


def variance_themes(spark, d):
    s = Segment("v", (Factor("l_quantity", "increasing", (5, 40), 0.5), Factor("l_discount", "decreasing", (0.02, 0.09), 0.3), Factor("l_tax", "increasing", (0.01, 0.07), 0.2)), "arithmetic")
    shares = variance_shares(table(spark, d, "lineitem"), s)
    return reports.by_theme(shares, "factor", "share", (("l_q", "quantity"), ("l_t", "rate"), ("l_d", "rate")), "other").select("theme", F.round("share", 6).alias("share"))


def band_redundancy(spark, d):
    x = table(spark, d, "embeddings").select(*[c.alias(f"e{i}") for i, c in enumerate(zoning.embedding_columns(5))])
    return selection.correlations(x, [f"e{i}" for i in range(5)]).withColumn("r", F.round("r", 7))


def parsed_pairs(spark, d):
    """Values of key=value texts, and a list literal read as numbers."""
    x = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("presences="), F.col("n_nationkey") * 3, F.lit("; seed=42")).alias("extra"), F.concat(F.lit("["), F.col("n_nationkey"), F.lit(", 2.5, "), F.col("n_regionkey"), F.lit("]")).alias("points"))
    return x.select("n_nationkey", F.regexp_extract("extra", "presences=([0-9]+)", 1).cast("long").alias("presences"), F.round(F.aggregate(F.from_json("points", "array<double>"), F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def k_panel(spark, d):
    """Inertia and the rest of the panel for each number of zones, beside the hold-out's agreement."""
    x = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 2).cast("int").alias("split"), *[c.alias(f"e{i}") for i, c in enumerate(zoning.embedding_columns(4))])
    names = [f"e{i}" for i in range(4)]
    return selection.panel(x, names, (2, 3), references=2).join(selection.holdout(x, "split", names, (2, 3)).select("k", F.col("ari").alias("ari_holdout")), "k")


def forest_kappa(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("y"), (F.col("l_extendedprice") > 35000).cast("int").alias("given"), "l_extendedprice", "l_discount", (F.col("l_orderkey") % 2 == 0).alias("calib"))
    return selection.forest_kappa(x, ["l_extendedprice", "l_discount"], "y", "given", "calib", trees=20)


def _ra_sql(lat: str) -> str:
    j = "(2 * pi() / 365 * (30.4 * m - 15))"
    dec, phi = f"(0.409 * sin({j} - 1.39))", f"radians({lat})"
    ws = f"acos(greatest(-1, least(1, -tan({phi}) * tan({dec}))))"
    return f"(SELECT avg(({ws} * sin({phi}) * sin({dec}) + cos({phi}) * cos({dec}) * sin({ws})) * {24 * 60 / math.pi * bands.SOLAR!r} * (1 + 0.033 * cos({j}))) FROM range(1, 13) t(m)) * 11.574"


_R = lambda over, v: f"rank() OVER ({over} ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"
_C = "c AS (SELECT (l_orderkey % 48)::INT AS gx, (l_partkey % 48)::INT AS gy, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
_ROUGH = "SELECT a.gx, a.gy, {r} AS radius, (stddev_pop(b.a) + stddev_pop(b.b)) / 2 AS one, stddev_pop(b.c) AS two FROM c a JOIN c b ON (a.gx - b.gx) ^ 2 + (a.gy - b.gy) ^ 2 <= {r} * {r} GROUP BY 1, 2"
QUERIES = {
    "soil_bands": (soil_bands, "SELECT l_suppkey, round(avg((l_quantity + l_linenumber + 100 * l_tax) / 3 * 0.1), 7) AS clay, round(avg((l_quantity + l_linenumber + 100 * l_tax) / 3 * 0.01), 7) AS ph FROM lineitem GROUP BY 1"),
    "landcover_bands": (landcover_bands, "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2), g AS (SELECT user_id, first(event_type ORDER BY n DESC, event_type) AS mode, sum(CASE WHEN event_type = 'purchase' THEN n ELSE 0 END) / sum(n) AS b, sum(CASE WHEN event_type IN ('view', 'click') THEN n ELSE 0 END) / sum(n) AS l FROM n GROUP BY 1) SELECT user_id, mode, round(b, 7) AS buy_frac, round(l, 7) AS look_frac, (mode = 'view')::INT AS mask_excluded, (mode <> 'view')::INT AS mask_available FROM g"),
    "realized_use": (realized_use, "WITH n AS (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 5 END AS r, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT l_suppkey, first(r ORDER BY n DESC, r) AS mode, " + ", ".join(f"coalesce(sum(n) FILTER (r IN ({c})), 0) / sum(n) AS {k}" for k, c in (("a", "1"), ("b", "2"), ("c", "5"), ("m", "1, 2, 3, 5"))) + " FROM n GROUP BY 1) SELECT l_suppkey, mode::INT AS mode, round(a, 7) AS soybean_frac, round(b, 7) AS cane_frac, round(c, 7) AS pasture_frac, round(m, 7) AS managed_frac, (mode <> 5)::INT AS mask_available FROM g"),
    "productivity": (productivity, "SELECT l_suppkey, round(avg(l_extendedprice * 0.0001) FILTER (l_extendedprice < 60000), 8) AS value, count(*) FILTER (l_extendedprice < 60000) AS n FROM lineitem GROUP BY 1"),
    "season_productivity": (season_productivity, "SELECT l_returnflag, round(avg(l_extendedprice * 0.0001) FILTER (l_extendedprice < 60000), 8) AS value, count(*) FILTER (l_extendedprice < 60000) AS n FROM lineitem WHERE month(l_shipdate) IN (10, 11, 12, 1, 2, 3) AND year(l_shipdate) BETWEEN 1996 AND 1998 GROUP BY 1"),
    "radiation": (radiation, f"WITH s AS (SELECT s_suppkey, s_nationkey * 2.5 - 30 AS lat FROM supplier) SELECT s_suppkey, round({_ra_sql('lat')}, 5) AS ra FROM s"),
    "siting_bands": (siting_bands, f"WITH s AS (SELECT s_suppkey, s_acctbal, s_nationkey * 2.5 - 30 AS lat FROM supplier) SELECT s_suppkey, round(greatest(0, least(1, s_acctbal / 20 / greatest({_ra_sql('lat')}, 1e-6))), 7)::DOUBLE AS clearness FROM s"),
    "swapped_stack": (swapped_stack, "WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, (p_size % 7)::DOUBLE AS b, greatest(0, least(1, (p_retailprice - 900) / 900)) AS r FROM part), s AS (SELECT p_partkey, 0.5 * greatest(0, least(1, (a - 5) / 35)) + 0.3 * greatest(0, least(1, (6 - b) / 5)) + 0.2 * r AS now, 0.5 * greatest(0, least(1, (a * 1.1 - 5) / 35)) + 0.3 * greatest(0, least(1, (6 - (b - 1)) / 5)) + 0.2 * r AS later FROM p) SELECT p_partkey, round(later, 7) AS future, round(later - now, 7) AS delta FROM s"),
    "mask_swap": (mask_swap, "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 2)::INT END AS mask_available, c_mktsegment FROM customer"),
    "water_bands": (water_bands, f"WITH {_C} SELECT a.gx, a.gy, " + ", ".join(f"(SELECT round(sqrt(min((a.gx - b.gx) ^ 2 + (a.gy - b.gy) ^ 2)) * 250, 4)::DOUBLE FROM c b WHERE b.v * 2 > {t}) AS d{t}" for t in (80, 50)) + ", (SELECT round(avg((b.v * 2 > 50)::INT), 7) FROM c b WHERE (a.gx - b.gx) ^ 2 + (a.gy - b.gy) ^ 2 <= 4) AS density FROM c a"),
    "theme_roughness": (theme_roughness, f"WITH {_C.replace('c AS', 'c0 AS')}, c AS (SELECT gx, gy, v AS a, v * gx AS b, gy::DOUBLE AS c FROM c0), r AS ({_ROUGH.format(r=1)} UNION ALL {_ROUGH.format(r=2)}) SELECT 'one' AS grp, radius::INT AS radius, round(avg(one), 6) AS mean_std, round(stddev_pop(one), 6) AS sd_std, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'two', radius::INT, round(avg(two), 6), round(stddev_pop(two), 6), count(*) FROM r GROUP BY 2"),
    "polygon_burn": (polygon_burn, _burn_sql()),
    "relative_change": (relative_change, "WITH g AS (SELECT l_returnflag, avg((year(l_shipdate) <= 1997)::INT) AS a, avg((l_quantity > 30)::INT) AS b FROM lineitem GROUP BY 1) SELECT l_returnflag, round(100 * (b - a), 7) AS change_pp, round(100 * (b - a) / nullif(a, 0), 7) AS change_pct FROM g"),
    "interpolated": (interpolated, "WITH t AS (SELECT p_size AS x, avg(p_retailprice) AS y FROM part GROUP BY 1), l AS (SELECT * FROM t WHERE x <= 17.25 ORDER BY x DESC LIMIT 1), h AS (SELECT * FROM t WHERE x >= 17.25 ORDER BY x LIMIT 1) SELECT round(l.y + (17.25 - l.x) / (h.x - l.x) * (h.y - l.y), 7) AS value FROM l, h"),
    "within_gradient": (within_gradient, f"WITH x AS (SELECT o_totalprice AS x, o_custkey::DOUBLE AS y FROM orders), r AS (SELECT {_R('', 'x')} AS a, {_R('', 'y')} AS b FROM x), e AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS e FROM x), g AS (SELECT ((x > e[1])::INT + (x > e[2])::INT + (x > e[3])::INT + (x > e[4])::INT)::INT AS bin, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM x, e GROUP BY 1), s AS (SELECT *, my - lag(my) OVER (ORDER BY bin) AS d FROM g) SELECT bin, n, round(mx, 6) AS mean_x, round(my, 6) AS mean_y, (SELECT round(corr(a, b), 6) FROM r) AS rho, (SELECT bool_and(d >= 0) FROM s) AS monotonic FROM s"),
    "boyce_index": (boyce_index, f"WITH x AS (SELECT l_quantity / 50 AS s, (l_returnflag = 'R')::INT AS y FROM lineitem), c AS (SELECT 0.05 + i * 0.9 / 9 AS centre FROM range(10) t(i)), w AS (SELECT centre, (sum(y) / (SELECT sum(y) FROM x)) / (count(*) / (SELECT count(*) FROM x)) AS pe FROM c JOIN x ON s >= centre - 0.05 AND s <= centre + 0.05 GROUP BY 1), r AS (SELECT {_R('', 'centre')} AS a, {_R('', 'pe')} AS b FROM w) SELECT round(corr(a, b), 7) AS boyce, count(*) AS n FROM r"),
    "hindcast_bias": (hindcast_bias, "WITH x AS (SELECT *, month(l_shipdate) AS m FROM lineitem WHERE year(l_shipdate) <= 1997), a AS (SELECT l_returnflag, m, avg(l_quantity) AS p, avg(l_discount) AS t FROM x GROUP BY 1, 2), b AS (SELECT l_returnflag, sum(p) AS p, avg(t) AS t FROM a GROUP BY 1), o AS (SELECT m, avg(l_quantity) AS p, avg(l_discount) AS t FROM x GROUP BY 1) SELECT round((SELECT avg(p) FROM b) - (SELECT sum(p) FROM o), 7) AS bias_pr, round((SELECT avg(t) FROM b) - (SELECT avg(t) FROM o), 9) AS bias_t"),
    "shift_table": (shift_table, f"WITH {SHIFT} " + " UNION ALL ".join(f"SELECT {n} AS segment, round(avg(d{n}), 6) AS delta_s, round(avg((round(f{n} - d{n}, 9) >= 0.5)::INT), 6) AS present_share, round(avg((round(f{n}, 9) >= 0.5)::INT), 6) AS future_share FROM m" for n in (1, 2))),
    "zone_shift": (zone_shift, f"WITH {SHIFT} SELECT l_linestatus, 'alpha' AS segment, round(avg(d1), 7) AS delta_s FROM m GROUP BY 1 UNION ALL SELECT l_linestatus, 'beta', round(avg(d2), 7) FROM m GROUP BY 1"),
    "renormalised_priorities": (renormalised_priorities, "SELECT s_suppkey, round(abs(s_acctbal) / sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey), 8) AS r_star FROM supplier"),
    "balanced_split": (balanced_split, f"WITH RECURSIVE {BLOCKS} SELECT c_nationkey, stratum, round(area, 2) AS area, half::INT AS half FROM r"),
    "split_balance": (split_balance, f"WITH RECURSIVE {BLOCKS} SELECT stratum, half::INT AS half, count(*) AS blocks, round(sum(area), 2) AS area, sum(n)::BIGINT AS rows, round(100 * sum(area) / sum(sum(area)) OVER (PARTITION BY stratum), 6) AS share_pct, sum(n) < 100 AS thin FROM r GROUP BY 1, 2"),
    "breakpoint_shift": (breakpoint_shift, "WITH g AS (SELECT p_brand, min(p_retailprice) AS a, max(p_retailprice) - min(p_retailprice) AS s FROM part GROUP BY 1), h AS (SELECT *, CASE WHEN right(p_brand, 1)::INT % 2 = 0 THEN 0.04 ELSE 0.06 END AS f FROM g) SELECT p_brand, round(CASE WHEN s <> 0 THEN f END, 7)::DOUBLE AS delta_over_span, CASE WHEN s <> 0 THEN f >= 0.05 END AS move_breakpoint, CASE WHEN s <> 0 THEN f < 0.05 AND f * s / a > 0.001 END AS rewrite_note FROM h"),
    "footprint": (footprint, f"WITH {_C}, p AS (SELECT gx * 250.0 AS x, gy * 250.0 + CASE WHEN gx = 7 THEN 100 ELSE 0 END AS y FROM c), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p) SELECT x0::DOUBLE AS x0, x1::DOUBLE AS x1, y0::DOUBLE AS y0, y1::DOUBLE AS y1, count(*) AS n, sum(((x - x0) % 250 <> 0 OR (y - y0) % 250 <> 0)::INT)::BIGINT AS off_grid FROM p, b GROUP BY 1, 2, 3, 4"),
    "zone_gate": (zone_gate, "WITH g AS (SELECT c_nationkey, sum(CASE WHEN c_nationkey < 3 THEN 0.0 ELSE abs(c_acctbal) END) AS a FROM customer GROUP BY 1) SELECT c_nationkey, round(a, 2) AS area, round(100 * a / (SELECT sum(a) FROM g), 6) AS share_pct, (SELECT count(*) FROM g WHERE a > 0) < 25 AS collapsed FROM g"),
    "unit_ranking": (unit_ranking, "WITH u AS (SELECT l_suppkey AS unit, round(avg(l_quantity) / 50, 9) AS s, avg((l_returnflag <> 'R')::INT) AS n, avg(l_linenumber) AS z, round(avg(l_discount - l_tax), 9) AS delta FROM lineitem GROUP BY 1), r AS (SELECT *, s * n AS opportunity, row_number() OVER (ORDER BY s * n DESC, unit) AS ro, row_number() OVER (ORDER BY delta, unit) AS rv FROM u) SELECT 'opportunity' AS list, ro::INT AS place, unit, round(opportunity, 6) AS opportunity, round(z)::INT + 1 AS zone_id, round(delta, 6) AS delta FROM r WHERE ro <= 5 UNION ALL SELECT 'vulnerability', rv::INT, unit, round(opportunity, 6), round(z)::INT + 1, round(delta, 6) FROM r WHERE rv <= 5"),
    "variance_themes": (variance_themes, "WITH m AS (SELECT greatest(0, least(1, (l_quantity - 5) / 35)) AS a, greatest(0, least(1, (0.09 - l_discount) / (0.09 - 0.02))) AS b, greatest(0, least(1, (l_tax - 0.01) / (0.07 - 0.01))) AS c FROM lineitem), t AS (SELECT *, 0.5 * a + 0.3 * b + 0.2 * c AS t FROM m) SELECT 'quantity' AS theme, round(0.5 * covar_pop(a, t) / var_pop(t), 6) AS share FROM t UNION ALL SELECT 'rate', round((0.3 * covar_pop(b, t) + 0.2 * covar_pop(c, t)) / var_pop(t), 6) FROM t"),
    "band_redundancy": (band_redundancy, "WITH x AS (SELECT " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(5)) + " FROM embeddings) " + " UNION ALL ".join(f"SELECT 'e{i}' AS a, 'e{j}' AS b, round(corr(e{i}, e{j}), 7) AS r FROM x" for i in range(5) for j in range(i + 1, 5))),
    "parsed_pairs": (parsed_pairs, "SELECT n_nationkey, (n_nationkey * 3)::BIGINT AS presences, (n_nationkey + 2.5 + n_regionkey)::DOUBLE AS total FROM nation"),
    "k_panel": (k_panel, None),
    "forest_kappa": (forest_kappa, None),
}
