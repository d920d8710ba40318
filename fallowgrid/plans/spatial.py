"""Queries of polygon unions, reference systems, nearest geometries and distances between zones."""

from __future__ import annotations


import uuid

from pyspark.sql import functions as F

from ..functions import projections
from ..functions.membership import quantize
from ..operators import blocks, overlay, proximity, selection, suites, tiles, zoning
from ..sources import tile_archive
from ..sources.tables import shared_dir, table
from .analytics import _C as _CENTRES
from .analytics import _grid
from .features import _C
from .reporting import HALF, RHO_P, _split


def _ring(*corners):
    return F.array(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners]))


def union_area(spark, d):
    """Areas and perimeters of unions of overlapping boxes, one group per label."""
    x, y = (F.floor(F.col("embedding")[i].cast("double") * 100) for i in (0, 1))
    w, h = (F.floor(F.abs(F.col("embedding")[i].cast("double")) * 40) + 1 for i in (2, 3))
    e = table(spark, d, "embeddings").select("label", _ring(*[(a.cast("double"), b.cast("double")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]).alias("rings"))
    u = overlay.union_area(e, ["label"], 1e-4)
    return u.select("label", F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"))


UNION_SQL = """
WITH b AS (SELECT label, floor(embedding[1]::DOUBLE * 100)::INT AS x, floor(embedding[2]::DOUBLE * 100)::INT AS y, floor(abs(embedding[3]::DOUBLE) * 40)::INT + 1 AS w, floor(abs(embedding[4]::DOUBLE) * 40)::INT + 1 AS h FROM embeddings),
c AS (SELECT DISTINCT label, x + i AS x, y + j AS y FROM (SELECT *, unnest(range(w)) AS i FROM b) CROSS JOIN LATERAL (SELECT unnest(range(h)) AS j)),
n AS (SELECT c.label, count(*) AS area, sum((SELECT 4 - count(*) FROM c o WHERE o.label = c.label AND abs(o.x - c.x) + abs(o.y - c.y) = 1)) AS perimeter FROM c GROUP BY 1)
SELECT label, area::DOUBLE AS area, perimeter::DOUBLE AS perimeter FROM n"""

_UTM = projections.utm(22, True, projections.GRS80)
_CONE = projections.System("albers", *projections.GRS80, lon0=-60, lat0=-32, lat1=-5, lat2=-42)


def _degrees(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 8 - 51).alias("lon"), (F.col("embedding")[1].cast("double") * 20 - 16).alias("lat"))


def projected_points(spark, d):
    """Transverse Mercator and Albers coordinates, and whether both come back to within a tenth of a millimetre."""
    p = _degrees(spark, d)
    for name, system in (("t", _UTM), ("a", _CONE)):
        p = p.withColumns(dict(zip((f"{name}x", f"{name}y"), projections.forward(system, F.col("lon"), F.col("lat")), strict=True)))
        lon, lat = projections.inverse(system, F.col(f"{name}x"), F.col(f"{name}y"))
        p = p.withColumn(f"{name}back", (F.abs(lon - F.col("lon")) < 1e-9) & (F.abs(lat - F.col("lat")) < 1e-9))
    return p.select("vec_id", *[F.round(c, 4).alias(c) for c in ("tx", "ty", "ax", "ay")], (F.col("tback") & F.col("aback")).alias("back"))


def _projected_sql() -> str:
    there, _ = projections.kruger(_UTM)
    e, r = projections._ecc(_UTM), _UTM.scale * projections._radius(_UTM)
    series = lambda a, b: " + ".join(f"{k!r} * {a}({2 * j} * xi) * {b}({2 * j} * eta)" for j, k in enumerate(there, 1))
    n, c, rho0 = projections._cone(_CONE)
    q = f"(1 - {e!r} ^ 2) * (sin(f) / (1 - ({e!r} * sin(f)) ^ 2) + atanh({e!r} * sin(f)) / {e!r})"
    return f"""
WITH p AS (SELECT vec_id, radians(embedding[1]::DOUBLE * 8 - 51) AS l, radians(embedding[2]::DOUBLE * 20 - 16) AS f FROM embeddings),
t AS (SELECT *, sinh(atanh(sin(f)) - {e!r} * atanh({e!r} * sin(f))) AS t, l - radians({_UTM.lon0!r}) AS w, sqrt({c!r} - {n!r} * {q}) * {_CONE.axis / n!r} AS rho, {n!r} * (l - radians({float(_CONE.lon0)!r})) AS theta FROM p),
k AS (SELECT *, atan2(t, cos(w)) AS xi, asinh(sin(w) / sqrt(t * t + cos(w) ^ 2)) AS eta FROM t)
SELECT vec_id, round({r!r} * (eta + {series("cos", "sinh")}) + 500000, 4) AS tx, round({r!r} * (xi + {series("sin", "cosh")}) + 10000000, 4) AS ty,
  round(rho * sin(theta), 4) AS ax, round({rho0!r} - rho * cos(theta), 4) AS ay, true AS back FROM k"""


#: Triangles of protected areas, one a nation, in cells.
_AT = [("n_nationkey * 7 % 53 - 4", "n_nationkey * 11 % 47 - 2"), ("n_nationkey * 7 % 53 + n_nationkey % 3", "n_nationkey * 11 % 47 - 1"), ("n_nationkey * 7 % 53 - 3", "n_nationkey * 11 % 47 + n_nationkey % 4 + 1")]


def conservation_bands(spark, d):
    areas = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), _ring(*[(F.expr(f"CAST({x} AS DOUBLE) * 250"), F.expr(f"CAST({y} AS DOUBLE) * 250")) for x, y in _AT]).alias("rings"))
    cells = _grid(spark, d).select("gx", "gy", F.col("v").cast("double").alias("elevation"))
    coarse = cells.groupBy(F.floor(F.col("gx") / 4).cast("int").alias("gx"), F.floor(F.col("gy") / 4).cast("int").alias("gy")).agg(F.avg("elevation").alias("carbon"))
    b = proximity.conservation(cells, areas, 250.0, biomass=coarse, step=4, side=250.0)
    return b.select("gx", "gy", F.round("pa_dist", 4).alias("pa_dist"), F.round("ruggedness", 6).alias("ruggedness"), F.round("carbon", 6).alias("carbon"))


_EDGES = ", ".join(f"[{', '.join(f'(250 * ({v}))::DOUBLE' for v in (*_AT[i], *_AT[(i + 1) % 3]))}]" for i in range(3))
CONSERVATION_SQL = f"""
WITH {_C}, p AS (SELECT gx, gy, v, (gx + 0.5) * 250.0::DOUBLE AS x, (gy + 0.5) * 250.0::DOUBLE AS y FROM c),
s AS (SELECT n_nationkey AS id, unnest([{_EDGES}]) AS s FROM nation), e AS (SELECT id, s[1] AS ax, s[2] AS ay, s[3] AS bx, s[4] AS cy FROM s),
i AS (SELECT DISTINCT gx, gy FROM (SELECT gx, gy, id FROM p, e WHERE (ay > y) <> (cy > y) AND x < ax + (y - ay) * (bx - ax) / (cy - ay) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)),
t AS (SELECT gx, gy, x, y, ax, ay, bx, cy, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (cy - ay)) / ((bx - ax) ^ 2 + (cy - ay) ^ 2))) AS t FROM p, e),
n AS (SELECT gx, gy, min(sqrt((x - ax - t * (bx - ax)) ^ 2 + (y - ay - t * (cy - ay)) ^ 2)) AS d FROM t GROUP BY 1, 2),
r AS (SELECT a.gx, a.gy, stddev_pop(b.v) AS ruggedness FROM c a JOIN c b ON (a.gx - b.gx) ^ 2 + (a.gy - b.gy) ^ 2 <= 9 GROUP BY 1, 2),
o AS (SELECT gx // 4 AS cx, gy // 4 AS cy, avg(v) AS v FROM c GROUP BY 1, 2),
w AS (SELECT gx, gy, sum(o.v * (1 - abs((gx + 0.5) / 4 - 0.5 - o.cx)) * (1 - abs((gy + 0.5) / 4 - 0.5 - o.cy))) / sum((1 - abs((gx + 0.5) / 4 - 0.5 - o.cx)) * (1 - abs((gy + 0.5) / 4 - 0.5 - o.cy))) AS carbon
  FROM c JOIN o ON o.cx BETWEEN floor((gx + 0.5) / 4 - 0.5) AND floor((gx + 0.5) / 4 - 0.5) + 1 AND o.cy BETWEEN floor((gy + 0.5) / 4 - 0.5) AND floor((gy + 0.5) / 4 - 0.5) + 1 GROUP BY 1, 2)
SELECT n.gx, n.gy, round(CASE WHEN i.gx IS NULL THEN d ELSE 0 END, 4) AS pa_dist, round(ruggedness, 6) AS ruggedness, round(carbon, 6) AS carbon
FROM n LEFT JOIN i USING (gx, gy) JOIN r USING (gx, gy) JOIN w USING (gx, gy)"""


def zone_silhouette(spark, d):
    """Euclidean silhouette of fixed zones in the space that made them and in another one."""
    x = table(spark, d, "embeddings").select("vec_id", *[c.alias(f"e{i}") for i, c in enumerate(zoning.embedding_columns(10))])
    x = x.withColumn("zone", zoning.nearest([F.col(f"e{i}") for i in range(6)], _CENTRES))
    found = [(name, zoning.silhouette(x, columns, key="vec_id")) for name, columns in (("own", [f"e{i}" for i in range(6)]), ("other", [f"e{i}" for i in range(6, 10)]))]
    return spark.createDataFrame(found, "space string, silhouette double").select("space", F.round("silhouette", 8).alias("silhouette"))


def _silhouette_sql() -> str:
    gap = [" + ".join(f"(e{j} - ({c}))^2" for j, c in enumerate(row)) for row in _CENTRES]
    first = "CASE " + " ".join(f"WHEN g[{i + 1}] = list_min(g) THEN {i}" for i in range(len(gap))) + " END"
    e = ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(10))
    parts = []
    for name, dims in (("own", range(6)), ("other", range(6, 10))):
        far = "sqrt(" + " + ".join(f"(a.e{i} - b.e{i})^2" for i in dims) + ")"
        parts.append(f"""SELECT '{name}' AS space, round(avg(CASE WHEN own_n < 2 THEN 0 ELSE (o - i) / greatest(o, i) END), 8) AS silhouette FROM (
  SELECT vec_id, max(n) FILTER (own) AS own_n, max(s / greatest(n - 1, 1)) FILTER (own) AS i, min(s / n) FILTER (NOT own) AS o FROM (
    SELECT a.vec_id, b.zone = a.zone AS own, b.zone, sum({far}) AS s, count(*) AS n FROM z a, z b GROUP BY a.vec_id, b.zone, a.zone) GROUP BY vec_id)""")
    return f"WITH x AS (SELECT vec_id, {e} FROM embeddings), y AS (SELECT *, [{', '.join(gap)}] AS g FROM x), z AS (SELECT *, {first} AS zone FROM y) " + " UNION ALL ".join(parts)


def space_comparison(spark, d):
    """How fixed zones separate on the first components of all bands and of a themed selection; components are fitted, so there is no SQL."""
    x = table(spark, d, "embeddings").select("vec_id", *[c.alias(f"{'abc'[i % 3]}_{i}") for i, c in enumerate(zoning.embedding_columns(10))])
    x = x.withColumn("zone", zoning.nearest([F.col(f"{'abc'[i % 3]}_{i}") for i in range(6)], _CENTRES))
    names = [f"{'abc'[i % 3]}_{i}" for i in range(10)]
    return zoning.compare_spaces(x, {"full": (names, False), "curated": (names[:5], True)}, "zone", key="vec_id")


def tile_levels(spark, d):
    """A quantised band as an archive of tiles, read back: pixels and their sum by level and tile."""
    tile_archive.register(spark)
    path = f"{shared_dir(spark)}/fallowgrid/tiles-{uuid.uuid4().hex}"
    cells = _grid(spark, d).select("gx", "gy", quantize(F.col("v").cast("double"), 0.0, 51.0).cast("int").alias("v"))
    made = tiles.pyramid(cells, "v", 3, -62.3, -1.7, 0.5, tiles.ramp([(68, 1, 84), (33, 145, 140), (253, 231, 37)]), lowest=1)
    made.repartitionByRange("id").sortWithinPartitions("id").write.format("tile_archive").mode("overwrite").save(path)
    v = tiles.read_values(spark.read.format("tile_archive").load(path))
    return v.groupBy("z", F.floor(F.col("px") / 256).cast("int").alias("x"), F.floor(F.col("py") / 256).cast("int").alias("y")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


_UP = "SELECT px // 2 AS px, py // 2 AS py, ((2 * sum(value) + count(*)) // (2 * count(*)))::INT AS value FROM {} GROUP BY 1, 2"
TILES_SQL = f"""
WITH {_C}, q AS (SELECT gx, gy, round(greatest(0, least(1, v / 51.0)) * 254)::INT AS value FROM c),
x AS (SELECT i AS px, floor(((i + 0.5) * (360 / 2048.0::DOUBLE) - 180 + 62.3) / 0.5)::INT AS gx FROM range(2048) t(i)),
y AS (SELECT i AS py, floor((-1.7 - degrees(atan(sinh(pi() * (1 - (i + 0.5) * (2 / 2048.0::DOUBLE)))))) / 0.5)::INT AS gy FROM range(2048) t(i)),
l3 AS (SELECT px, py, value FROM q JOIN x USING (gx) JOIN y USING (gy)), l2 AS ({_UP.format("l3")}), l1 AS ({_UP.format("l2")}),
a AS (SELECT 3 AS z, * FROM l3 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 1, * FROM l1)
SELECT z::INT AS z, (px // 256)::INT AS x, (py // 256)::INT AS y, count(*) AS n, sum(value)::BIGINT AS total FROM a GROUP BY 1, 2, 3"""

def block_sizing(spark, d):
    """Semivariograms of a score, its presence and their difference over great-circle lags, and what they say about blocks."""
    e = lambda i: F.col("embedding")[i].cast("double")
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (e(0) * 8 - 51).alias("lon"), (e(1) * 20 - 16).alias("lat"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 2 * e(0))).alias("s"), (F.col("label") < 3).cast("double").alias("y"))
    r, gate = blocks.block_sizing(p, {"crop": ("s", "y")}, 12, None, (100.0, 250.0), 10)
    return r.select("framing", "window", *[F.round(c, 6).alias(c) for c in ("block", "sill", "nugget_share", "range", "shared")], "verdict", F.lit(gate).alias("gate"))


_FRAMES = ("fit", "presence", "residual")
BLOCKS_SQL = f"""
WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 8 - 51 AS lon, embedding[2]::DOUBLE * 20 - 16 AS lat, greatest(0, least(1, 0.5 + 2 * embedding[1]::DOUBLE)) AS s, (label < 3)::INT::DOUBLE AS y FROM embeddings),
k AS (SELECT (max(lon) - min(lon)) * 111.0 * cos(radians((max(lat) + min(lat)) / 2)) / 12 AS block FROM p),
d AS (SELECT 2 * 6371.0 * asin(sqrt(least(1, sin(radians(a.lat - b.lat) / 2) ^ 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(a.lon - b.lon) / 2) ^ 2))) AS h,
  (a.s - b.s) ^ 2 AS fit, (a.y - b.y) ^ 2 AS presence, (a.y - a.s - b.y + b.s) ^ 2 AS residual FROM p a JOIN p b ON a.id < b.id),
w AS (SELECT unnest([100.0, 250.0])::DOUBLE AS w), f AS (SELECT unnest(['fit', 'presence', 'residual']) AS framing),
l AS (SELECT w, (ceil(h / (w / 10)) - 1)::INT AS bin, framing, CASE framing WHEN 'fit' THEN fit WHEN 'presence' THEN presence ELSE residual END AS g FROM d, w, f WHERE h > 0 AND h <= w),
t AS (SELECT w, framing, bin, sum(g) / (2 * count(*)) AS gamma FROM l GROUP BY 1, 2, 3),
e AS (SELECT w, framing, i::INT AS bin, (i + 0.5) * w / 10 AS centre, gamma, max(gamma) OVER (PARTITION BY w, framing ORDER BY i) AS env FROM w CROSS JOIN f CROSS JOIN range(10) r(i) LEFT JOIN t USING (w, framing) WHERE t.bin = i OR t.bin IS NULL),
g AS (SELECT w, framing, avg(env) FILTER (bin >= 8) AS sill, arg_min(gamma, bin) FILTER (gamma IS NOT NULL) AS nugget, max(env) AS top FROM e GROUP BY 1, 2),
r AS (SELECT g.w, g.framing, sill, nugget, block, (SELECT min(centre) FROM e WHERE e.w = g.w AND e.framing = g.framing AND gamma IS NOT NULL AND env >= 0.95 * sill AND top <= 1.05 * sill) AS range,
  (SELECT max(centre) FROM e WHERE e.w = g.w AND e.framing = g.framing AND centre <= block) AS c0, (SELECT min(centre) FROM e WHERE e.w = g.w AND e.framing = g.framing AND centre >= block) AS c1 FROM g, k),
a AS (SELECT r.*, x.gamma AS g0, y.gamma AS g1 FROM r LEFT JOIN e x ON x.w = r.w AND x.framing = r.framing AND x.centre = c0 LEFT JOIN e y ON y.w = r.w AND y.framing = r.framing AND y.centre = c1),
b AS (SELECT *, CASE WHEN c0 IS NULL THEN g1 WHEN c1 IS NULL OR c0 = c1 THEN g0 ELSE g0 + (g1 - g0) * (block - c0) / (c1 - c0) END AS here FROM a),
v AS (SELECT framing, w, block, sill, nugget / sill AS nugget_share, range, CASE WHEN sill > nugget THEN greatest(0, least(1, (sill - here) / (sill - nugget))) END AS shared FROM b),
z AS (SELECT max(range) AS worst FROM v WHERE framing = 'residual' AND w = 100)
SELECT framing, w AS "window", round(v.block, 6) AS block, round(sill, 6) AS sill, round(nugget_share, 6) AS nugget_share, round(range, 6) AS range, round(shared, 6) AS shared,
  CASE WHEN nugget_share > 0.95 THEN 'uninterpretable' WHEN framing = 'fit' THEN 'context only' WHEN range IS NULL THEN 'no plateau in window' WHEN range < v.block THEN 'ok' WHEN range < 2 * v.block THEN 'caveat' ELSE 'fail' END AS verdict,
  CASE WHEN worst IS NULL OR worst >= 2 * v.block THEN 'no-go' WHEN worst < v.block THEN 'go' ELSE 'caveat' END AS gate FROM v, z"""


def crop_gradients(spark, d):
    """The score against the proxy inside each segment's own cells, by segment and half."""
    x = _split(spark, d).select("split", (F.col("l_quantity") / 50).alias("a"), (F.col("l_extendedprice") / 110000).alias("b"), F.col("l_returnflag").alias("role"), (F.col("l_extendedprice") * F.col("l_tax")).alias("gpp"))
    r = suites.within_crop(x, "split", {"alpha": ("a", "R"), "beta": ("b", "A"), "none": ("a", "X")}, "role", "gpp")
    return r.select("metric", "segment", "half", F.round("value", 6).alias("value"), "n", F.round("p", 5).alias("p"), "monotonic")


def _ranked(v: str) -> str:
    return f"rank() OVER (PARTITION BY segment, half ORDER BY {v}) + (count(*) OVER (PARTITION BY segment, half, {v}) - 1) / 2.0"


GRADIENTS_SQL = f"""
WITH x AS (SELECT {HALF}, 'alpha' AS segment, l_quantity / 50 AS s, l_extendedprice * l_tax AS y FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT {HALF}, 'beta', l_extendedprice / 110000, l_extendedprice * l_tax FROM lineitem WHERE l_returnflag = 'A'),
r AS (SELECT segment, half, {_ranked("s")} AS a, {_ranked("y")} AS b FROM x),
q AS (SELECT segment, half, round(corr(a, b), 12) AS rho, count(*) AS n FROM r GROUP BY 1, 2),
e AS (SELECT segment, half, quantile_cont(s, [0.2, 0.4, 0.6, 0.8]) AS e, min(s) AS lo, max(s) AS hi FROM x GROUP BY 1, 2),
g AS (SELECT segment, half, len(list_filter(list_distinct(e), lambda v: v > lo AND v < hi AND v < s)) AS bin, avg(y) AS m FROM x JOIN e USING (segment, half) GROUP BY 1, 2, 3),
m AS (SELECT segment, half, bool_and(d >= 0) AS monotonic FROM (SELECT *, m - lag(m) OVER (PARTITION BY segment, half ORDER BY bin) AS d FROM g) GROUP BY 1, 2)
SELECT 'within_crop_rho' AS metric, segment, half, round(rho, 6) AS value, n, round({RHO_P}, 5) AS p, monotonic FROM q JOIN m USING (segment, half) WHERE n >= 50"""

def candidate_axes(spark, d):
    """Which further bands may be axes of the zoning: gates by correlation, components and partition; fitted, so there is no SQL."""
    e = zoning.embedding_columns(8)
    x = table(spark, d, "embeddings").select(*[c.alias(f"{'ab'[i % 2]}_{i}") for i, c in enumerate(e)], (e[0] + 0.05 * e[7]).alias("c_copy"), (e[1] + 0.3 * e[6]).alias("c_near"), F.col("label").cast("double").alias("c_label"))
    return selection.probe_candidates(x, [f"{'ab'[i % 2]}_{i}" for i in range(6)], {"c_copy": True, "c_label": False, "a_6": True, "b_7": True}, [("c_near", "b_1")], 4)


QUERIES = {
    "candidate_axes": (candidate_axes, None),
    "block_sizing": (block_sizing, BLOCKS_SQL),
    "crop_gradients": (crop_gradients, GRADIENTS_SQL),
    "tile_levels": (tile_levels, TILES_SQL),
    "union_area": (union_area, UNION_SQL),
    "projected_points": (projected_points, _projected_sql()),
    "conservation_bands": (conservation_bands, CONSERVATION_SQL),
    "zone_silhouette": (zone_silhouette, _silhouette_sql()),
    "space_comparison": (space_comparison, None),
}
