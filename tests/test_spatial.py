"""Reference systems, simplified outlines, nearest geometries, Euclidean silhouettes."""

import math
import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fallowgrid.functions import projections
from fallowgrid.operators import proximity, zoning
from fallowgrid.sources import vectors

UTM = 'PROJCS["SIRGAS 2000 / UTM zone 22S",GEOGCS["SIRGAS 2000",DATUM["D",SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",-51],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",10000000],UNIT["metre",1]]'
GEO = 'GEOGCS["SIRGAS 2000",DATUM["D",SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'


def test_systems_of_files():
    assert projections.parse(UTM) == projections.from_code(31982) == projections.utm(22, True, projections.GRS80)
    assert projections.parse(GEO).kind == "degrees" and projections.from_code(32631).lon0 == 3 and projections.from_code(31972) == projections.utm(18, False, projections.GRS80)
    for bad in ("LOCAL[]", UTM.replace("Transverse_Mercator", "Polyconic"), UTM.replace('"metre",1]', '"foot",0.3048]')):
        with pytest.raises(ValueError):
            projections.parse(bad)
    with pytest.raises(ValueError):
        projections.from_code(5880)


def test_lengths_along_a_meridian_and_areas(spark):
    """Independent of the series: the meridian's length by its integral, Albers areas by the sphere's zone formula on the ellipsoid."""
    a, f = projections.GRS80[0], 1 / projections.GRS80[1]
    e2 = f * (2 - f)
    phi = np.linspace(0, math.radians(-16.5), 200_001)
    mid = (phi[1:] + phi[:-1]) / 2
    length = float((a * (1 - e2) / (1 - e2 * np.sin(mid) ** 2) ** 1.5 * np.diff(phi)).sum())
    x, y = projections.forward(projections.utm(22, True, projections.GRS80), F.lit(-51.0), F.lit(-16.5))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(500_000, abs=1e-6) and r.y == pytest.approx(1e7 + 0.9996 * length, abs=1e-4)
    cone = projections.System("albers", *projections.GRS80, lon0=-60, lat0=-32, lat1=-5, lat2=-42)
    corners = [(-52 + i / 200, -17.0) for i in range(200)] + [(-51, -17 + i / 200) for i in range(200)] + [(-51 - i / 200, -16.0) for i in range(200)] + [(-52, -16 - i / 200) for i in range(200)]
    x, y = projections.forward(cone, F.col("lon"), F.col("lat"))
    p = np.array([tuple(r) for r in spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(corners)], "i int, lon double, lat double").orderBy("i").select(x, y).collect()])
    area = ((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum()) / 2
    q = lambda lat: (1 - e2) * (math.sin(lat) / (1 - e2 * math.sin(lat) ** 2) + math.atanh(math.sqrt(e2) * math.sin(lat)) / math.sqrt(e2))
    assert area == pytest.approx(a * a / 2 * math.radians(1) * (q(math.radians(-16)) - q(math.radians(-17))), rel=1e-6)


@pytest.mark.parametrize("system", [projections.utm(23, True), projections.System("albers", lon0=-54, lat0=-12, lat1=-2, lat2=-22), projections.System("web"), projections.System("albers", lon0=10, lat0=40, lat1=45, lat2=45)])
def test_round_trips(spark, system):
    df = spark.range(400).select((F.rand(1) * 8 + system.lon0 - 4).alias("lon"), (F.rand(2) * 60 - (30 if system.lat0 <= 0 else -10)).alias("lat"))
    lon, lat = projections.between(system, projections.System(), *projections.between(projections.System(), system, F.col("lon"), F.col("lat")))
    r = df.select(F.max(F.abs(lon - F.col("lon"))).alias("a"), F.max(F.abs(lat - F.col("lat"))).alias("b")).first()
    assert r.a < 1e-9 and r.b < 1e-9  # a tenth of a millimetre


def _plane(corners, spark, system):
    x, y = projections.forward(system, F.col("x"), F.col("y"))
    return [tuple(r) for r in spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(corners)], "i int, x double, y double").orderBy("i").select(x, y).collect()]


def test_files_in_their_own_systems(spark, tmp_path):
    """One zipped shapefile in metres and one in degrees; a GeoPackage that defines its system."""
    square = [(-50.0, -16.0), (-49.0, -16.0), (-49.0, -15.0), (-50.0, -15.0), (-50.0, -16.0)]
    plane = _plane(square, spark, projections.from_code(31982))

    def shp(points):
        body = struct.pack("<I4dIII", 5, 0, 0, 1, 1, 1, len(points), 0) + b"".join(struct.pack("<2d", *p) for p in points)
        return bytes(100) + struct.pack(">II", 1, len(body) // 2) + body

    field = b"UF".ljust(11, b"\0") + b"C" + bytes(4) + bytes([2]) + bytes(15)
    dbf = lambda v: struct.pack("<4sIHH", b"\x03\0\0\0", 1, 65, 3) + bytes(20) + field + b"\r" + b" " + v
    for name, points, prj, uf in (("a", plane, UTM, b"GO"), ("b", square, GEO, b"DF")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for kind, content in (("shp", shp(points)), ("dbf", dbf(uf)), ("prj", prj)):
                z.writestr(f"{name}.{kind}", content)
    read = vectors.shapefiles(spark, [str(tmp_path / "a.zip"), str(tmp_path / "b.zip")], expected=2, system=True)
    both = vectors.in_degrees(read)
    for r in both.collect():
        assert np.allclose([(p.x, p.y) for p in r.rings[0]], square, atol=1e-9)
    assert vectors.units(both, "UF", ["GO"], ["UF"]).select("UF").collect()[0][0] == "GO"
    outline = vectors.area_of_interest(both, tolerance=0.01, grid=1e-7).first().rings
    assert len(outline) == 1 and sorted((round(p.x, 5), round(p.y, 5)) for p in outline[0]) == sorted({(x, y) for x, y in square})
    con = sqlite3.connect(tmp_path / "u.gpkg")
    con.executescript("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT); INSERT INTO gpkg_geometry_columns VALUES ('u', 'g'); CREATE TABLE u (g BLOB); CREATE TABLE gpkg_spatial_ref_sys (srs_id INTEGER, definition TEXT)")
    con.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (31982, ?)", (UTM,))
    shape = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 5) + b"".join(struct.pack("<2d", *p) for p in plane)
    con.execute("INSERT INTO u VALUES (?)", (b"GP" + bytes([0, 1]) + struct.pack("<i", 31982) + shape,))
    con.commit()
    con.close()
    r = vectors.in_degrees(vectors.geopackage(spark, [str(tmp_path / "u.gpkg")], "u", system=True)).first()
    assert np.allclose([(p.x, p.y) for p in r.rings[0]], square, atol=1e-9)
    with pytest.raises(ValueError, match="without"):
        vectors.in_degrees(read.withColumn("system", F.lit(None).cast("string")))


def test_simplified_rings_stay_near(spark):
    turn = np.linspace(0, 2 * np.pi, 400)
    ring = [(float(np.cos(t)), float(np.sin(t))) for t in turn[:-1]] + [(1.0, 0.0)]
    tiny = [(0.0, 0.0), (1e-4, 0.0), (1e-4, 1e-4), (0.0, 1e-4), (0.0, 0.0)]
    df = spark.createDataFrame([("a", [ring]), ("b", [tiny]), ("c", []), ("d", None)], "id string, rings array<array<struct<x:double,y:double>>>")
    got = {r.id: r.rings for r in vectors.simplified(df, 0.01).collect()}
    left = np.array([(p.x, p.y) for p in got["a"][0]])
    assert 10 < len(left) < 60 and (left[0] == left[-1]).all() and len(got["b"][0]) >= 4 and got["c"] == [] and got["d"] is None
    for x in np.array(ring):
        d, v = np.diff(left, axis=0), x - left[:-1]
        t = np.clip((v * d).sum(1) / (d * d).sum(1), 0, 1)
        assert np.sqrt(((v - t[:, None] * d) ** 2).sum(1)).min() <= 0.01 + 1e-12


def test_nearest_distance_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    shapes = [(i, [[tuple(map(float, p)) for p in rng.uniform(0, 100, 2) + rng.uniform(-6, 6, (5, 2))]]) for i in range(12)]
    shapes.append((99, [[(200.0, 0.0), (240.0, 0.0), (240.0, 40.0), (200.0, 40.0)], [(210.0, 10.0), (230.0, 10.0), (230.0, 30.0), (210.0, 30.0)]]))
    points = [(i, *map(float, rng.uniform(-40, 260, 2))) for i in range(300)] + [(900, 220.0, 20.0), (901, 205.0, 5.0), (902, None, 1.0), (903, 3000.0, 0.0)]
    df = spark.createDataFrame([*points, points[0]], "k int, x double, y double")
    poly = spark.createDataFrame(shapes, "id int, rings array<array<struct<x:double,y:double>>>")
    got = {r.k: r.distance for r in proximity.nearest_distance(df, poly, ["k"], 3.0, 500.0).collect()}
    assert len(got) == 304
    for k, x, y in points:
        if x is None or k == 903:
            assert got[k] is None
            continue
        near, inside = math.inf, False
        for _, rings in shapes:
            odd = False
            for ring in rings:
                for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                    d = (b[0] - a[0], b[1] - a[1])
                    t = max(0, min(1, ((x - a[0]) * d[0] + (y - a[1]) * d[1]) / (d[0] ** 2 + d[1] ** 2)))
                    near = min(near, math.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1]))
                    if (a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * d[0] / d[1]:
                        odd = not odd
            inside |= odd
        assert got[k] == pytest.approx(0 if inside else near, abs=1e-9), k
    assert got[900] == pytest.approx(10) and got[901] == 0


def test_silhouette_is_euclidean(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(230, 3)) + rng.integers(0, 3, 230)[:, None] * 2
    zone = [int(v) for v in rng.integers(0, 3, 229)] + [7]
    df = spark.createDataFrame([(i, *map(float, v), z) for i, (v, z) in enumerate(zip(x, zone, strict=True))] + [(-1, None, 0.0, 0.0, 1)], "id long, a double, b double, c double, zone int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    z, want = np.array(zone), []
    for i in range(230):
        own = (z == z[i]) & (np.arange(230) != i)
        if not own.any():
            want.append(0.0)
            continue
        inner, outer = d[i][own].mean(), min(d[i][z == o].mean() for o in set(zone) if o != z[i])
        want.append((outer - inner) / max(inner, outer))
    assert zoning.silhouette(df, ["a", "b", "c"]) == pytest.approx(np.mean(want), abs=1e-12)
    assert math.isnan(zoning.silhouette(df.where("zone = 1"), ["a"])) and -1 <= zoning.silhouette(df, ["a", "b"], most=50, key="id") <= 1


def test_spaces_are_compared(spark):
    rng = np.random.default_rng(7)
    z = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, 5)) + z[:, None] * np.array([4, 0, 0, 0, 0])
    df = spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, z, strict=True))], "id long, t_a double, t_b double, u_c double, u_d double, u_e double, zone int")
    rows = zoning.compare_spaces(df, {"full": (["t_a", "t_b", "u_c", "u_d", "u_e"], False), "part": (["t_b", "u_c"], True)}, "zone", key="id").collect()
    full = [r for r in rows if r.space == "full"]
    share = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert [r.share for r in full] == pytest.approx((share / share.sum())[:3].tolist()) and full[0].needed == int((np.cumsum(share / share.sum()) < 0.9).sum()) + 1
    assert full[0].silhouette > 0.3 > abs(rows[-1].silhouette) and len(rows) == 5 and all(r.low < r.high for r in rows)
