"""Splittable polygon files against the whole-file readers."""

import sqlite3
import struct
import zipfile

import numpy as np
import pytest

from fallowgrid.sources import polygon_files, vectors

PRJ = 'GEOGCS["SIRGAS 2000",DATUM["D",SPHEROID["GRS 1980",6378137,298.257222101]]]'


def _shapes(n):
    r = np.random.default_rng(4)
    return [[] if i % 11 == 5 else [[tuple(map(float, p)) for p in r.uniform(0, 100, 2) + r.uniform(0, 3, (4 + i % 3, 2))] for _ in range(1 + i % 2)] for i in range(n)]


def _shapefile(folder, shapes):
    records, index, at = b"", b"", 50
    for i, rings in enumerate(shapes, 1):
        flat = [p for r in rings for p in r]
        box = [f(p[k] for p in flat) for f, k in ((min, 0), (min, 1), (max, 0), (max, 1))] if flat else []
        starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
        body = struct.pack("<I4dII", 5, *box, len(rings), len(flat)) + struct.pack(f"<{len(starts)}I", *starts) + b"".join(struct.pack("<2d", *p) for p in flat) if rings else struct.pack("<I", 0)
        records += struct.pack(">II", i, len(body) // 2) + body
        index += struct.pack(">ii", at, len(body) // 2)
        at += 4 + len(body) // 2
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([12]) + bytes(15)
    dbf = struct.pack("<4sIHH", b"\x03\0\0\0", len(shapes), 65, 13) + bytes(20) + field + b"\r" + b"".join(b" " + f"ção {i}".encode().ljust(12) for i in range(len(shapes)))
    for name, content in (("shp", bytes(100) + records), ("shx", bytes(100) + index), ("dbf", dbf), ("prj", PRJ.encode())):
        (folder / f"a.{name}").write_bytes(content)
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        for name in ("shp", "dbf", "prj"):
            z.write(folder / f"a.{name}", f"a.{name}")


def _geopackage(path, shapes, tree):
    con = sqlite3.connect(path)
    con.executescript("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT); INSERT INTO gpkg_geometry_columns VALUES ('u', 'g'); CREATE TABLE u (fid INTEGER PRIMARY KEY, g BLOB, name TEXT)")
    if tree:
        con.execute("CREATE VIRTUAL TABLE rtree_u_g USING rtree(id, minx, maxx, miny, maxy)")
    for i, rings in enumerate(shapes):
        body = struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)
        con.execute("INSERT INTO u VALUES (?, ?, ?)", (10 + 3 * i, b"GP" + bytes([0, 1 | (0 if rings else 16)]) + struct.pack("<i", 4674) + body, f"n{i}"))
        if tree and rings:
            x, y = zip(*(p for r in rings for p in r), strict=True)
            con.execute("INSERT INTO rtree_u_g VALUES (?, ?, ?, ?, ?)", (10 + 3 * i, min(x), max(x), min(y), max(y)))
    con.commit()
    con.close()


def _key(df, name):
    return sorted((r.attributes[name], [[(p.x, p.y) for p in ring] for ring in r.rings]) for r in df.collect())


def test_shapefiles_in_ranges_of_records(spark, tmp_path):
    polygon_files.register(spark)
    shapes = _shapes(57)
    _shapefile(tmp_path, shapes)
    df = spark.read.format("polygons").option("rows", 10).load(str(tmp_path / "a.shp"))
    assert df.rdd.getNumPartitions() == 6
    assert _key(df, "NAME") == _key(vectors.shapefiles(spark, [str(tmp_path / "a.zip")]), "NAME") and {r.system for r in df.collect()} == {PRJ}
    near = df.where("xmin <= 40 AND xmax >= 20 AND ymin <= 60 AND ymax >= 30")
    want = vectors.in_bounds(vectors.with_bounds(vectors.shapefiles(spark, [str(tmp_path / "a.zip")])), (20, 30, 40, 60))
    assert _key(near, "NAME") == _key(want, "NAME") and 0 < near.count() < 20
    assert vectors.in_degrees(near).count() == near.count()
    (tmp_path / "a.shx").unlink()
    with pytest.raises(Exception, match="no index"):
        df.count()


@pytest.mark.parametrize("tree", [True, False])
def test_geopackages_in_ranges_of_rows(spark, tmp_path, tree):
    polygon_files.register(spark)
    path = str(tmp_path / "u.gpkg")
    _geopackage(path, _shapes(40), tree)
    df = spark.read.format("polygons").option("layer", "u").option("rows", 25).load(path)
    whole = vectors.geopackage(spark, [path], "u")
    assert df.rdd.getNumPartitions() == 5 and _key(df, "name") == _key(whole, "name")
    box = (10.0, 0.0, 55.0, 50.0)
    assert _key(vectors.in_bounds(df, box), "name") == _key(vectors.in_bounds(vectors.with_bounds(whole), box), "name")
    assert df.where("xmin > 1e9").count() == 0
    with pytest.raises(Exception, match="no layer"):
        spark.read.format("polygons").option("layer", "absent").load(path).count()


def test_pushed_limits_reach_the_reader():
    from pyspark.sql.datasource import GreaterThanOrEqual, IsNotNull, LessThan

    reader = polygon_files.Reader({"path": "x"})
    filters = [GreaterThanOrEqual(("xmax",), 1.0), GreaterThanOrEqual(("xmax",), 2.0), LessThan(("ymin",), 5.0), IsNotNull(("xmax",)), LessThan(("a", "b"), 1)]
    assert list(reader.pushFilters(filters)) == filters and reader.bounds.least == {"xmax": 2.0} and reader.bounds.most == {"ymin": 5.0}
    assert reader.bounds.meet((0, 4, 2, 9)) and not reader.bounds.meet((0, 6, 2, 9))
