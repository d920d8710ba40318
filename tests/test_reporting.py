import json
import math
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from fallowgrid.functions.probability import correlation_p, ln_gamma, variance_p
from fallowgrid.operators import reports, stats, suites
from fallowgrid.sources import tables, vectors

SQUARE = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]
HOLE = [[0.5, 0.5], [1.0, 0.5], [1.0, 1.0], [0.5, 0.5]]
NEXT = [[2.0, 0.0], [4.0, 0.0], [4.0, 2.0], [2.0, 2.0], [2.0, 0.0]]


def test_tails_equal_tables_and_integrals(spark):
    one = spark.range(1)
    for z in (0.5, 1.0, 3.7, 40.0, 1e5):
        assert one.select(ln_gamma(F.lit(z))).first()[0] == pytest.approx(math.lgamma(z), rel=1e-12, abs=1e-11)

    def t_tail(t, df, steps=200_000):  # the density summed by the midpoint rule
        front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        return 1 - 2 * sum(front * (1 + ((i + 0.5) * t / steps) ** 2 / df) ** (-(df + 1) / 2) for i in range(steps)) * t / steps

    for rho, n in ((0.5, 12), (-0.1, 400), (0.9, 5), (0.02, 3)):
        t = abs(rho) * math.sqrt((n - 2) / (1 - rho * rho))
        assert one.select(correlation_p(F.lit(rho), F.lit(n))).first()[0] == pytest.approx(t_tail(t, n - 2), abs=1e-8)
    p = lambda rho, n: one.select(correlation_p(F.lit(rho), F.lit(n))).first()[0]
    assert p(1.0, 9) == 0 and p(0.0, 9) == 1 and p(0.3, 2) is None and 0 < p(0.8, 300) < 1e-60
    v = lambda f, n, k: one.select(variance_p(F.lit(f), F.lit(n), F.lit(k))).first()[0]
    assert v(4.256495, 12, 3) == pytest.approx(0.05, abs=1e-6)  # the tabled 5 % point of 2 and 9 degrees
    assert v(0.0, 12, 3) == 1 and v(2.0, 3, 3) is None and v(2.0, 9, 1) is None


def _blob(rings, order="<"):
    flag = 1 if order == "<" else 0
    head = b"GP" + bytes([0, 0b10 | 1]) + struct.pack("<i4d", 4674, 0, 4, 0, 2)
    polygon = struct.pack(f"{order}BII", flag, 3, len(rings)) + b"".join(struct.pack(f"{order}I", len(r)) + b"".join(struct.pack(f"{order}2d", *p) for p in r) for r in rings)
    return head + struct.pack("<BII", 1, 6, 1) + polygon


def _rings(df):
    return [[[[p.x, p.y] for p in ring] for ring in r.rings] for r in df.collect()]


def test_geopackage_layers(spark, tmp_path):
    path = tmp_path / "units.gpkg"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('units', 'geom')")
    con.execute("CREATE TABLE units (fid INTEGER, geom BLOB, uf TEXT)")
    con.executemany("INSERT INTO units VALUES (?, ?, ?)", [(1, _blob([SQUARE, HOLE]), "GO"), (2, _blob([NEXT], ">"), None), (3, None, "DF")])
    con.commit()
    con.close()
    df = vectors.geopackage(spark, [str(path)], "units").orderBy(F.col("attributes")["fid"])
    assert _rings(df) == [[SQUARE, HOLE], [NEXT], []]
    assert [r.attributes["uf"] for r in df.collect()] == ["GO", None, "DF"]
    with pytest.raises(Exception, match="no layer"):
        vectors.geopackage(spark, [str(path)], "absent").collect()


def _zip(path, shapes, names):
    records = b""
    for i, rings in enumerate(shapes, 1):
        flat = [p for r in rings for p in r]
        starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
        body = struct.pack("<I4dII", 5, 0, 0, 4, 2, len(rings), len(flat)) + struct.pack(f"<{len(starts)}I", *starts) + b"".join(struct.pack("<2d", *p) for p in flat) if rings else struct.pack("<I", 0)
        records += struct.pack(">II", i, len(body) // 2) + body
    field = b"NM_MUN".ljust(11, b"\0") + b"C" + bytes(4) + bytes([12]) + bytes(15)
    rows = b"".join(b" " + n.encode("utf-8").ljust(12) for n in names)
    dbf = struct.pack("<4sIHH", b"\x03\0\0\0", len(names), 65, 13) + bytes(20) + field + b"\r" + rows
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.shp", bytes(100) + records)
        z.writestr("a.dbf", dbf)


def test_zipped_shapefiles(spark, tmp_path):
    _zip(tmp_path / "one.zip", [[SQUARE, HOLE], []], ["Goiânia", ""])
    _zip(tmp_path / "two.zip", [[NEXT]], ["Anápolis"])
    paths = [str(tmp_path / "one.zip"), str(tmp_path / "two.zip")]
    df = vectors.shapefiles(spark, paths, expected=3)
    assert sorted((r.attributes["NM_MUN"] or "", len(r.rings)) for r in df.collect()) == [("", 0), ("Anápolis", 1), ("Goiânia", 2)]
    with pytest.raises(ValueError, match="3 polygons"):
        vectors.shapefiles(spark, paths, expected=247)


def test_geojson_round_trip_bounds_and_outline(spark, tmp_path):
    source = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": "a"}, "geometry": {"type": "Polygon", "coordinates": [SQUARE]}}, {"type": "Feature", "properties": {"id": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[NEXT]]}}, {"type": "Feature", "properties": {"id": "c"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    (tmp_path / "in.json").write_text(json.dumps(source, indent=1))
    df = vectors.geojson(spark, [str(tmp_path / "in.json")])
    vectors.write_geojson(df, str(tmp_path / "out"))
    assert sorted(_rings(vectors.geojson(spark, [str(tmp_path / "out")]))) == sorted(_rings(df)) == [[SQUARE], [NEXT]]
    near = vectors.in_bounds(vectors.with_bounds(df), (2.5, 0.5, 3, 3))
    assert [r.attributes["id"] for r in near.collect()] == ["b"]
    edges = {tuple(r) for r in vectors.dissolved(df, []).collect()}
    assert len(edges) == 6 and (2.0, 0.0, 2.0, 2.0) not in edges and (0.0, 0.0, 2.0, 0.0) in edges
    assert vectors.reproject(df, vectors.mercator).count() == 2


def test_yaml_keeps_comments(tmp_path):
    text = "# head\nsegments:\n  soy:  # crop\n    factors:\n      rain:\n        weight: 0.3   # derived\n        points: [1, 2]\n  cane:\n    factors:\n      rain: {weight: 1}\naggregation:\n  eps: 0.001\n"
    out = tables.rewritten(text, {("segments", "soy", "factors", "rain", "weight"): 0.25, ("aggregation", "derived_half"): "calib"})
    assert out == text.replace("weight: 0.3 ", "weight: 0.25 ").replace("aggregation:\n", 'aggregation:\n  derived_half: "calib"\n')
    (tmp_path / "s.yaml").write_text(out)
    assert tables.config(str(tmp_path / "s.yaml"))["aggregation"] == {"derived_half": "calib", "eps": 0.001}
    with pytest.raises(KeyError):
        tables.rewritten(text, {("absent", "x"): 1})


def test_a_failing_suite_loses_its_own_rows(spark):
    good = spark.createDataFrame([("auc", "a", "full", 0.7, 5, None)], "metric string, segment string, half string, value double, n long, p double")
    rows, failed = suites.isolated({"good": lambda: good, "bad": lambda: good.select(F.raise_error(F.lit("no data")).alias("metric")), "again": lambda: good})
    assert rows.count() == 2 and list(failed) == ["bad"]
    assert suites.isolated({"bad": lambda: 1 / 0})[0] is None


def test_report_helpers(spark):
    df = spark.createDataFrame([(1234.5, 0), (-0.001, 1), (None, 1)], "v double, split int")
    assert [tuple(r) for r in df.select(reports.localised(F.col("v"), 1), reports.signed(F.col("v"), 2)).collect()] == [("1.234,5", "+1.234,50"), ("-0,0", "0,00"), (None, None)]
    assert r"1 \& 2 & --" in reports.latex_table(spark.createDataFrame([("1 & 2", None)], "a string, b string"), "t", "l")
    assert [reports.half_filter(df, h).count() for h in ("full", "calib", "val")] == [3, 1, 2]
    for call in (lambda: reports.half_filter(df, "third"), lambda: reports.eligible("some")):
        with pytest.raises(ValueError):
            call()
    assert stats.anova(df, "v", "split", ["split"]).count() == 0
