"""Polygon files (GeoPackage layers, zipped shapefiles, GeoJSON), their bounds, projection and dissolved outlines.

A polygon row is (attributes map<string,string>, rings array<array<struct<x,y>>>).  Rings of holes and of further parts
stand beside each other: the even-odd rule of `bands.burn` tells them apart.  A file is read by one task.
"""

from __future__ import annotations

import io
import json
import math
import os
import sqlite3
import struct
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projections
from ..operators import overlay

#: Radius of the spherical Mercator projection in metres, and GeoPackage envelope sizes by their code.
RADIUS = 6378137.0
ENVELOPE = (0, 32, 48, 48, 64)
RINGS = "array<array<array<double>>>"


def _wkb(buffer: bytes, at: int = 0) -> tuple[list, int]:
    """(rings, end) of a polygon or multipolygon in well-known binary; further dimensions are passed over."""
    order = "<" if buffer[at] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", buffer, at + 1)
    (n,) = struct.unpack_from(order + "I", buffer, at + 5)
    dims = 2 + (kind >> 31 & 1) + (kind >> 30 & 1) + {0: 0, 1: 1, 2: 1, 3: 2}[kind % 65536 // 1000]
    if kind >> 29 & 1:
        raise ValueError("well-known binary with an embedded reference system")
    at, rings, kind = at + 9, [], kind % 65536 % 1000
    for _ in range(n):
        if kind == 6:
            part, at = _wkb(buffer, at)
            rings += part
        elif kind == 3:
            (m,) = struct.unpack_from(order + "I", buffer, at)
            flat = struct.unpack_from(f"{order}{m * dims}d", buffer, at + 4)
            rings.append([[flat[i], flat[i + 1]] for i in range(0, m * dims, dims)])
            at += 4 + 8 * m * dims
        else:
            raise ValueError(f"geometry of kind {kind} is no polygon")
    return rings, at


def _geopackage(content: bytes, layer: str) -> Iterator[tuple[dict, list, str | None]]:
    with tempfile.TemporaryDirectory() as scratch:  # the task's own copy: SQLite reads files only
        path = os.path.join(scratch, "layer.gpkg")
        with open(path, "wb") as f:
            f.write(content)
        con = sqlite3.connect(path)
        try:
            found = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
            if found is None:
                raise ValueError(f"no layer {layer}")
            rows = con.execute('SELECT * FROM "{}"'.format(layer.replace('"', '""')))
            names = [c[0] for c in rows.description]
            known = con.execute("SELECT name FROM sqlite_master WHERE name = 'gpkg_spatial_ref_sys'").fetchone()
            systems = dict(con.execute("SELECT srs_id, definition FROM gpkg_spatial_ref_sys")) if known else {}
            for row in rows:
                values = dict(zip(names, row, strict=True))
                shape = values.pop(found[0])
                # a shape names its system by number: the text that the file gives for it, else the number
                system = None if shape is None else struct.unpack_from("<i" if shape[3] & 1 else ">i", shape, 4)[0]
                text = systems.get(system)
                yield values, [] if shape is None or shape[3] >> 4 & 1 else _wkb(shape, 8 + ENVELOPE[shape[3] >> 1 & 7])[0], text if text and "[" in text else system and str(system)
        finally:
            con.close()


def _dbf(content: bytes, encoding: str) -> list[dict]:
    rows, start, width = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii"), content[at + 16]))
        at += 32
    out = []
    for i in range(rows):
        at, row = start + i * width + 1, {}
        for name, size in fields:
            row[name] = content[at : at + size].decode(encoding).strip() or None
            at += size
        out.append(row)
    return out


def _shapes(content: bytes) -> Iterator[list]:
    at = 100
    while at < len(content):
        (words,) = struct.unpack_from(">I", content, at + 4)
        body, at = at + 8, at + 8 + 2 * words
        (kind,) = struct.unpack_from("<I", content, body)
        if kind == 0:
            yield []
            continue
        if kind not in (5, 15, 25):
            raise ValueError(f"shape of kind {kind} is no polygon")
        parts, points = struct.unpack_from("<II", content, body + 36)
        ends = [*struct.unpack_from(f"<{parts}I", content, body + 44), points]
        flat = struct.unpack_from(f"<{2 * points}d", content, body + 44 + 4 * parts)
        yield [[[flat[2 * i], flat[2 * i + 1]] for i in range(a, b)] for a, b in zip(ends, ends[1:], strict=False)]


def _zipped(content: bytes, encoding: str) -> Iterator[tuple[dict, list, str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if n.lower().endswith(".shp")):
            table = next(n for n in z.namelist() if n.lower() == name.lower()[:-4] + ".dbf")
            system = next((z.read(n).decode("utf-8", "replace") for n in z.namelist() if n.lower() == name.lower()[:-4] + ".prj"), None)
            for values, rings in zip(_dbf(z.read(table), encoding), _shapes(z.read(name)), strict=True):
                yield values, rings, system


def _read(spark: SparkSession, paths: Sequence[str], parse: Callable[[bytes], Iterator[tuple[dict, list, str | None]]], system: bool) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = [(json.dumps({k: None if v is None else str(v) for k, v in a.items()}), json.dumps(r), s) for a, r, s in parse(content)]
                yield pd.DataFrame(found, columns=["attributes", "rings", "system"])

    raw = spark.read.format("binaryFile").load(list(paths)).select("content").mapInPandas(rows, "attributes string, rings string, system string")
    return raw.select(F.from_json("attributes", "map<string,string>").alias("attributes"), _points(F.from_json("rings", RINGS)).alias("rings"), *(["system"] if system else []))


def _points(rings: Column) -> Column:
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def geopackage(spark: SparkSession, paths: Sequence[str], layer: str, system: bool = False) -> DataFrame:
    """The polygons of one layer; null and empty shapes have no rings.  With `system`, the text or number of each shape's reference system."""
    return _read(spark, paths, lambda content: _geopackage(content, layer), system)


def shapefiles(spark: SparkSession, paths: Sequence[str], encoding: str = "utf-8", expected: int | None = None, system: bool = False) -> DataFrame:
    """The polygons of zipped shapefiles together; a number of rows other than the `expected` one is an error.  With `system`, the text of each file's .prj."""
    out = _read(spark, paths, lambda content: _zipped(content, encoding), system)
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} polygons, not {expected}")
    return out


def geojson(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The polygons and multipolygons of feature collections."""
    feature = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.json(list(paths), schema=feature, multiLine=True).select(F.explode("features").alias("f"))
    shape, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = F.when(shape == "Polygon", F.from_json(text, RINGS)).when(shape == "MultiPolygon", F.flatten(F.from_json(text, f"array<{RINGS}>")))
    return f.where(shape.isin("Polygon", "MultiPolygon")).select(F.col("f.properties").alias("attributes"), _points(rings).alias("rings"))


def write_geojson(polygons: DataFrame, path: str) -> None:
    """One feature collection of a table of units (some hundreds: it is one text).  Each ring becomes a polygon part."""
    parts = F.transform("rings", lambda ring: F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("attributes").alias("properties"), shape.alias("geometry"))
    whole = polygons.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))))
    whole.write.mode("overwrite").text(path)


def with_bounds(polygons: DataFrame) -> DataFrame:
    """Adds xmin, ymin, xmax, ymax (null without rings), the columns that `in_bounds` filters on."""
    all_of = lambda c: F.flatten(F.transform("rings", lambda ring: F.transform(ring, lambda p: p[c])))
    return polygons.withColumns({f"{c}{name}": f(all_of(c)) for c in "xy" for name, f in (("min", F.array_min), ("max", F.array_max))})


def in_bounds(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose bounds touch (xmin, ymin, xmax, ymax): four comparisons, which reach a Parquet scan."""
    return df.where((F.col("xmin") <= box[2]) & (F.col("xmax") >= box[0]) & (F.col("ymin") <= box[3]) & (F.col("ymax") >= box[1]))


def mercator(longitude: Column, latitude: Column) -> tuple[Column, Column]:
    """Degrees to metres of the spherical Mercator projection."""
    return F.radians(longitude) * RADIUS, F.ln(F.tan(math.pi / 4 + F.radians(latitude) / 2)) * RADIUS


def reproject(polygons: DataFrame, to: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """Every corner through `to`, such as `mercator`."""

    def corner(p: Column) -> Column:
        x, y = to(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return polygons.withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, corner)))


def in_degrees(polygons: DataFrame, default: str | None = None, most: int = 64) -> DataFrame:
    """`polygons` (with their `system`) in degrees, each by its own reference system; those without one by `default`, which else is an error.

    Only the different systems reach the driver, `most` at the highest.
    """
    found = [r[0] for r in polygons.select(F.coalesce("system", F.lit(default)).alias("s")).distinct().limit(most + 1).collect()]
    if len(found) > most or None in found:
        raise ValueError("polygons without a reference system" if None in found else f"over {most} reference systems")
    rings = F.col("rings")
    for text in sorted(found):
        own = projections.from_code(int(text)) if text.isdigit() else projections.parse(text)
        if own.kind != "degrees":
            there = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct(*[c.alias(k) for k, c in zip("xy", projections.inverse(own, p["x"], p["y"]), strict=True)])))  # noqa: B023
            rings = F.when(F.coalesce("system", F.lit(default)) == text, there).otherwise(rings)
    return polygons.withColumn("rings", rings).drop("system")


def _thinned(x: np.ndarray, tolerance: float) -> np.ndarray:
    """Which corners of a closed ring (first equal to last) stay so that none that goes is farther off than the tolerance."""
    keep = np.zeros(len(x), bool)
    far = int(((x - x[0]) ** 2).sum(1).argmax())
    keep[[0, far, -1]] = True
    spans = [(0, far), (far, len(x) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        d, v = x[b] - x[a], x[a + 1 : b] - x[a]
        t = np.clip(v @ d / max(float(d @ d), 1e-300), 0, 1)
        off = ((v - t[:, None] * d) ** 2).sum(1)
        k = int(off.argmax())
        if off[k] > tolerance * tolerance:
            keep[a + 1 + k] = True
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplified(polygons: DataFrame, tolerance: float) -> DataFrame:
    """Rings with fewer corners (Douglas and Peucker's rule), none moved by more than `tolerance`; a ring keeps three corners at least."""

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rings in batch["rings"]:
                kept = []
                for ring in rings if rings is not None else []:
                    x = np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)
                    closed = len(x) and (x[0] == x[-1]).all()
                    if len(x) > 4 - (not closed):
                        whole = x if closed else np.vstack([x, x[:1]])
                        stay = _thinned(whole, tolerance)
                        if stay.sum() < 4:  # a sliver: the corner farthest from the chord stays as well
                            chord = whole[np.flatnonzero(stay)[1]] - whole[0]
                            stay[np.where(stay, -1, np.abs((whole - whole[0]) @ np.array([-chord[1], chord[0]]))).argmax()] = True
                        x = whole[stay] if closed else whole[stay][:-1]
                    kept.append([{"x": float(a), "y": float(b)} for a, b in x])
                out.append(kept if rings is not None else None)
            yield batch.assign(rings=out)

    return polygons.mapInPandas(thin, polygons.schema)


def units(polygons: DataFrame, column: str, values: Sequence[str] = (), keep: Sequence[str] = (), tolerance: float = 0.0) -> DataFrame:
    """Units of the given states (all without `values`), with the named attributes as columns and rings simplified."""
    found = polygons.where(F.col("attributes")[column].isin(list(values))) if values else polygons
    found = found.select(*[F.col("attributes")[c].alias(c) for c in keep], "rings")
    return simplified(found, tolerance) if tolerance else found


def area_of_interest(polygons: DataFrame, tolerance: float = 0.0, grid: float = 1e-9) -> DataFrame:
    """(rings): the outline of all polygons' union, joined at full precision and simplified afterwards."""
    rings = overlay.union_rings(polygons.select(F.lit(0).alias("all"), "rings"), ["all"], grid)
    whole = rings.groupBy("all").agg(F.collect_list("corners").alias("rings")).select("rings")
    return simplified(whole, tolerance) if tolerance else whole


def dissolved(polygons: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., ax, ay, bx, by_): the outline of the union of each group of polygons that share whole edges, as edges.

    An edge that an even number of a group's rings has lies inside; the count combines before the shuffle.
    """
    ring = polygons.select(*by, F.explode("rings").alias("r"))
    nexts = F.concat(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), F.slice("r", 1, 1))
    edge = ring.select(*by, F.explode(F.zip_with("r", nexts, lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))).alias("e")).where("e.a <> e.b")
    odd = edge.groupBy(*by, "e").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return odd.select(*by, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by_"))
