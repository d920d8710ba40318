"""Polygon files as a Spark data source with several partitions a file and bounds that are pushed down.

    register(spark)
    spark.read.format("polygons").option("layer", "units").load("/shared/units.gpkg").where("xmin <= 3 AND xmax >= 1")

- Shapefiles (.shp beside its .shx and .dbf, unpacked): the index names where every record begins, so a partition is a range of records and reads its
  stretch of the two files only.  A record's own box is tested before its corners are read.
- GeoPackages: a partition is a range of row numbers.  Where the layer has an R-tree, pushed bounds become a range query on it; else the boxes in
  the shapes' heads are tested.  Files are opened read-only and in place.

Columns are those of `vectors` (attributes, rings, system) and the box (xmin, ymin, xmax, ymax; null without rings).  Upper and lower limits
on the box are pushed; Spark tests them again, so rounding of an R-tree's boxes is harmless.  Folders are read file by file.  Paths are those
of a mounted shared file system.
"""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from . import vectors

ROWS = 20_000
SCHEMA = "attributes map<string,string>, rings array<array<struct<x:double,y:double>>>, system string, xmin double, ymin double, xmax double, ymax double"
_BOX = ("xmin", "ymin", "xmax", "ymax")


@dataclass
class Bounds:
    """The least and most that each side of a box may be."""

    least: dict[str, float] = field(default_factory=dict)
    most: dict[str, float] = field(default_factory=dict)

    def meet(self, box: tuple[float, ...]) -> bool:
        side = dict(zip(_BOX, box, strict=True))
        return all(side[c] >= v for c, v in self.least.items()) and all(side[c] <= v for c, v in self.most.items())

    def __bool__(self) -> bool:
        return bool(self.least or self.most)


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    end: int


def _read_at(path: str, at: int, n: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(at)
        return f.read(n)


def _beside(path: str, kind: str) -> str | None:
    stem = os.path.splitext(path)[0]
    return next((p for p in (f"{stem}.{kind}", f"{stem}.{kind.upper()}") if os.path.exists(p)), None)


class Shapefile:
    def __init__(self, path: str, encoding: str):
        self.path, self.encoding = path, encoding
        self.index = _beside(path, "shx")
        if self.index is None:
            raise ValueError(f"{path} has no index (.shx)")

    def count(self) -> int:
        return (os.path.getsize(self.index) - 100) // 8

    def rows(self, first: int, end: int, bounds: Bounds) -> Iterator[tuple[dict, list, str | None, tuple | None]]:
        places = struct.unpack(f">{2 * (end - first)}i", _read_at(self.index, 100 + 8 * first, 8 * (end - first)))
        start, stop = 2 * places[0], 2 * places[-2] + 8 + 2 * places[-1]
        content = _read_at(self.path, start, stop - start)
        table = _beside(self.path, "dbf")
        head = _read_at(table, 0, 32)
        _, heads, width = struct.unpack_from("<IHH", head, 4)
        # the stretch of the table behind its own heading, with the count set to the rows at hand
        part = head[:4] + struct.pack("<I", end - first) + _read_at(table, 8, heads - 8) + _read_at(table, heads + first * width, (end - first) * width)
        prj = _beside(self.path, "prj")
        system = open(prj, encoding="utf-8", errors="replace").read() if prj else None
        values = vectors._dbf(part, self.encoding)
        for k in range(end - first):
            body = 2 * places[2 * k] - start + 8
            (kind,) = struct.unpack_from("<I", content, body)
            box = struct.unpack_from("<4d", content, body + 4) if kind else None
            if bounds and (box is None or not bounds.meet(box)):
                continue
            record = content[body - 8 : body + 2 * places[2 * k + 1]]
            yield values[k], next(vectors._shapes(bytes(100) + record)), system, box


class GeoPackage:
    def __init__(self, path: str, layer: str):
        self.path, self.layer = path, layer
        con = self._open()
        try:
            found = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
            if found is None:
                raise ValueError(f"no layer {layer}")
            self.shape = found[0]
            self.span = con.execute(f"SELECT min(rowid), max(rowid) FROM {self._named(layer)}").fetchone()
            tree = f"rtree_{layer}_{self.shape}"
            self.tree = tree if con.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (tree,)).fetchone() else None
        finally:
            con.close()

    @staticmethod
    def _named(name: str) -> str:
        return '"{}"'.format(name.replace('"', '""'))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def count(self) -> int:
        """Row numbers from the least to the largest: ranges of them, not rows, are dealt out."""
        return 0 if self.span[0] is None else self.span[1] - self.span[0] + 1

    def rows(self, first: int, end: int, bounds: Bounds) -> Iterator[tuple[dict, list, str | None, tuple | None]]:
        con = self._open()
        try:
            known = con.execute("SELECT 1 FROM sqlite_master WHERE name = 'gpkg_spatial_ref_sys'").fetchone()
            systems = dict(con.execute("SELECT srs_id, definition FROM gpkg_spatial_ref_sys")) if known else {}
            low = self.span[0] + first
            clause, given = "t.rowid >= ? AND t.rowid < ?", [low, low + end - first]
            if bounds and self.tree:
                names = dict(zip(_BOX, ("minx", "miny", "maxx", "maxy"), strict=True))
                tests = [(f"{names[c]} >= ?", v) for c, v in bounds.least.items()] + [(f"{names[c]} <= ?", v) for c, v in bounds.most.items()]
                # the tree keeps 32-bit boxes, rounded outwards: limits are loosened by as much
                clause += f" AND t.rowid IN (SELECT id FROM {self._named(self.tree)} WHERE {' AND '.join(c for c, _ in tests)})"
                given += [v - abs(v) * 2e-7 - 1e-30 if ">=" in c else v + abs(v) * 2e-7 + 1e-30 for c, v in tests]
            rows = con.execute(f"SELECT t.* FROM {self._named(self.layer)} t WHERE {clause} ORDER BY t.rowid", given)
            names = [c[0] for c in rows.description]
            for row in rows:
                values = dict(zip(names, row, strict=True))
                shape = values.pop(self.shape)
                rings, system, box = [], None, None
                if shape is not None:
                    number = struct.unpack_from("<i" if shape[3] & 1 else ">i", shape, 4)[0]
                    text = systems.get(number)
                    system = text if text and "[" in text else str(number) if number else None
                    if not shape[3] >> 4 & 1:
                        rings = vectors._wkb(shape, 8 + vectors.ENVELOPE[shape[3] >> 1 & 7])[0]
                        flat = [p for r in rings for p in r]
                        box = (min(p[0] for p in flat), min(p[1] for p in flat), max(p[0] for p in flat), max(p[1] for p in flat)) if flat else None
                if bounds and (box is None or not bounds.meet(box)):
                    continue
                yield values, rings, system, box
        finally:
            con.close()


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.layer, self.encoding = options["path"], options.get("layer", ""), options.get("encoding", "utf-8")
        self.per_part, self.bounds = int(options.get("rows", ROWS)), Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _BOX and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.bounds.least[name] = max(f.value, self.bounds.least.get(name, f.value))
            if name in _BOX and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.bounds.most[name] = min(f.value, self.bounds.most.get(name, f.value))
            yield f  # Spark tests it again

    def _file(self, path: str) -> Shapefile | GeoPackage:
        return Shapefile(path, self.encoding) if path.lower().endswith(".shp") else GeoPackage(path, self.layer)

    def partitions(self) -> list[Rows]:
        root = self.paths.removeprefix("file://").removeprefix("file:")
        found = sorted(os.path.join(root, f) for f in os.listdir(root) if f.lower().endswith((".shp", ".gpkg"))) if os.path.isdir(root) else [root]
        out = []
        for path in found:
            n = self._file(path).count()
            out += [Rows(path, a, min(a + self.per_part, n)) for a in range(0, n, self.per_part)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        if not partition.path:
            return
        for values, rings, system, box in self._file(partition.path).rows(partition.first, partition.end, self.bounds):
            attributes = {k: None if v is None else str(v) for k, v in values.items()}
            yield attributes, [[tuple(p) for p in r] for r in rings], system, *(box or (None,) * 4)


class Polygons(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polygons"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, which must let filters reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Polygons)
