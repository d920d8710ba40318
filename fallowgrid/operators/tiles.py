"""Map tiles of a quantised band: inverse warp to web Mercator pixels, overview levels, tiles in Hilbert order.

A pixel of the finest level asks for the cell under its centre (nearest, by the inverse projection), so every pixel has one value and none is
missed; pixels join cells by equality.  A level above is made from the one below: four pixels become one, by the mean of a continuous
band or the most frequent value of a categorical one (the least of equals).  Tiles are 256 x 256 pixels with `NODATA` where nothing lies;
each is assembled from its own pixels only, 65,536 at the most.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODATA, SIDE = 255, 256


def _row_of(lat: Column, zoom: int) -> Column:
    n = SIDE << zoom
    return F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n).cast("long")


def pixels(cells: DataFrame, value: str, zoom: int, west: float, north: float, step: float) -> DataFrame:
    """(px, py, value) at `zoom` of cells (gx, gy) that are `step` degrees wide and lie east and south of (west, north).

    The value (0 to 254) is that of the cell under the pixel's centre.
    """
    n = SIDE << zoom
    ends = cells.where(F.col(value).isNotNull()).agg(*[f(c).alias(f"{c}{k}") for c in ("gx", "gy") for k, f in ((0, F.min), (1, F.max))])
    x = lambda gx: F.floor((west + gx * step + 180) / 360 * n).cast("long")
    box = ends.select(x(F.col("gx0")).alias("x0"), x(F.col("gx1") + 1).alias("x1"), _row_of(north - F.col("gy0") * step, zoom).alias("y0"), _row_of(north - (F.col("gy1") + 1) * step, zoom).alias("y1")).where("x0 IS NOT NULL")
    # one row of bounds becomes rows of pixels, then pixels, dealt out anew in between
    rows = box.select("x0", "x1", F.explode(F.sequence("y0", "y1")).alias("py")).repartition("py")
    p = rows.select(F.explode(F.sequence("x0", "x1")).alias("px"), "py")
    lon = (F.col("px") + 0.5) * (360 / n) - 180
    lat = F.degrees(F.atan(F.sinh(math.pi * (1 - (F.col("py") + 0.5) * (2 / n)))))
    p = p.withColumns({"gx": F.floor((lon - west) / step).cast("int"), "gy": F.floor((north - lat) / step).cast("int")})
    return p.join(cells.select(F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"), F.col(value).cast("int").alias("value")), ["gx", "gy"]).where("value IS NOT NULL").select("px", "py", "value")


def overview(level: DataFrame, categorical: bool) -> DataFrame:
    """The level above: four pixels to one."""
    up = level.select(F.shiftright("px", 1).alias("px"), F.shiftright("py", 1).alias("py"), "value")
    if categorical:
        n = up.groupBy("px", "py", "value").agg(F.count("*").alias("n"))
        return n.groupBy("px", "py").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("value"))
    return up.groupBy("px", "py").agg(F.floor((2 * F.sum("value") + F.count("*")) / (2 * F.count("*"))).cast("int").alias("value"))


def hilbert(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of tiles: all coarser levels first, then along the level's Hilbert curve."""
    x, y = x.astype(np.int64).copy(), y.astype(np.int64).copy()
    out = ((np.int64(1) << (2 * z.astype(np.int64))) - 1) // 3
    for s in range(int(z.max(initial=0)) - 1, -1, -1):
        half = np.int64(1) << s
        own = z > s
        rx, ry = ((x & half) > 0) & own, ((y & half) > 0) & own
        out += np.where(own, half * half * ((3 * rx) ^ ry), 0)
        # turn the quarter so that its curve begins where the last one ended
        flip = own & ~ry & rx
        x, y = np.where(flip, half - 1 - (x & (half - 1)), x & (half - 1)), np.where(flip, half - 1 - (y & (half - 1)), y & (half - 1))
        swap = own & ~ry
        x, y = np.where(swap, y, x), np.where(swap, x, y)
    return out


def png(values: np.ndarray, palette: Sequence[tuple[int, int, int]]) -> bytes:
    """A tile of byte values as a palette image; `NODATA` is transparent."""
    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    colours = bytes(c for rgb in palette for c in rgb).ljust(3 * 256, b"\0")
    lines = np.zeros((SIDE, SIDE + 1), np.uint8)
    lines[:, 1:] = values.reshape(SIDE, SIDE)
    head = struct.pack(">IIBBBBB", SIDE, SIDE, 8, 3, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"PLTE", colours) + part(b"tRNS", b"\xff" * NODATA + b"\0") + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def values_of(image: bytes) -> np.ndarray:
    """The byte values of such an image."""
    at, packed = 8, b""
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        if image[at + 4 : at + 8] == b"IDAT":
            packed += image[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(SIDE, SIDE + 1)[:, 1:]


def ramp(colours: Sequence[tuple[int, int, int]], steps: int = 255) -> list[tuple[int, int, int]]:
    """A palette that runs through the given colours."""
    at = np.linspace(0, len(colours) - 1, steps)
    return [tuple(int(round(float(np.interp(v, range(len(colours)), [c[k] for c in colours])))) for k in range(3)) for v in at]


TILES = "id long, z int, x int, y int, data binary"


def tiles(level: DataFrame, zoom: int, palette: Sequence[tuple[int, int, int]]) -> DataFrame:
    """(id, z, x, y, data) of the tiles of a level of pixels."""
    palette = list(palette)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            lists = batch.column(2)
            out = []
            for k in range(batch.num_rows):
                image = np.full(SIDE * SIDE, NODATA, np.uint8)
                at, value = (c.to_numpy() for c in lists[k].values.flatten())
                image[at] = value
                out.append(png(image, palette))
            z = np.full(batch.num_rows, zoom, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(hilbert(z, x, y)), pa.array(z), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(out, pa.binary())], names=["id", "z", "x", "y", "data"])

    inside = F.struct((F.pmod("py", F.lit(SIDE)) * SIDE + F.pmod("px", F.lit(SIDE))).cast("int").alias("at"), "value")
    own = level.groupBy(F.floor(F.col("px") / SIDE).cast("int").alias("x"), F.floor(F.col("py") / SIDE).cast("int").alias("y")).agg(F.collect_list(inside).alias("p"))
    return own.mapInArrow(draw, TILES)


def pyramid(cells: DataFrame, value: str, zoom: int, west: float, north: float, step: float, palette: Sequence[tuple[int, int, int]], categorical: bool = False, lowest: int = 0) -> DataFrame:
    """The tiles of all levels from `zoom` down to `lowest`."""
    level = pixels(cells, value, zoom, west, north, step)
    out = tiles(level, zoom, palette)
    for z in range(zoom - 1, lowest - 1, -1):
        level = overview(level, categorical)
        out = out.union(tiles(level, z, palette))
    return out


def read_values(found: DataFrame) -> DataFrame:
    """(z, px, py, value) of tiles, without what has no data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z, x, y, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = values_of(data)
                row, col = np.nonzero(v != NODATA)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), z, np.int32)), pa.array(col + x * SIDE), pa.array(row + y * SIDE), pa.array(v[row, col].astype(np.int32))], names=["z", "px", "py", "value"])

    return found.select("z", "x", "y", "data").mapInArrow(run, "z int, px long, py long, value int")
