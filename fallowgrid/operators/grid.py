"""Neighbourhood operators on a grid of cells (gx, gy)."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def circle(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def focal(cells: DataFrame, radius: int, aggregates: dict[str, Column]) -> DataFrame:
    """`aggregates` over each cell's circular neighbourhood: every value is sent to the cells around it.

    The fan-out is the kernel's fixed size, and partial aggregation runs before the shuffle.
    """
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in circle(radius)])
    sent = cells.select("*", F.explode(offsets).alias("_o"), F.lit(1).alias("_one")).withColumns({"_x": F.col("gx") + F.col("_o.i"), "_y": F.col("gy") + F.col("_o.j"), "_own": (F.col("_o.i") == 0) & (F.col("_o.j") == 0)})
    out = sent.groupBy("_x", "_y").agg(*[a.alias(k) for k, a in aggregates.items()], F.max("_own").alias("_own"))
    return out.where("_own").select(F.col("_x").alias("gx"), F.col("_y").alias("gy"), *aggregates)


def bilinear(fine: DataFrame, coarse: DataFrame, step: int, value: str) -> DataFrame:
    """Value of each fine cell from its four coarse neighbours, by cell centres; neighbours that are absent lose their weight."""
    x, y = (F.col("gx") + 0.5) / step - 0.5, (F.col("gy") + 0.5) / step - 0.5
    f = fine.select("gx", "gy", x.alias("_x"), y.alias("_y"))
    corners = F.array(*[F.struct((F.floor("_x") + i).cast("int").alias("cx"), (F.floor("_y") + j).cast("int").alias("cy")) for i in (0, 1) for j in (0, 1)])
    f = f.select("*", F.explode(corners).alias("_c")).select("gx", "gy", F.col("_c.cx").alias("cx"), F.col("_c.cy").alias("cy"), ((1 - F.abs(F.col("_x") - F.col("_c.cx"))) * (1 - F.abs(F.col("_y") - F.col("_c.cy")))).alias("w"))
    c = coarse.select(F.col("gx").alias("cx"), F.col("gy").alias("cy"), F.col(value).alias("v"))
    return f.join(c, ["cx", "cy"]).groupBy("gx", "gy").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(value))


def coarsen(cells: DataFrame, step: int, aggregates: dict[str, Column]) -> DataFrame:
    return cells.groupBy(F.floor(F.col("gx") / step).cast("int").alias("cx"), F.floor(F.col("gy") / step).cast("int").alias("cy")).agg(*[a.alias(k) for k, a in aggregates.items()])


def majority(cells: DataFrame, keys: list[str], code: str) -> DataFrame:
    """The most frequent code per key, the smallest of equals."""
    n = cells.groupBy(*keys, code).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(code).alias("c"))).alias("b")).select(*keys, F.col("b.c").alias(code), (-F.col("b.m")).alias("n"))


def _envelope(at: np.ndarray, height: np.ndarray, want: np.ndarray) -> np.ndarray:
    """min over sources of height + (want - at)^2, by the lower envelope of parabolas in linear time."""
    hull: list[int] = []
    border: list[float] = []
    for q in range(len(at)):
        while hull:
            p = hull[-1]
            s = ((height[q] + at[q] ** 2) - (height[p] + at[p] ** 2)) / (2.0 * (at[q] - at[p]))
            if border and s <= border[-1]:
                hull.pop()
                border.pop()
            else:
                break
        border.append(s if hull else -np.inf)
        hull.append(q)
    k = np.searchsorted(np.array(border), want, side="right") - 1
    own = np.array(hull)[np.maximum(k, 0)]
    return height[own] + (want - at[own]) ** 2


def squared_distance(cells: DataFrame, source: str) -> DataFrame:
    """(gx, gy, d2): squared distance in cells to the nearest cell where `source` is 1; null without any.

    Two separable passes: along columns, then along rows.  A task holds one line of the grid.
    """
    kind = "gx int, gy int, d2 double"
    ends = cells.agg(F.min("gy").cast("int").alias("y0"), F.max("gy").cast("int").alias("y1"))

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        every = np.arange(pdf["y0"].iloc[0], pdf["y1"].iloc[0] + 1)  # also rows in which this column has no cell
        at = np.sort(pdf["gy"].to_numpy(float)[pdf["s"].to_numpy() == 1])
        d = _envelope(at, np.zeros(len(at)), every.astype(float)) if len(at) else np.full(len(every), np.nan)
        return pd.DataFrame({"gx": pdf["gx"].iloc[0], "gy": every, "d2": d})

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gx")
        at, h = pdf["gx"].to_numpy(float), pdf["d2"].to_numpy(float)
        some = np.isfinite(h)
        d = _envelope(at[some], h[some], at) if some.any() else np.full(len(at), np.nan)
        return pd.DataFrame({"gx": pdf["gx"].to_numpy(), "gy": pdf["gy"].to_numpy(), "d2": d})

    c = cells.select(F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"), F.coalesce(F.col(source).cast("int"), F.lit(0)).alias("s"))
    first = c.crossJoin(F.broadcast(ends)).groupBy("gx").applyInPandas(columns, kind)
    second = first.groupBy("gy").applyInPandas(rows, kind)
    return second.join(c.select("gx", "gy").distinct(), ["gx", "gy"]).withColumn("d2", F.when(~F.isnan("d2"), F.col("d2")))


def gradient(cells: DataFrame, value: str, size: float) -> DataFrame:
    """Slope (degrees) by 3 x 3 weighted differences, on cells with all eight neighbours; aspect as northing and easting."""
    wx = {(i, j): (i * (2 if j == 0 else 1)) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(wx[i, j]).alias("a"), F.lit(wx[j, i]).alias("b")) for i, j in wx])
    s = cells.select("gx", "gy", F.col(value).alias("v"), F.explode(offsets).alias("o"))
    # the cell at (x, y) gets the value of (x + i, y + j) with weight a
    s = s.groupBy((F.col("gx") - F.col("o.i")).alias("gx"), (F.col("gy") - F.col("o.j")).alias("gy")).agg(F.sum(F.col("v") * F.col("o.a")).alias("dx"), F.sum(F.col("v") * F.col("o.b")).alias("dy"), F.count("*").alias("n")).where("n = 9")
    dx, dy = F.col("dx") / (8 * size), F.col("dy") / (8 * size)
    aspect = F.atan2(-dx, -dy)
    return s.select("gx", "gy", F.degrees(F.atan(F.hypot(dx, dy))).alias("slope"), F.cos(aspect).alias("northing"), F.sin(aspect).alias("easting"))


def wetness(accumulation: Column, slope_degrees: Column, cell: float) -> Column:
    return F.ln((accumulation + 1) * cell / F.greatest(F.tan(F.radians(slope_degrees)), F.lit(0.001)))


def grid_id(x: Column, y: Column, box: tuple[float, float, float, float], n: int) -> Column:
    """gx * n + gy of an n x n grid over (xmin, ymin, xmax, ymax), clamped."""
    def step(v: Column, a: float, b: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - a) / ((b - a) / n)))).cast("int")

    return step(x, box[0], box[2]) * n + step(y, box[1], box[3])


