"""Nearest-geometry join, and the conservation bands that need it.

Boundaries are cut into bits no longer than a tile, so that a bit touches few tiles.  In a round with tiles of side s every bit is sent to
the tiles that hold points within s of its bounds, and points join on the one tile they lie in.  A point whose nearest
bit is at most s away is done: anything that didn't share its tile is farther.  The others go on with twice the side,
until the side reaches `longest`.  Each round joins by equality, and only the points not yet done take part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dropped, stored
from . import bands, grid


def boundary(polygons: DataFrame, longest: float) -> DataFrame:
    """(ax, ay, bx, by): the polygons' edges in bits of at most `longest`."""
    r = polygons.select(F.explode("rings").alias("r"))
    nexts = F.concat(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), F.slice("r", 1, 1))
    e = r.select(F.explode(F.zip_with("r", nexts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e")).select("e.a", "e.b")
    n = F.greatest(F.ceil(F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")) / longest), F.lit(1)).cast("int")
    e = e.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c, i: F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * i / F.col("n")
    return e.select(at("x", F.col("i")).alias("ax"), at("y", F.col("i")).alias("ay"), at("x", F.col("i") + 1).alias("bx"), at("y", F.col("i") + 1).alias("by")).distinct()


def to_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(x - ax - t * dx, y - ay - t * dy)


def nearest_distance(points: DataFrame, polygons: DataFrame, keys: Sequence[str], side: float, longest: float) -> DataFrame:
    """(keys.., distance): of each point (keys, x, y) to the nearest polygon (id, rings), 0 inside one and null beyond `longest`.

    Points without coordinates have no distance; a key that comes several times is one point.
    """
    p = points.select(*keys, "x", "y").dropDuplicates(list(keys))
    shapes = polygons.select(F.col("id"), F.explode("rings").alias("ring"))
    # a polygon's rings together: a point in an odd number of them is inside
    inside = bands.burn(p, shapes, side * 8).groupBy(*keys, "polygon").agg((F.count("*") % 2).alias("odd")).where("odd = 1").select(*keys).distinct()
    bits = stored(boundary(polygons, side), "bits")
    left = stored(p.join(inside, list(keys), "left_anti").where("x IS NOT NULL AND y IS NOT NULL"), "points")
    parts, s = [], side
    while True:
        tile = lambda low, high: F.sequence(F.floor((low - s) / s).cast("int"), F.floor((high + s) / s).cast("int"))  # noqa: B023, E731
        b = bits.withColumn("tx", F.explode(tile(F.least("ax", "bx"), F.greatest("ax", "bx")))).withColumn("ty", F.explode(tile(F.least("ay", "by"), F.greatest("ay", "by"))))
        q = left.withColumns({"tx": F.floor(F.col("x") / s).cast("int"), "ty": F.floor(F.col("y") / s).cast("int")})
        d = q.join(b, ["tx", "ty"]).groupBy(*keys, "x", "y").agg(F.min(to_segment(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))).alias("distance"))
        done = stored(d.where(F.col("distance") <= min(s, longest)).select(*keys, "distance"), "near")
        parts.append(done)
        if s >= longest:
            break
        more = stored(left.join(done, list(keys), "left_anti"), "points")
        dropped(left)
        left, s = more, min(2 * s, longest)
        if left.isEmpty():
            break
    near = parts[0]
    for part in parts[1:]:
        near = near.union(part)
    near = near.union(inside.withColumn("distance", F.lit(0.0)))
    return p.select(*keys).join(near, list(keys), "left")


def conservation(cells: DataFrame, protected: DataFrame, edge: float, *, elevation: str = "elevation", biomass: DataFrame | None = None, step: int = 1, radius: int = 3, side: float | None = None, longest: float | None = None) -> DataFrame:
    """(gx, gy, pa_dist, ruggedness[, carbon]) of cells of side `edge`: metres to the nearest protected area (up to 1,024 cells), the deviation of
    elevation around, and the biomass of a coarser grid (`step` cells a side) by its nearest four cells."""
    reach = 1024 * edge if longest is None else longest
    centres = cells.select("gx", "gy", ((F.col("gx") + 0.5) * edge).alias("x"), ((F.col("gy") + 0.5) * edge).alias("y"))
    out = nearest_distance(centres, protected, ["gx", "gy"], 8 * edge if side is None else side, reach).withColumnRenamed("distance", "pa_dist")
    out = out.join(grid.focal(cells.select("gx", "gy", elevation), radius, {"ruggedness": F.stddev_pop(elevation)}), ["gx", "gy"])
    if biomass is None:
        return out
    carbon = grid.bilinear(cells.select("gx", "gy"), biomass.withColumn("carbon", F.coalesce("carbon", F.lit(0.0))), step, "carbon")
    return out.join(carbon, ["gx", "gy"], "left")
