"""Band builders: soil, water, land cover, radiation, siting, realized use, productivity, polygons, roughness."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.membership import clamp
from . import grid

#: Solar constant (MJ m-2 min-1), MJ m-2 day-1 to W m-2, and the latitude formula's coefficients.
SOLAR, WATT, ECCENTRICITY, DECLINATION, PHASE = 0.0820, 11.574, 0.033, 0.409, 1.39


def depth_mean(layers: Mapping[str, tuple[Sequence[str], float]]) -> dict[str, Column]:
    """Each layer's mean over its depth columns, times its scale; null where a depth is."""
    return {name: sum((F.col(c) for c in depths), F.lit(0.0)) / len(depths) * scale for name, (depths, scale) in layers.items()}


def valid(raw: Column, fill: float, scale: float = 1.0) -> Column:
    """Scaled values under the fill codes, else null."""
    return F.when(raw < fill, raw * scale)


def season(df: DataFrame, ts: str, months: Sequence[int], years: tuple[int, int]) -> DataFrame:
    """Rows of the given calendar months of years first..last, pooled."""
    return df.where(F.month(ts).isin(*months) & F.year(ts).between(*years))


def productivity(df: DataFrame, keys: Sequence[str], raw: str, fill: float, scale: float) -> DataFrame:
    """(keys, value, n): mean of the valid scaled values of all years."""
    v = valid(F.col(raw), fill, scale)
    return df.groupBy(*keys).agg(F.avg(v).alias("value"), F.count(v).alias("n"))


def year_band(columns: Sequence[str], year: int, prefix: str = "classification_") -> str:
    """The one column of a year, by pattern."""
    name = f"{prefix}{year}"
    if name not in columns:
        raise ValueError(f"no band {name}; there are {sorted(c for c in columns if c.startswith(prefix))}")
    return name


def landcover(df: DataFrame, keys: Sequence[str], code: str, groups: Mapping[str, Sequence[object]], excluded: Sequence[object]) -> DataFrame:
    """Per cell: mode of its codes (smallest of equals), fraction of each group, mask_available and mask_excluded.

    One count per cell and code, combined before the shuffle, serves all of them.
    """
    n = df.where(F.col(code).isNotNull()).groupBy(*keys, code).agg(F.count("*").alias("_n"))
    share = {name: F.sum(F.when(F.col(code).isin(*codes), F.col("_n")).otherwise(0)) / F.sum("_n") for name, codes in groups.items()}
    out = n.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col(code).alias("c"))).alias("_b"), *[x.alias(f"{name}_frac") for name, x in share.items()])
    gone = F.col("mode").isin(*excluded).cast("int")
    return out.select(*keys, F.col("_b.c").alias("mode"), *[f"{name}_frac" for name in groups]).withColumns({"mask_excluded": gone, "mask_available": 1 - gone})


def swap_columns(base: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`base` with `columns` taken from `other`, in their old places; rows that `other` lacks get nulls."""
    missing = [c for c in columns if c not in other.columns or c not in base.columns]
    if missing:
        raise ValueError(f"columns to swap are absent: {missing}")
    j = base.alias("b").join(other.select(*keys, *columns).alias("o"), list(keys), "left")
    return j.select(*[F.col(c) if c in keys else F.col(f"{'o' if c in columns else 'b'}.{c}").alias(c) for c in base.columns])


def side_of(column: str, extras: Sequence[str], stack: Sequence[str]) -> str:
    """Where a factor's column comes from: land cover for lc_, the side tables by prefix, else the stack."""
    prefix = column.split("_")[0]
    if prefix == "lc":
        return "landcover"
    if prefix in extras:
        return prefix
    if column in stack:
        return "stack"
    raise ValueError(f"no source has {column}")


def check_sides(columns: Sequence[str], extras: Sequence[str], known: Sequence[str]) -> None:
    """Every side table that the columns need is given, and every one that is given is needed."""
    needed = {p for c in columns if (p := c.split("_")[0]) in known}
    if needed != set(extras):
        raise ValueError(f"missing side tables {sorted(needed - set(extras))}, unused ones {sorted(set(extras) - needed)}")


def radiation(latitude: Column) -> Column:
    """Mean over the twelve mid-month days of the radiation above the atmosphere, W m-2, as one expression of the latitude in degrees."""
    phi = F.radians(latitude)
    months = []
    for m in range(1, 13):
        turn = 2 * math.pi / 365 * (30.4 * m - 15)
        tilt = DECLINATION * math.sin(turn - PHASE)
        sunset = F.acos(clamp(-F.tan(phi) * math.tan(tilt), -1.0, 1.0))
        months.append((sunset * F.sin(phi) * math.sin(tilt) + F.cos(phi) * math.cos(tilt) * F.sin(sunset)) * (24 * 60 / math.pi * SOLAR * (1 + ECCENTRICITY * math.cos(turn))))
    return sum(months[1:], months[0]) / 12 * WATT


def clearness(surface: Column, above: Column) -> Column:
    return clamp(surface / F.greatest(above, F.lit(1e-6)), 0.0, 1.0)


def water_distance(cells: DataFrame, occurrence: str, above: float, edge: float) -> DataFrame:
    """(gx, gy, distance) to the nearest cell whose occurrence is over `above`, null without any."""
    d = grid.squared_distance(cells.withColumn("_w", (F.col(occurrence) > above).cast("int")), "_w")
    return d.select("gx", "gy", (F.sqrt("d2") * edge).alias("distance"))


def local_deviation(cells: DataFrame, bands: Sequence[str], radius: int) -> DataFrame:
    """Population deviation of every band over the circle around each cell, all bands in one aggregation."""
    return grid.focal(cells.select("gx", "gy", *bands), radius, {b: F.stddev_pop(b) for b in bands})


def theme_roughness(cells: DataFrame, themes: Mapping[str, Sequence[str]], radii: Sequence[int]) -> DataFrame:
    """(gx, gy, rough_<theme>_r<radius> ..): per cell, the mean local deviation of a theme's bands at each radius."""
    bands = sorted({b for own in themes.values() for b in own})
    out = None
    for r in radii:
        sd = local_deviation(cells, bands, r)
        rough = sd.select("gx", "gy", *[(sum((F.col(b) for b in own), F.lit(0.0)) / len(own)).alias(f"rough_{t}_r{r}") for t, own in themes.items()])
        out = rough if out is None else out.join(rough, ["gx", "gy"])
    return out


def roughness_summary(rough: DataFrame) -> DataFrame:
    """(grp, radius, mean_std, sd_std, n) of the columns that `theme_roughness` names."""
    long = rough.unpivot(["gx", "gy"], [c for c in rough.columns if c.startswith("rough_")], "name", "value")
    part = lambda k: F.regexp_extract("name", "^rough_(.+)_r([0-9]+)$", k)
    return long.groupBy(part(1).alias("grp"), part(2).cast("int").alias("radius")).agg(F.avg("value").alias("mean_std"), F.stddev_pop("value").alias("sd_std"), F.count("value").alias("n"))


def burn(points: DataFrame, polygons: DataFrame, tile: float) -> DataFrame:
    """(points' columns, polygon): the polygons (id, ring array<struct<x,y>>) that hold each point, by the even-odd rule.

    Polygons go to the tiles that their bounds touch, points to the one they lie in, so the join is an equality
    on tiles; the exact test runs on what shares one.  A point on an edge counts by the rule's half-open side.
    """
    box = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    p = polygons.select(F.col("id").alias("polygon"), "ring", *[F.floor(box(f, c) / tile).cast("long").alias(f"{c}{n}") for c in "xy" for n, f in (("0", F.array_min), ("1", F.array_max))])
    p = p.withColumn("tx", F.explode(F.sequence("x0", "x1"))).withColumn("ty", F.explode(F.sequence("y0", "y1"))).drop("x0", "x1", "y0", "y1")
    q = points.withColumns({"tx": F.floor(F.col("x") / tile).cast("long"), "ty": F.floor(F.col("y") / tile).cast("long")})
    j = q.join(p, ["tx", "ty"])
    edges = F.zip_with("ring", F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = lambda e: ((e["a"]["y"] > F.col("y")) != (e["b"]["y"] > F.col("y"))) & (F.col("x") < e["a"]["x"] + (F.col("y") - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"]))
    inside = F.size(F.filter(edges, lambda e: F.when((e["a"]["y"] > F.col("y")) != (e["b"]["y"] > F.col("y")), crosses(e)).otherwise(False))) % 2 == 1
    return j.where(inside).drop("ring", "tx", "ty")
