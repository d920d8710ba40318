"""Sizing of spatial blocks from semivariograms over great-circle distances.

Point pairs come from neighbouring cells of latitude bands: a band is as high as the longest lag, and its cells are as wide as that
lag is in longitude at the band's farther edge from the equator, so cells widen towards the poles and no pair is missed (nor across the
180th meridian).  Semivariograms tally all pairs of all fields and windows block by block instead, over all points unless a bound is given.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import pair_tallies
from .sampling import uniform_sample

#: Mean radius of the Earth, kilometres a degree of the nominal block edge.
RADIUS_KM, KM_A_DEGREE = 6371.0, 111.0


def residuals(df: DataFrame, y: str, xs: Sequence[str]) -> Column:
    """y less its least-squares fit by xs (with a constant): the normal equations' sums come from one aggregation of complete rows."""
    terms = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    sums = [F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    row = df.dropna(subset=[y, *xs]).agg(*sums, *[F.sum(a * F.col(y)).alias(f"t{i}") for i, a in enumerate(terms)]).first()
    m = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(terms))] for i in range(len(terms))], float)
    beta = np.linalg.lstsq(m, np.array([row[f"t{i}"] or 0.0 for i in range(len(terms))], float), rcond=None)[0]
    return F.col(y) - sum((F.lit(float(b)) * t for b, t in zip(beta[1:], terms[1:], strict=True)), F.lit(float(beta[0])))


def block_km(points: DataFrame, sides: int, lon: str = "lon", lat: str = "lat") -> float:
    """Nominal edge of a block: the bounds' width at their mean latitude, over the number of blocks a side."""
    b = points.agg(*[f(c).alias(f"{n}{c}") for c in (lon, lat) for n, f in (("a", F.min), ("b", F.max))]).first()
    if b[f"a{lon}"] is None:
        return float("nan")
    return (b[f"b{lon}"] - b[f"a{lon}"]) * KM_A_DEGREE * math.cos(math.radians((b[f"a{lat}"] + b[f"b{lat}"]) / 2)) / sides


def distance_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat1 - lat2) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon1 - lon2) / 2), F.lit(2.0))
    return F.lit(2 * RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def close_pairs(points: DataFrame, longest_km: float, keep: Sequence[str]) -> DataFrame:
    """(distance, keep.. of both as a_.. and b_..): the pairs of points (id, lon, lat, keep..) up to `longest_km` apart, each once."""
    height = math.degrees(longest_km / RADIUS_KM)
    reach = math.sin(min(longest_km / RADIUS_KM / 2, math.pi / 2))
    # the widest difference in longitude of such pairs, where the farther of both from the equator is at `lat`
    width = lambda lat: F.degrees(2 * F.asin(F.least(F.lit(1.0), reach / F.greatest(F.cos(F.radians(F.least(F.abs(lat), F.lit(90.0)))), F.lit(1e-9)))))
    edge = lambda band: F.greatest(F.abs(band * height), F.abs((band + 1) * height))
    p = points.select("id", "lon", "lat", *keep, F.floor(F.col("lat") / height).cast("int").alias("band"), F.pmod(F.col("lon").cast("double"), F.lit(360.0)).alias("_l"))
    cells = lambda band: F.greatest(F.floor(360 / width(edge(band))), F.lit(1)).cast("int")
    b = p.withColumn("n", cells(F.col("band"))).withColumn("cell", F.least(F.floor(F.col("_l") / (360 / F.col("n"))).cast("int"), F.col("n") - 1))
    a = p.withColumn("to", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)]))).withColumn("n", cells(F.col("to"))).withColumn("w", width(F.greatest(edge(F.col("to")), F.abs("lat"))))
    span = lambda k: F.floor((F.col("_l") + k * F.col("w")) / (360 / F.col("n"))).cast("int")
    every = F.when(2 * F.col("w") >= 360, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array_distinct(F.transform(F.sequence(span(-1), span(1)), lambda c: F.pmod(c, F.col("n")))))
    a = a.withColumn("cell", F.explode(every)).select(F.col("to").alias("band"), "cell", *[F.col(c).alias(f"a_{c}") for c in ("id", "lon", "lat", *keep)])
    b = b.select("band", "cell", *[F.col(c).alias(f"b_{c}") for c in ("id", "lon", "lat", *keep)])
    j = a.join(b, ["band", "cell"]).where("a_id < b_id")
    return j.select(distance_km(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")).alias("distance"), *[f"{s}_{c}" for s in "ab" for c in keep]).where(F.col("distance") <= longest_km)


def semivariograms(points: DataFrame, fields: Sequence[str], windows: Sequence[float], most_points: int | None, bins: int = 40, seed: int = 42) -> DataFrame:
    """(field, window, bin, centre, gamma, n): bins are open at their nearer end, empty ones have a null gamma.

    Of all points, or a sample of `most_points` drawn once for all fields.  Points meet in blocks by their places on a unit sphere (see `pairs`).
    """
    own = points.dropna(subset=["lon", "lat"])
    own = own if most_points is None else uniform_sample(own, "id", most_points, seed)
    total = len(windows) * bins

    def numbered(square: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        distance = 2 * RADIUS_KM * np.arcsin(np.minimum(np.sqrt(square) / 2, 1.0))
        out = []
        for i, w in enumerate(windows):
            number = np.ceil(np.minimum(distance, 2 * w) / (w / bins)).astype(np.intp) + (i * bins - 1)
            number[(distance <= 0) | (distance > w)] = total
            out.append(number)
        return distance, out

    lon, lat = F.radians("lon"), F.radians("lat")
    sphere = own.select("id", *fields, (F.cos(lat) * F.cos(lon)).alias("_x"), (F.cos(lat) * F.sin(lon)).alias("_y"), F.sin(lat).alias("_z"))
    chord = 2 * math.sin(min(max(windows) / RADIUS_KM / 2, math.pi / 2)) * (1 + 1e-9)
    t = pair_tallies(sphere, ["_x", "_y", "_z"], fields, chord, total, numbered)
    window = F.element_at(F.array(*[F.lit(float(w)) for w in windows]), F.floor(F.col("bin") / bins).cast("int") + 1)
    tall = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"s_{f}").alias("s"), F.col(f"n_{f}").alias("n")) for f in fields])).alias("x")
    t = t.select(window.alias("window"), F.pmod("bin", F.lit(bins)).alias("bin"), tall).select("window", "bin", "x.*")
    every = points.sparkSession.createDataFrame([(f, float(w), i, (i + 0.5) * w / bins) for f in fields for w in windows for i in range(bins)], "field string, window double, bin int, centre double")
    return every.join(F.broadcast(t), ["field", "window", "bin"], "left").select("field", "window", "bin", "centre", F.try_divide("s", 2 * F.col("n")).alias("gamma"), F.coalesce("n", F.lit(0)).alias("n"))


def ranges(gamma: DataFrame, block: float, bins: int = 40, share: float = 0.95, climbing: float = 1.05) -> DataFrame:
    """(field, window, sill, nugget_share, range, shared): what each semivariogram says about a block edge of `block` kilometres.

    The sill is the mean of the running maximum over the last quarter of bins, the nugget the first bin's value; the range is the first bin's centre
    that reaches `share` of the sill, and null while the maximum still climbs in the last bin (`climbing`) or fewer than four bins have pairs.
    `shared` is the part of the structured variance that two points a block apart still share.
    """
    w = Window.partitionBy("field", "window").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    e = gamma.withColumn("env", F.max("gamma").over(w))
    tail = max(1, round(0.25 * bins))
    by = lambda c, cond: F.min(F.when(cond, F.struct("bin", c)))[c]
    lower = F.max(F.when(F.col("centre") <= block, F.struct("centre", "gamma")))
    upper = F.min(F.when(F.col("centre") >= block, F.struct("centre", "gamma")))
    g = e.groupBy("field", "window").agg(
        F.count("gamma").alias("k"), F.avg(F.when(F.col("bin") >= bins - tail, F.col("env"))).alias("sill"), F.count(F.when((F.col("bin") >= bins - tail) & F.col("env").isNotNull(), 1)).alias("t"),
        by("gamma", F.col("gamma").isNotNull()).alias("nugget"), F.max("env").alias("last"), F.array_sort(F.collect_list(F.struct("bin", "centre", "gamma", "env"))).alias("b"), lower.alias("lo"), upper.alias("hi"),
    )
    g = g.withColumn("sill", F.when((F.col("k") >= 4) & (F.col("t") == tail), F.col("sill"))).withColumn("nugget", F.when(F.col("k") >= 4, F.col("nugget")))
    reached = F.filter("b", lambda x: x["gamma"].isNotNull() & (x["env"] >= share * F.col("sill")))
    found = F.when((F.col("sill") > 0) & (F.col("last") <= climbing * F.col("sill")), F.get(reached, 0)["centre"])
    at = F.when(F.col("lo").isNull(), F.col("hi.gamma")).when(F.col("hi").isNull(), F.col("lo.gamma")).when(F.col("hi.centre") == F.col("lo.centre"), F.col("lo.gamma"))
    at = at.otherwise(F.col("lo.gamma") + (F.col("hi.gamma") - F.col("lo.gamma")) * (block - F.col("lo.centre")) / (F.col("hi.centre") - F.col("lo.centre")))
    structured = F.col("sill") - F.col("nugget")
    shared = F.when(structured > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("sill") - at) / structured)))
    return g.select("field", "window", "sill", F.when(F.col("sill") > 0, F.col("nugget") / F.col("sill")).alias("nugget_share"), found.alias("range"), F.when(at.isNotNull(), shared).alias("shared"))


def verdict(framing: Column, range_km: Column, nugget_share: Column, block: float) -> Column:
    return (
        F.when(nugget_share > 0.95, "uninterpretable").when(framing == "fit", "context only").when(range_km.isNull(), "no plateau in window")
        .when(range_km < block, "ok").when(range_km < 2 * block, "caveat").otherwise("fail")
    )


def block_sizing(points: DataFrame, crops: Mapping[str, tuple[str, str]], sides: int, most_points: int | None, windows: Sequence[float] = (400.0, 800.0), bins: int = 40, seed: int = 42, regress: bool = False) -> tuple[DataFrame, str]:
    """Rows (crop, framing, window, block, sill, nugget_share, range, shared, verdict), and the gate's word.

    `crops` names each crop's fitted score and its 0/1 presence.  Framings: `fit` the score, `presence`, and `residual`, presence less score
    (or less its regression on the score).  The gate looks at the residuals in the narrowest window: go if their longest range is
    below the block edge, caveat below twice that, else no-go; no-go as well where no range can be told.
    """
    block = block_km(points, sides)
    framed = {"fit": lambda s, p: F.col(s), "presence": lambda s, p: F.col(p), "residual": lambda s, p: residuals(points, p, [s]) if regress else F.col(p) - F.col(s)}
    fields = {f"{name}|{framing}": make(s, p).cast("double") for name, (s, p) in crops.items() for framing, make in framed.items()}
    d = points.select("id", "lon", "lat", *[c.alias(n) for n, c in fields.items()])
    r = ranges(semivariograms(d, list(fields), windows, most_points, bins, seed), block, bins)
    part = F.split("field", r"\|")
    r = r.select(part[0].alias("crop"), part[1].alias("framing"), "window", F.lit(block).alias("block"), "sill", "nugget_share", "range", "shared")
    r = r.withColumn("verdict", verdict(F.col("framing"), F.col("range"), F.col("nugget_share"), block))
    worst = r.where((F.col("framing") == "residual") & (F.col("window") == min(windows))).agg(F.max("range")).first()[0]
    return r, "no-go" if worst is None or not worst < 2 * block else "go" if worst < block else "caveat"
