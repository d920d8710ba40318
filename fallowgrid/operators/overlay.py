"""Union of overlapping polygons: noding, coverage and ring assembly as Spark jobs.

`union_rings` takes polygons (rings by the even-odd rule, as `sources.vectors` reads them) and gives the rings of the union of each group.

1. Corners become whole multiples of `grid`, so that equal points are equal keys.  Corners within one such unit of an edge count as lying on it, so
   `grid` must be far finer than the data.  Edges of a group that meet are found strip by strip: strips
   are bounded by quantiles of the edges' middles, so that each holds about `per_strip` edges however they are spread.
2. The points where others meet an edge (crossings, and corners lying on it) cut it into pieces; equal pieces are one row, with the polygons
   that have it an odd number of times.
3. Of each piece a ray from its middle counts, per polygon, the pieces above: with the piece's own polygons that tells what covers its
   two sides.  Pieces covered on one side only bound the union; they are directed with the covered side at their left.
   Upright pieces are judged by a ray to the side, in strips across.
4. At each point an incoming piece is followed by the outgoing one that comes first when turning clockwise from where it came, so rings that
   touch in a point stay apart.  Pointer doubling finds every ring's least piece and each piece's distance to it in log2(longest ring)
   rounds, each one join; the rounds' tables are in the shared folder and dropped as they are done.

Only a strip's edges and a ring's corners stand in one task or row.  Polygons that are equal as a whole count once, so a group of
copies adds nothing.

Defined cases: null or empty rings, and rings of no area, add nothing; unclosed rings are closed; groups without area give no rows; a null group is a
group; holes come as rings of negative area.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..sources.tables import dropped, stored

#: Edges that a strip holds, about.
PER_STRIP = 1000
_PAIRS = 1 << 21


def edges(polygons: DataFrame, by: Sequence[str], grid: float) -> DataFrame:
    """(_g, poly, ax, ay, bx, by): directed edges with corners in multiples of `grid`; polygons that are equal as a whole count once."""
    whole = lambda c: F.round(c / grid).cast("long")
    snapped = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(whole(p["x"]).alias("x"), whole(p["y"]).alias("y"))))
    p = polygons.select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("_g"), snapped.alias("rings")).where("size(rings) > 0")
    p = p.groupBy("_g", F.xxhash64("rings").alias("h"), F.xxhash64(F.reverse("rings"), F.lit(1)).alias("h2")).agg(F.first("rings").alias("rings"))
    ring = p.select("_g", F.xxhash64("h", "h2").alias("poly"), F.explode("rings").alias("r"))
    nexts = F.concat(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), F.slice("r", 1, 1))
    e = ring.select("_g", "poly", F.explode(F.zip_with("r", nexts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e")).where("e.a <> e.b")
    return e.select("_g", "poly", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def _canonical(e: DataFrame) -> DataFrame:
    """Edges from their smaller to their larger corner."""
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    return e.withColumns({"_a": F.least(a, b), "_b": F.greatest(a, b)}).withColumns({"ax": F.col("_a.x"), "ay": F.col("_a.y"), "bx": F.col("_b.x"), "by": F.col("_b.y")}).drop("_a", "_b")


def _borders(e: DataFrame, low: str, high: str, per_strip: int) -> list[float]:
    """Borders between strips: quantiles of the edges' middles (one number per `per_strip` edges reaches the driver)."""
    n = e.count()
    k = n // per_strip
    if k < 1:
        return []
    middle = (F.col(low) + F.col(high)) / 2
    got = e.agg(F.percentile_approx(middle, [i / (k + 1) for i in range(1, k + 1)], max(10_000, 4 * k))).first()[0]
    return sorted(set(got))


def _in_strips(e: DataFrame, low: str, high: str, borders: list[float]) -> DataFrame:
    """Each row once per strip that [low, high] touches, by binary search in the borders."""
    schema = StructType([*e.schema.fields, StructField("_strip", IntegerType()), StructField("_home", BooleanType())])
    cuts = np.array(borders)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            lo, hi = x[[low, high]].min(axis=1).to_numpy(), x[[low, high]].max(axis=1).to_numpy()
            first, last = np.searchsorted(cuts, lo, "right"), np.searchsorted(cuts, hi, "right")
            home = np.searchsorted(cuts, (lo + hi) / 2, "right")
            n = last - first + 1
            at = np.repeat(np.arange(len(x)), n)
            strip = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + first[at]
            yield x.iloc[at].assign(_strip=strip.astype(np.int32), _home=strip == home[at])

    return e.mapInPandas(deal, schema)


def _contacts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, point) where other edges (rows ax, ay, bx, by of whole numbers) cross or touch the edge's inside."""
    top = np.maximum(x[:, 1], x[:, 3])
    order = np.argsort(np.minimum(x[:, 1], x[:, 3]), kind="stable")
    bottom = np.minimum(x[:, 1], x[:, 3])[order]
    found_e, found_p = [], []
    at = 0
    reach = np.searchsorted(bottom, top[order] + 1, "right")
    while at < len(order):
        n = np.maximum(reach[at:] - np.arange(at, len(order)) - 1, 0)
        step = max(1, int(np.searchsorted(np.cumsum(n), _PAIRS)))
        n = n[:step]
        i = np.repeat(np.arange(at, at + step), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at += step
        i, j = order[i], order[j]
        near = (np.minimum(x[i, 0], x[i, 2]) <= np.maximum(x[j, 0], x[j, 2]) + 1) & (np.minimum(x[j, 0], x[j, 2]) <= np.maximum(x[i, 0], x[i, 2]) + 1)
        i, j = i[near], j[near]
        p, q = x[i].astype(float), x[j].astype(float)
        r, s, w = p[:, 2:] - p[:, :2], q[:, 2:] - q[:, :2], q[:, :2] - p[:, :2]
        turn = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (w[:, 0] * s[:, 1] - w[:, 1] * s[:, 0]) / turn, (w[:, 0] * r[:, 1] - w[:, 1] * r[:, 0]) / turn
        hit = (turn != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        point = np.rint(p[hit, :2] + t[hit, None] * r[hit]).astype(np.int64)
        for e in (i[hit], j[hit]):
            found_e.append(e)
            found_p.append(point)
        # corners of the one within a unit of the other's inside: touching and running along
        for e, o in ((i, j), (j, i)):
            d = (x[e, 2:] - x[e, :2]).astype(float)
            long = (d * d).sum(1)
            for corner in (x[o, :2], x[o, 2:]):
                v = (corner - x[e, :2]).astype(float)
                along, off = (v * d).sum(1), np.abs(v[:, 0] * d[:, 1] - v[:, 1] * d[:, 0])
                on = (off * off <= long) & (along >= 0) & (along <= long)
                found_e.append(e[on])
                found_p.append(corner[on])
    if not found_e:
        return np.empty(0, int), np.empty((0, 2), np.int64)
    e, p = np.concatenate(found_e), np.concatenate(found_p)
    inside = (p != x[e, :2]).any(1) & (p != x[e, 2:]).any(1)
    return e[inside], p[inside]


def pieces(e: DataFrame, per_strip: int = PER_STRIP) -> DataFrame:
    """(_g, ax, ay, bx, by, owners): the edges cut where they meet, each piece once with the polygons that have it an odd number of times."""
    corner = ["ax", "ay", "bx", "by"]
    owned = stored(_canonical(e), "edges")
    lines = owned.select("_g", *corner).distinct()
    dealt = _in_strips(lines, "ax", "bx", _borders(lines, "ax", "bx", per_strip))
    def meet(x: pd.DataFrame) -> pd.DataFrame:
        which, point = _contacts(x[corner].to_numpy(np.int64))
        return x.iloc[which][["_g", *corner]].assign(px=point[:, 0], py=point[:, 1]).drop_duplicates(corner + ["px", "py"])

    points = dealt.groupBy("_g", "_strip").applyInPandas(meet, "_g string, ax long, ay long, bx long, by long, px long, py long")
    cuts = points.groupBy("_g", *corner).agg(F.collect_set(F.struct(F.col("px").alias("x"), F.col("py").alias("y"))).alias("cuts"))
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    # along the edge: by the product with its direction, exact in decimals
    far = lambda p: (p["x"] - F.col("ax")).cast("decimal(19,0)") * (F.col("bx") - F.col("ax")).cast("decimal(19,0)") + (p["y"] - F.col("ay")).cast("decimal(19,0)") * (F.col("by") - F.col("ay")).cast("decimal(19,0)")
    inner = F.transform(F.array_sort(F.transform(F.coalesce("cuts", F.array().cast("array<struct<x:bigint,y:bigint>>")), lambda p: F.struct(far(p).alias("d"), p.alias("p")))), lambda s: s["p"])
    chain = F.concat(F.array(at("ax", "ay")), inner, F.array(at("bx", "by")))
    same = [owned["_g"].eqNullSafe(cuts["_g"]), *(owned[c] == cuts[c] for c in corner)]
    whole = owned.join(cuts, same, "left").select(owned["_g"], "poly", *[owned[c] for c in corner], "cuts").select("_g", "poly", chain.alias("c"))
    part = whole.select("_g", "poly", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))).alias("e")).where("e.a <> e.b")
    odd = part.groupBy("_g", "e", "poly").agg((F.count("*") % 2).alias("n")).where("n = 1")
    out = odd.groupBy("_g", "e").agg(F.collect_list("poly").alias("owners"))
    out = stored(out.select("_g", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"), "owners"), "pieces")
    dropped(owned)
    return out


def _sides(x: np.ndarray, owners: list[np.ndarray], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the asked pieces (rows u, v, to, across; u the axis the strips are along): whether their upper and lower sides are covered."""
    low, high = np.minimum(x[:, 0], x[:, 2]), np.maximum(x[:, 0], x[:, 2])
    owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
    piece = np.repeat(np.arange(len(x)), [len(o) for o in owners])
    _, owner = np.unique(owner, return_inverse=True)
    order = np.argsort(owner, kind="stable")
    owner, piece = owner[order], piece[order]
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    upper, lower = np.zeros(len(asked), bool), np.zeros(len(asked), bool)
    step = max(1, _PAIRS // max(len(piece), 1))
    slope = np.where(high > low, (x[:, 3] - x[:, 1]) / np.where(high > low, x[:, 2] - x[:, 0], 1), 0.0)
    for a in range(0, len(asked), step):
        q = asked[a : a + step]
        m = (x[q, 0] + x[q, 2]) / 2
        y = (x[q, 1] + x[q, 3]) / 2
        over = (low[None] <= m[:, None]) & (m[:, None] < high[None])
        over &= x[None, :, 1] + (m[:, None] - x[None, :, 0]) * slope[None] > y[:, None]
        over[np.arange(len(q)), q] = False
        parity = np.add.reduceat(over[:, piece].astype(np.int32), heads, axis=1) % 2
        own = np.add.reduceat((piece[None] == q[:, None]).astype(np.int32), heads, axis=1) % 2
        upper[a : a + step] = parity.any(1)
        lower[a : a + step] = (parity ^ own).any(1)
    return upper, lower


def outline(cut: DataFrame, per_strip: int = PER_STRIP) -> DataFrame:
    """(_g, ax, ay, bx, by): the pieces that bound the union, directed with the covered side at their left."""
    def judged(axis: tuple[str, str, str, str], upright: bool) -> DataFrame:
        borders = _borders(cut, axis[0], axis[2], per_strip)
        dealt = _in_strips(cut.where(f"{axis[0]} <> {axis[2]}"), axis[0], axis[2], borders)

        def judge(x: pd.DataFrame) -> pd.DataFrame:
            at = x[list(axis)].to_numpy(np.int64).astype(float)
            asked = np.flatnonzero(x["_home"].to_numpy() & (x["ax"] == x["bx"]).to_numpy() if upright else x["_home"].to_numpy())
            up, down = _sides(at, [np.asarray(o, np.int64) for o in x["owners"]], asked)
            keep = up != down
            rows = x.iloc[asked[keep]]
            # canonical pieces run along the axis, so up is at their left; across it is at their right
            forward = up[keep] != upright
            a, b = rows[["ax", "ay"]].to_numpy(), rows[["bx", "by"]].to_numpy()
            start, end = np.where(forward[:, None], a, b), np.where(forward[:, None], b, a)
            return pd.DataFrame({"_g": rows["_g"].array, "ax": start[:, 0], "ay": start[:, 1], "bx": end[:, 0], "by": end[:, 1]})

        return dealt.groupBy("_g", "_strip").applyInPandas(judge, "_g string, ax long, ay long, bx long, by long")

    return judged(("ax", "ay", "bx", "by"), False).union(judged(("ay", "ax", "by", "bx"), True))


def linked(directed: DataFrame) -> DataFrame:
    """(_g, id, ax, ay, bx, by, next): each piece's successor on its ring."""
    e = stored(directed.withColumn("id", F.monotonically_increasing_id()), "outline")
    came, goes = e.alias("i"), e.alias("o")
    back = F.atan2(F.col("i.ay") - F.col("i.by"), F.col("i.ax") - F.col("i.bx"))
    out = F.atan2(F.col("o.by") - F.col("o.ay"), F.col("o.bx") - F.col("o.ax"))
    turn = back - out
    turn = F.when(turn <= 1e-12, turn + 2 * np.pi).otherwise(turn)
    j = came.join(goes, [F.col("i._g").eqNullSafe(F.col("o._g")), F.col("i.bx") == F.col("o.ax"), F.col("i.by") == F.col("o.ay")])
    return stored(j.groupBy(*[F.col(f"i.{c}").alias(c) for c in ("_g", "id", "ax", "ay", "bx", "by")]).agg(F.min_by("o.id", turn).alias("next")), "linked")


def cycles(links: DataFrame, id: str = "id", follow: str = "next", rounds: int = 64) -> DataFrame:
    """(id, ring, ahead): the least id of each row's cycle and the steps to it, by pointer doubling."""
    t = stored(links.select(F.col(id).alias("id"), F.col(follow).alias("jump"), F.col(id).alias("ring"), F.lit(0).cast("long").alias("ahead")), "jumps")
    span = 1
    for _ in range(rounds):
        o = t.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("ring").alias("_ring"), F.col("ahead").alias("_ahead"))
        nearer = F.col("_ring") < F.col("ring")
        new = stored(t.join(o, "jump").select("id", F.col("_jump").alias("jump"), F.least("ring", "_ring").alias("ring"), F.when(nearer, F.col("_ahead") + span).otherwise(F.col("ahead")).alias("ahead"), nearer.alias("moved")), "jumps")
        dropped(t)
        t, span = new.drop("moved"), span * 2
        if new.where("moved").isEmpty():
            return t.select("id", "ring", "ahead")
    raise RuntimeError(f"cycles longer than 2^{rounds}")


def union_rings(polygons: DataFrame, by: Sequence[str], grid: float = 1e-9, per_strip: int = PER_STRIP) -> DataFrame:
    """(by.., ring, area, perimeter, corners): the rings of each group's union; counter-clockwise, holes clockwise with negative area."""
    cut = pieces(edges(polygons, by, grid), per_strip)
    links = linked(outline(cut, per_strip))
    found = cycles(links)
    # the cycle starts at its least piece (0 steps ahead), which the one with the most steps to it follows
    place = F.when(F.col("ahead") == 0, F.lit(0)).otherwise(-F.col("ahead"))
    first = F.col("ahead") != 0
    rows = links.join(found, "id")
    cross = F.col("ax").cast("double") * F.col("by") - F.col("bx").cast("double") * F.col("ay")
    g = rows.groupBy("_g", "ring").agg((F.sum(cross) / 2 * grid * grid).alias("area"), (F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))) * grid).alias("perimeter"), F.array_sort(F.collect_list(F.struct(first.alias("f"), place.alias("p"), (F.col("ax") * grid).alias("x"), (F.col("ay") * grid).alias("y")))).alias("c"))
    group = F.from_json("_g", polygons.select(*by).schema)
    return g.select(*[group[c].alias(c) for c in by], "ring", "area", "perimeter", F.transform("c", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("corners"))


def union_area(polygons: DataFrame, by: Sequence[str], grid: float = 1e-9, rings: Callable[..., DataFrame] = union_rings) -> DataFrame:
    """(by.., area, perimeter, rings, holes) of each group's union."""
    r = rings(polygons, by, grid)
    return r.groupBy(*by).agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), F.count("*").alias("rings"), F.sum((F.col("area") < 0).cast("long")).alias("holes"))
