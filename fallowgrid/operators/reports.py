"""Table assembly: zonal summaries, shares, pivots, gates and diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zonal_means(cells: DataFrame, bridge: DataFrame, cell: str, unit: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Means of the cells of each unit; the unit's columns are carried."""
    return cells.join(bridge, cell).groupBy(*unit).agg(*[F.avg(v).alias(k) for k, v in values.items()])


def area_shares(df: DataFrame, by: Sequence[str], area: str) -> DataFrame:
    g = df.groupBy(*by).agg(F.sum(area).alias("area"))
    t = g.agg(F.sum("area").alias("_t"))
    return g.crossJoin(F.broadcast(t)).select(*by, "area", (100.0 * F.try_divide("area", "_t")).alias("share_pct"))


def weighted_share(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def saturation(m: str) -> list[Column]:
    """Mean, deviation, and the shares that are saturated and vetoed, in one aggregation."""
    c = F.col(m)
    return [F.avg(c).alias("mean"), F.stddev_pop(c).alias("sigma"), F.avg((c >= 0.999).cast("double")).alias("saturated"), F.avg((c <= 0.001).cast("double")).alias("vetoed")]


def pooled_sigma(s1: Column, m1: Column, s2: Column, m2: Column) -> Column:
    return F.sqrt((s1 * s1 + s2 * s2) / 2 + (m1 - m2) * (m1 - m2) / 4)


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= k)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, rows): matched keys, and orphans and repeats of either side."""
    a, b = (d.groupBy(key).agg(F.count("*").alias("n")) for d in (left, right))
    parts = [("matched", a.join(b, key, "left_semi")), ("left_only", a.join(b, key, "left_anti")), ("right_only", b.join(a, key, "left_anti")), ("left_repeated", a.where("n > 1")), ("right_repeated", b.where("n > 1"))]
    out = None
    for name, part in parts:
        row = part.agg(F.count("*").alias("rows")).select(F.lit(name).alias("side"), "rows")
        out = row if out is None else out.union(row)
    return out


def difference(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """(column, lowest, highest, changed): extremes of new - old per column over joined keys."""
    j = old.alias("o").join(new.alias("n"), key)
    row = j.select(*[(F.col(f"n.{c}") - F.col(f"o.{c}")).alias(c) for c in columns]).agg(*[f(c).alias(f"{c}#{n}") for c in columns for n, f in (("a", F.min), ("b", F.max))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}#a`").cast("double").alias("lowest"), F.col(f"`{c}#b`").cast("double").alias("highest")) for c in columns])).alias("x")
    return row.select(each).select("x.*", (F.greatest(F.abs("x.lowest"), F.abs("x.highest")) > eps).alias("changed"))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Refuse stale inputs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"stale input: it lacks {missing}")
    return df


def sigma_verdict(before: Column, after: Column, weight_shift: Column) -> Column:
    """FAIL where discrimination is lost, WARN where it halves or doubles or a weight moves by over 0.05, else OK."""
    ratio = F.try_divide(after, before)
    return F.when((before > 0) & (after <= 0), "FAIL").when((ratio < 0.5) | (ratio > 2) | (F.abs(weight_shift) > 0.05), "WARN").otherwise("OK")


def half_delta(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """calib, val and full side by side, with val - calib."""
    p = metrics.groupBy(*keys).pivot("half", ["calib", "val", "full"]).agg(F.first("value"))
    return p.withColumn("delta", F.col("val") - F.col("calib"))


def relative_change(before: Column, after: Column) -> list[Column]:
    """Difference in percentage points of two shares, and the relative change (null where there was nothing)."""
    return [(100 * (after - before)).alias("change_pp"), (100 * F.try_divide(after - before, before)).alias("change_pct")]


def renormalised(df: DataFrame, value: str, by: Sequence[str]) -> Column:
    """Each value over the sum of its group."""
    return F.col(value) / F.sum(value).over(Window.partitionBy(*by))


def breakpoint_gate(points: DataFrame, move: float = 0.05, note: float = 0.001) -> DataFrame:
    """Adds delta_over_span, move_breakpoint and rewrite_note to rows (value_now, value_proposed, span)."""
    delta = F.col("value_proposed") - F.col("value_now")
    over = F.abs(F.try_divide(delta, F.col("span")))
    return points.withColumns({"delta_over_span": over, "move_breakpoint": over >= move, "rewrite_note": (over < move) & (F.abs(F.try_divide(delta, F.abs("value_now"))) > note)})


def footprint(cells: DataFrame, x: str, y: str, step: float, eps: float = 1e-6) -> DataFrame:
    """(x0, x1, y0, y1, n, off_grid): bounds, and how many cells lie off the grid that starts at the lowest corner."""
    box = cells.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    off = lambda c, c0: F.abs((F.col(c) - F.col(c0)) / step - F.round((F.col(c) - F.col(c0)) / step)) > eps
    return cells.select(x, y).crossJoin(F.broadcast(box)).groupBy("x0", "x1", "y0", "y1").agg(F.count("*").alias("n"), F.sum((off(x, "x0") | off(y, "y0")).cast("long")).alias("off_grid"))


def zone_gate(df: DataFrame, zone: str, area: str, zones: int) -> DataFrame:
    """(zone, area, share_pct, collapsed): collapsed where fewer than `zones` zones have any area."""
    g = area_shares(df, [zone], area)
    n = g.agg(F.count_if(F.col("area") > 0).alias("_n"))
    return g.crossJoin(F.broadcast(n)).withColumn("collapsed", F.col("_n") < zones).drop("_n")


def ranking(units: DataFrame, suit: str, unused: str, zone: str, delta: str, k: int = 5) -> DataFrame:
    """(list, place, unit's columns, opportunity, zone_id): the k units of most opportunity and the k that lose most; zone_id is the rounded mean of 0-based ids plus 1."""
    u = units.withColumns({"opportunity": F.col(suit) * F.col(unused), "zone_id": F.round(zone).cast("int") + 1})
    out = None
    for name, order in (("opportunity", [F.desc("opportunity"), F.asc("unit")]), ("vulnerability", [F.asc(delta), F.asc("unit")])):
        top = top_k(u, k, order)
        top = top.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("list", F.lit(name))
        out = top if out is None else out.union(top)
    return out


def by_theme(df: DataFrame, factor: str, value: str, themes: Sequence[tuple[str, str]], other: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., theme, value): sums by the theme of a factor's name (first prefix that fits)."""
    theme = F.lit(other)
    for prefix, name in reversed(list(themes)):
        theme = F.when(F.col(factor).startswith(prefix), F.lit(name)).otherwise(theme)
    return df.groupBy(*by, theme.alias("theme")).agg(F.sum(value).alias(value))


def localised(value: Column, places: int) -> Column:
    """Fixed places with a decimal comma and points between thousands."""
    return F.translate(F.format_number(value, places), ",.", ".,")


def signed(value: Column, places: int) -> Column:
    """`localised` with its sign shown; what rounds to zero has none."""
    text = localised(F.abs(value), places)
    return F.when(F.round(value, places) == 0, text).otherwise(F.concat(F.when(value < 0, "-").otherwise("+"), text))


def latex_table(df: DataFrame, caption: str, label: str) -> str:
    """A tabular of a report table: a few rows, in their order."""
    escape = lambda v: "--" if v is None else "".join("\\" + c if c in "&%$#_{}" else c for c in str(v))
    body = [" & ".join(map(escape, row)) + r" \\" for row in [df.columns, *df.collect()]]
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", body[0], r"\hline", *body[1:], r"\hline", r"\end{tabular}", r"\end{table}", ""])


def search(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column holds the text, whatever the case."""
    return df.where(F.contains(F.lower(column), F.lower(F.lit(text))))


def eligible(policy: str) -> Column:
    """The cells that a mask policy leaves in."""
    known = {"available": F.col("mask_available") == 1, "exclude_only": F.col("mask_excluded") == 0, "none": F.lit(True)}
    if policy not in known:
        raise ValueError(f"unknown mask policy {policy!r}")
    return known[policy]


def half_filter(df: DataFrame, half: str, split: str = "split") -> DataFrame:
    """The rows of a half; `full` adds no filter at all."""
    if half not in ("full", "calib", "val"):
        raise ValueError(f"unknown half {half!r}")
    return df if half == "full" else df.where(F.col(split) == int(half == "val"))


def discrimination(cells: DataFrame, now: dict[str, str], then: dict[str, str]) -> DataFrame:
    """(half, factor, mean, sigma, saturated, vetoed, mean_future, sigma_future, sigma_horizon): memberships now and then, all factors and halves in one aggregation."""
    aggs = [x.alias(f"{f}#{n}") for f, c in now.items() for n, x in zip(("mean", "sigma", "saturated", "vetoed"), saturation(c), strict=True)]
    aggs += [x.alias(f"{f}#{n}_future") for f, c in then.items() for n, x in zip(("mean", "sigma"), saturation(c), strict=False)]
    names = ("mean", "sigma", "saturated", "vetoed", "mean_future", "sigma_future")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), *[F.col(f"`{f}#{n}`").alias(n) for n in names]) for f in now])).alias("x")
    out = cells.groupBy("half").agg(*aggs).select("half", each).select("half", "x.*")
    return out.withColumn("sigma_horizon", pooled_sigma(F.col("sigma"), F.col("mean"), F.col("sigma_future"), F.col("mean_future")))


def squares_by_theme(df: DataFrame, themes: dict[str, Sequence[str]]) -> DataFrame:
    """(theme, squares): mean over the rows of the sum of squares of a theme's bands, one aggregation for all."""
    row = df.agg(*[F.avg(sum((F.col(c) * F.col(c) for c in own), F.lit(0.0))).alias(t) for t, own in themes.items()])
    return row.unpivot([], list(themes), "theme", "squares")


def cross_checks(labels: DataFrame, zones: DataFrame, roles: DataFrame, known: Sequence[str]) -> DataFrame:
    """(check, ok): every zone has one label and each label a zone, zones count from 1 without gaps, all roles are known."""
    a, b = labels.select("zone"), zones.select("zone").distinct()
    rows = [
        ("labels", a.join(b, "zone", "left_anti").agg(F.count("*").alias("x")).crossJoin(b.join(a, "zone", "left_anti").agg(F.count("*").alias("y"))).crossJoin(a.agg((F.count("*") - F.countDistinct("zone")).alias("z"))).select((F.col("x") + F.col("y") + F.col("z") == 0).alias("ok"))),
        ("order", b.agg(((F.min("zone") == 1) & (F.max("zone") == F.count("*"))).alias("ok"))),
        ("roles", roles.where(~F.col("role").isin(*known)).agg((F.count("*") == 0).alias("ok"))),
    ]
    out = None
    for name, row in rows:
        row = row.select(F.lit(name).alias("check"), "ok")
        out = row if out is None else out.union(row)
    return out
