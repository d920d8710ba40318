"""Tallies of all pairs of points up to a distance: points meet block by block, never as joined rows.

Points lie in squares (or cubes) as wide as the longest distance, and a square's points are dealt to blocks of about BLOCK each.  Every block meets
itself and those of its own and the neighbouring squares, as two packed rows in one task that tallies their distances strip by strip.  Pairs grow with
the square of the points within reach of each other, as the result asks; what is moved grows with the points times the blocks within reach, and a
task holds two blocks and a strip at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Points of a block, and distances worked out at once.
BLOCK, STRIP = 4096, 1 << 14


def _block(points: pa.Scalar, at: int, fields: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray | None]]:
    """(ids, places, fields, where each field is known or None if everywhere) of a packed block."""
    columns = points.values.flatten()
    number = lambda c: c.to_numpy(zero_copy_only=False)
    values = columns[1 + at : 1 + at + fields]
    return number(columns[0]), np.stack([number(c) for c in columns[1 : 1 + at]]), [number(c) for c in values], [c.is_valid().to_numpy(zero_copy_only=False) if c.null_count else None for c in values]


def _tally(bins: Callable, total: int, at: int, fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lag, s, m = np.zeros(total, np.int64), np.zeros(total), np.zeros((fields, total)), np.zeros((fields, total), np.int64)
        for batch in batches:
            for one, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ids_a, place_a, a, known_a = _block(left, at, fields)
                ids_b, place_b, b, known_b = _block(right, at, fields)
                same = one or np.intersect1d(ids_a, ids_b).size > 0
                step = max(1, STRIP // max(1, len(ids_b)))
                for i in range(0, len(ids_a), step):
                    k = slice(i, i + step)
                    first = i if one else 0  # of a block with itself every pair once
                    square = sum((x[k, None] - y[None, first:]) ** 2 for x, y in zip(place_a, place_b, strict=True))
                    distance, found = bins(square)
                    d = distance.ravel()
                    out = None
                    if same:
                        out = ids_a[k, None] == ids_b[None, first:]
                        if one:
                            out |= np.tri(*out.shape, k=0, dtype=bool)
                    gaps = [((x[k, None] - y[None, first:]) ** 2).ravel() for x, y in zip(a, b, strict=True)]
                    both = [None if p is None and q is None else ((np.ones(len(ids_a), bool) if p is None else p)[k, None] & (np.ones(len(ids_b), bool) if q is None else q)[None, first:]).ravel() for p, q in zip(known_a, known_b, strict=True)]
                    for number in found:
                        if out is not None:
                            number[out] = total
                        number = number.ravel()
                        count = np.bincount(number, minlength=total + 1)[:total]
                        n += count
                        lag += np.bincount(number, d, total + 1)[:total]
                        for f in range(fields):
                            if both[f] is None:
                                s[f] += np.bincount(number, gaps[f], total + 1)[:total]
                                m[f] += count
                            else:
                                known = number[both[f]]
                                s[f] += np.bincount(known, gaps[f][both[f]], total + 1)[:total]
                                m[f] += np.bincount(known, minlength=total + 1)[:total]
        some = np.flatnonzero(n)
        columns = [some.astype(np.int32), n[some], lag[some], *(x for f in range(fields) for x in (s[f][some], m[f][some]))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bin", "n", "lag", *(f"{x}{f}" for f in range(fields) for x in "sm")])

    return run


def pair_tallies(points: DataFrame, at: Sequence[str], fields: Sequence[str], reach: float, total: int, bins: Callable[[np.ndarray], tuple[np.ndarray, list[np.ndarray]]], block: int = BLOCK) -> DataFrame:
    """(bin, n, lag, s_field.., n_field..): number of pairs of points (id, at.., field..) by bin, their summed distance, and of every field the summed
    squared differences and the number of pairs that know both values.

    `bins` takes squared distances in the space of `at` and gives distances and for each tally the bins (`total` for none); pairs
    over `reach` apart in any of `at` may be left out.  Pairs of equal ids, and points without an id or a finite place, go.
    """
    spark = points.sparkSession
    cell = [f"_c{i}" for i in range(len(at))]
    finite = [F.abs(F.col(c).cast("double")) < float("inf") for c in at]
    p = points.where(" AND ".join(f"`{c}` IS NOT NULL" for c in ("id", *at)))
    for condition in finite:
        p = p.where(condition)
    p = p.select("id", *[F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(at)], *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(fields)])
    p = p.select("*", *[F.floor(F.col(f"_p{i}") / reach).alias(c) for i, c in enumerate(cell)])
    sizes = p.groupBy(*cell).agg(F.count("*").alias("_n"))
    dealt = p.join(sizes, cell).withColumn("_b", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / block)).cast("int"))
    packed = F.collect_list(F.struct("id", *[f"_p{i}" for i in range(len(at))], *[f"_f{i}" for i in range(len(fields))])).alias("_points")
    blocks = stored(dealt.groupBy(*cell, "_b").agg(packed).select(F.struct(*cell, "_b").alias("k"), "_points"), "blocks")
    keys = blocks.select("k")
    near = F.array(*[F.struct(*[(F.col(f"k.{c}") + i).alias(c) for c, i in zip(cell, o, strict=True)]) for o in product((-1, 0, 1), repeat=len(cell))])
    around = keys.select(F.col("k").alias("a"), F.explode(near).alias("to"))
    met = around.join(keys.select(F.col("k").alias("b"), F.struct(*[F.col(f"k.{c}").alias(c) for c in cell]).alias("to")), "to").where("a <= b").select("a", "b")
    joined = met.join(blocks.select(F.col("k").alias("a"), F.col("_points").alias("left")), "a").join(blocks.select(F.col("k").alias("b"), F.col("_points").alias("right")), "b")
    dealt_out = joined.repartition(4 * spark.sparkContext.defaultParallelism, "a", "b").select((F.col("a") == F.col("b")).alias("one"), "left", "right")
    names = "".join(f", s{f} double, m{f} long" for f in range(len(fields)))
    t = dealt_out.mapInArrow(_tally(bins, total, len(at), len(fields)), f"bin int, n long, lag double{names}")
    return t.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("lag").alias("lag"), *[x for i, f in enumerate(fields) for x in (F.sum(f"s{i}").alias(f"s_{f}"), F.sum(f"m{i}").alias(f"n_{f}"))])
