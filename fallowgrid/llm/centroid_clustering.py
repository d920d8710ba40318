"""Centroid clustering of integer vectors, with partial-distance search for the nearest centroid.

A vector's components become floor(scale * x).  Lloyd rounds start from the vectors with the smallest salted hashes of
their ids; a round replaces every centroid that has vectors by their componentwise floor(sum / count), in exact integers.

Search: dimensions are worked on in the order of their variance over all vectors, highest first.  The first of them are
summed for every centroid; the one that leads there is measured in full and is the best so far.  Slice by slice the further
dimensions are added, and a centroid is abandoned once its partial sum is strictly above the best; those left after
the last have their full distances, and the least of them with the smallest number is taken.  While most pairs of a block are
left, a slice is added for the whole block, as that costs less than picking them.

Every round is one scan that ships counts and sums per task, so what moves is centroids times dimensions times tasks;
the driver holds centroids only.  No vector is shuffled or stored.

Defined cases: vectors that are null, of another size, or with a null or non-finite component are left out; components
beyond 2^27 after scaling are an error; repeated rows count each; of equal hashes (rows with one id) the smaller vector starts,
and rows without an id hash as if it were empty; with fewer vectors than `k` each starts a centroid; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integer_vectors import integers

SIZE, SCALE, K, ROUNDS = 64, 256.0, 40, 5
#: Dimensions summed for every centroid at first, then slice by slice for those left; vectors worked on at once.
FIRST, SLICE, ROWS = 16, 8, 2048
#: Share of pairs below the best from which a slice is added densely.
DENSE = 0.15


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; of equally near ones the smallest number."""
    x, c = x[:, order], centroids[:, order]
    size = x.shape[1]
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.int32 if size * (2 * most) ** 2 < 2**31 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    across, down = np.ascontiguousarray(x.T), np.ascontiguousarray(c.T)
    sums = np.zeros((len(x), len(c)), kind)

    def add(a: int, b: int) -> None:
        for d in range(a, b):
            gap = across[d][:, None] - down[d][None]
            gap *= gap
            np.add(sums, gap, out=sums)

    at = min(FIRST, size)
    add(0, at)
    lead = sums.argmin(1)
    gap = x - c[lead]
    best = (gap * gap).sum(1, dtype=kind)
    # while most pairs are below the best, a slice is added for all of them; then pair by pair
    while at < size and (left := sums <= best[:, None]).sum() > DENSE * left.size:
        add(at, min(at + SLICE, size))
        at = min(at + SLICE, size)
    i, j = np.nonzero(sums <= best[:, None])
    far = sums[i, j]
    for a in range(at, size, SLICE):
        gap = x[i, a : a + SLICE] - c[j, a : a + SLICE]
        far = far + (gap * gap).sum(1, dtype=kind)
        left = far <= best[i]
        i, j, far = i[left], j[left], far[left]
    least = best.copy()
    np.minimum.at(least, i, far)
    who = np.where(best == least, lead, len(c))
    tied = far == least[i]
    np.minimum.at(who, i[tied], j[tied])
    return who, least.astype(np.int64)


def _matrices(batches: Iterator[pa.RecordBatch], size: int, scale: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows kept, their matrix) in blocks; the vector is the last column."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            rows, x, _ = integers(part.column(part.num_columns - 1), scale, size)
            if len(rows):
                yield part, rows, x.reshape(-1, size)


def _sums(vectors: DataFrame, of, size: int, scale: float) -> dict[tuple[int, int], int]:
    """Exact sums over all vectors of what `of` returns for a block: {group: integers}, as {(group, place): sum}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for _, _, x in _matrices(batches, size, scale):
            for g, values in of(x).items():
                total[g] = [a + b for a, b in zip(total[g], values, strict=True)] if g in total else values
        rows = [(g, i, Decimal(v)) for g, values in total.items() for i, v in enumerate(values)]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.decimal128(38, 0))], names=["g", "i", "v"])

    return {(r.g, r.i): int(r.v) for r in vectors.mapInArrow(run, "g int, i int, v decimal(38,0)").groupBy("g", "i").agg(F.sum("v").alias("v")).collect()}


def _whole(d: np.ndarray) -> int:
    """Sum of non-negative 64-bit integers beyond 64 bits."""
    return (int((d >> 20).sum()) << 20) + int((d & 0xFFFFF).sum())


@dataclass
class Clusters:
    """Centroids, the dimensions by variance, and the size and summed distance of every cluster."""

    centroids: np.ndarray
    order: np.ndarray
    counts: list[int]
    inertia: list[int]
    size: int = SIZE
    scale: float = SCALE

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in self.centroids]


def _tally(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray, size: int, scale: float) -> dict[tuple[int, int], int]:
    """Of every cluster: the components' sums, then the count and the summed distance."""

    def of(x: np.ndarray) -> dict[int, list[int]]:
        who, far = nearest(x, centroids, order)
        return {int(g): [*x[who == g].sum(0).tolist(), int((who == g).sum()), _whole(far[who == g])] for g in np.unique(who)}

    return _sums(vectors, of, size, scale)


def fit(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: float = SCALE, salt: str = "2:") -> Clusters:
    """Start from the `k` smallest sha256(salt + id) and run `rounds` of Lloyd's steps over all vectors."""
    vectors = df.select(vector)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, x in _matrices(batches, size, scale):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), lists], names=["h", "v"])

    hashed = df.select(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256).alias("h"), vector)
    starts = hashed.mapInArrow(kept, "h string, v array<bigint>").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r.v for r in starts], np.int64).reshape(len(starts), size)
    if not len(starts):
        return Clusters(centroids, np.arange(size), [], [], size, scale)

    def spread(x: np.ndarray) -> dict[int, list[int]]:
        return {0: [len(x), *x.sum(0).tolist(), *(_whole(s) for s in (x * x).T)]}

    s = _sums(vectors, spread, size, scale)
    n = s[0, 0]
    order = np.array(sorted(range(size), key=lambda d: (s[0, 1 + d] ** 2 - n * s[0, 1 + size + d], d)))
    for _ in range(rounds):
        t = _tally(vectors, centroids, order, size, scale)
        centroids = np.array([[t[g, d] // t[g, size] for d in range(size)] if (g, size) in t else c for g, c in enumerate(centroids.tolist())], np.int64)
    t = _tally(vectors, centroids, order, size, scale)
    return Clusters(centroids, order, [t.get((g, size), 0) for g in range(len(centroids))], [t.get((g, size + 1), 0) for g in range(len(centroids))], size, scale)


def assign(df: DataFrame, model: Clusters, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The id (as `vec_id`), cluster and squared distance of every vector that is kept, the cluster's and all clusters' summed distance, and the centroid's digest."""
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inertia, digests, every = np.array(model.inertia, np.int64), pa.array(model.digests(), pa.string()), sum(model.inertia)
        for part, rows, x in _matrices(batches, model.size, model.scale):
            who, far = nearest(x, model.centroids, model.order)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows)), pa.array(who.astype(np.int32)), pa.array(far), pa.array(inertia[who]), pa.array(np.full(len(rows), every, np.int64)), digests.take(pa.array(who))],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return df.select(id, vector).mapInArrow(run, f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
