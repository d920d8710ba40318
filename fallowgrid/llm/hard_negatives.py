"""Hard negatives by distributed radix selection.

Vectors become integers floor(scale * x); a row's score is its inner product with an anchor.  An anchor's positives are its
first rows of the same label, and of every positive the first rows of other labels whose scores lie in a window below
the positive's.  Both are the same task: of each window (anchor, wanted side, lowest and highest score), the first k rows by
(score descending, id ascending).

Selection: every scan scores the windows' anchors against all rows, block by block, and counts the window's rows in 256 buckets of
(highest score - score); a task ships, per window, its buckets down to its own kth row.  Their sums give the
bucket of the kth row; the next scan counts only inside that one, digit by digit, until no more than `GATHER` rows are left at or above
it.  Where that many share one score, the digits of the ids follow.  Then one scan gathers the qualifying rows, and a window
function over these few ranks them.

Anchors are worked on in chunks of `CHUNK`: a chunk's vectors and windows are what is sent to the tasks, so that is of
bounded size, and so are the counts.  A chunk costs a few scans of all rows: the stated queries against all rows, in blocks.
The integer vectors are written once to the shared folder with a number per row, and dropped at the end.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; vectors of different sizes have no
score, so they don't meet; a component beyond 2^27 after scaling, or scores that may pass 2^62, are an error.  Rows with one id
are rows of their own (an anchor's other rows are all but itself, and each such row is an anchor); rows without an id are never anchors,
keep their label, and come last among equal scores; equal rows beyond the first k are interchangeable.  Without positives
or negatives an anchor has no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored
from .integer_vectors import integers

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256.0, 5, 3, 50, 95
#: Anchors sent to the tasks at once; digits of a pass; rows gathered per window at most (ties of ids aside).
CHUNK, BITS, GATHER = 8192, 8, 32
#: Rows and anchors scored at once.
ROWS, ANCHORS = 1024, 1024
_ID_LAST = np.int64(2**63 - 1)


@dataclass
class Windows:
    """Of each window: its anchor's place, the scores from `lo` to `hi`, and what is known of the kth row.

    The kth row's score is hi - base - [0, 2^shift); once that is one score (shift 0 and `tied`), its id is idlo + ibase + [0, 2^ishift).
    """

    anchor: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    base: np.ndarray
    shift: np.ndarray
    need: np.ndarray
    tied: np.ndarray
    ibase: np.ndarray
    ishift: np.ndarray
    open: np.ndarray

    @staticmethod
    def of(anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> Windows:
        n = len(anchor)
        span = np.maximum(hi - lo, 0)
        shift = np.maximum(_bits(span) - BITS, 0)
        zero = np.zeros(n, np.int64)
        return Windows(anchor, lo, hi, zero, shift, np.full(n, k), np.zeros(n, bool), np.zeros(n, np.uint64), zero.copy(), lo <= hi)


def _bits(x: np.ndarray) -> np.ndarray:
    """Binary digits of non-negative integers."""
    return np.array([int(v).bit_length() for v in x], np.int64)


def normalised(df: DataFrame, id: str, label: str, vector: str, scale: float, relabel: Column | None) -> DataFrame:
    """(row, vec_id, label, v): the rows that take part, written once; `row` tells them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x, off = integers(batch.column(2), scale)
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in (0, 1)), lists], names=["vec_id", "label", "v"])

    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("vec_id"), (F.col(label) if relabel is None else relabel).cast("long").alias("label"), vector)
    return stored(rows.mapInArrow(run, "vec_id long, label long, v array<int>").select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")


def _exact(size: int, most: int) -> type:
    """Floats where inner products of such vectors are exact in them, else 64-bit integers."""
    if size * most * most >= 2**62:
        raise ValueError("scores may pass 2^62")
    return np.float64 if size * most * most < 2**53 else np.int64


def _scored(batches: Iterator[pa.RecordBatch], anchors: list[tuple[int, int, np.ndarray]]):
    """Blocks of (ids, rows, labels, anchor places, scores [row, anchor]) of rows and anchors of one size; the anchor's own row is among them."""
    sizes: dict[int, list[int]] = {}
    for p, (_, _, v) in enumerate(anchors):
        sizes.setdefault(len(v), []).append(p)
    stacked = {n: [(np.array(ps[a : a + ANCHORS]), np.stack([anchors[p][2] for p in ps[a : a + ANCHORS]]).astype(np.int64)) for a in range(0, len(ps), ANCHORS)] for n, ps in sizes.items()}
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            batch = whole.slice(a, ROWS)
            ids = batch.column(1).fill_null(int(_ID_LAST)).to_numpy()
            rows, labels, v = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            off = v.offsets.to_numpy().astype(np.int64)
            flat = v.values.slice(off[0], off[-1] - off[0]).to_numpy().astype(np.int64)
            off -= off[0]
            for n, groups in stacked.items():
                own = np.flatnonzero(np.diff(off) == n)
                if not len(own):
                    continue
                x = flat[(off[own][:, None] + np.arange(n)[None])].reshape(len(own), n)
                for places, q in groups:
                    kind = _exact(n, max(int(np.abs(x).max(initial=0)), int(np.abs(q).max(initial=0))))
                    yield ids[own], rows[own], labels[own], places, (x.astype(kind) @ q.T.astype(kind)).astype(np.int64)


class _Hits:
    """Rows of a block that a set of windows lets through."""

    def __init__(self, anchors: list[tuple[int, int, np.ndarray]], w: Windows, chosen: np.ndarray, same: bool):
        self.label = np.array([x[1] for x in anchors], np.int64)
        self.row = np.array([x[0] for x in anchors], np.int64)
        order = chosen[np.argsort(w.anchor[chosen], kind="stable")]
        # windows of an anchor in lanes: lane j holds every anchor's jth window, or -1
        counts = np.bincount(w.anchor[order], minlength=len(anchors))
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        lane = np.arange(len(order)) - first[w.anchor[order]]
        self.lanes = np.full((int(counts.max(initial=0)), len(anchors)), -1, np.int64)
        self.lanes[lane, w.anchor[order]] = order
        self.same = same

    def of(self, rows, labels, places, scores, low, high):
        """(window, index of row, score) of the rows on the wanted side with low[window] <= score <= high[window]."""
        side = labels[:, None] == self.label[places][None]
        if not self.same:
            side = ~side
        else:
            side &= rows[:, None] != self.row[places][None]
        for lane in self.lanes:
            w = lane[places]
            some = np.flatnonzero(w >= 0)
            if not len(some):
                continue
            w = w[some]
            s = scores if len(some) == len(places) else scores[:, some]
            ok = side if len(some) == len(places) else side[:, some]
            i, j = np.nonzero(ok & (s >= low[w][None]) & (s <= high[w][None]))
            yield w[j], i, s[i, j]


def _count(rows: DataFrame, anchors, w: Windows, same: bool, k: int, least_id: int) -> dict[int, tuple[int, int, int]]:
    """{window: (bucket of the kth row, rows before it, rows in it)} of the open windows with k rows; one scan."""
    chosen = np.flatnonzero(w.open)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(len(w.open), -1, np.int64)
        slot[chosen] = np.arange(len(chosen))
        hits, counts = _Hits(anchors, w, chosen, same), np.zeros((len(chosen), 1 << BITS), np.int64)
        high = w.hi - w.base
        low = np.maximum(w.lo, high - (np.int64(1) << np.minimum(w.shift + BITS, 62)) + 1)
        low = np.where(w.tied, high, low)
        for ids, numbers, labels, places, scores in _scored(batches, anchors):
            for win, i, s in hits.of(numbers, labels, places, scores, low, high):
                bucket = (high[win] - s) >> w.shift[win]
                if w.tied.any():
                    # distances of ids in unsigned 64 bits: one below the base wraps around, beyond the window's digits
                    gap = ids[i].view(np.uint64) - np.uint64(least_id % 2**64) - w.ibase[win]
                    by_id = gap >> w.ishift[win].astype(np.uint64)
                    inside = ~w.tied[win] | (by_id < 1 << BITS)
                    bucket = np.where(w.tied[win], by_id, bucket.view(np.uint64)).view(np.int64)[inside]
                    win = win[inside]
                np.add.at(counts, (slot[win], bucket), 1)
                # scores in later buckets than the own kth row's can't be the kth row: the window narrows
                touched = np.unique(win)
                touched = touched[~w.tied[touched]]
                run_ = counts[slot[touched]].cumsum(1)
                full = run_[:, -1] >= w.need[touched]
                touched, cut = touched[full], (run_[full] >= w.need[touched[full]][:, None]).argmax(1)
                low[touched] = np.maximum(low[touched], high[touched] - ((cut + 1) << w.shift[touched]) + 1)
        before = counts.cumsum(1) - counts
        at, bucket = np.nonzero((counts > 0) & (before < w.need[chosen][:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(chosen[at].astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[at, bucket])], names=["w", "b", "n"])

    summed = rows.mapInArrow(run, "w int, b int, n long").groupBy("w", "b").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("w").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    needs = w.need
    return {r.w: (r.b, r.before, r.n) for r in summed.select("w", "b", "n", before).where(F.col("before") < k).collect() if r.before < needs[r.w] <= r.before + r.n}


def _select(rows: DataFrame, anchors, w: Windows, same: bool, k: int, ids: tuple[int, int]) -> DataFrame:
    """(w, vec_id, row, score): at least the first k rows of each window (all of a smaller one), and at most GATHER where ids differ."""
    floor_, idcut = w.lo.copy(), np.full(len(w.lo), _ID_LAST)
    while w.open.any():
        found = _count(rows, anchors, w, same, k, ids[0])
        for x in np.flatnonzero(w.open):
            if x not in found:  # fewer rows than wanted in all: each qualifies
                w.open[x] = False
                continue
            bucket, before, n = found[x]
            w.need[x] -= before
            if not w.tied[x]:
                w.base[x] += bucket << int(w.shift[x])
                floor_[x] = max(int(w.lo[x]), int(w.hi[x] - w.base[x]) - (1 << int(w.shift[x])) + 1)
            else:
                w.ibase[x] += np.uint64(bucket << int(w.ishift[x]))
                idcut[x] = min(ids[0] + int(w.ibase[x]) + (1 << int(w.ishift[x])) - 1, int(_ID_LAST))
            if k - w.need[x] + n <= GATHER or (w.tied[x] and w.ishift[x] == 0):
                w.open[x] = False
            elif w.tied[x]:
                w.ishift[x] = max(int(w.ishift[x]) - BITS, 0)
            elif w.shift[x]:
                w.shift[x] = max(int(w.shift[x]) - BITS, 0)
            else:
                w.tied[x], w.ishift[x] = True, max((ids[1] - ids[0]).bit_length() - BITS, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(anchors, w, np.flatnonzero(w.lo <= w.hi), same)
        for own, numbers, labels, places, scores in _scored(batches, anchors):
            for win, i, s in hits.of(numbers, labels, places, scores, floor_, w.hi):
                ok = (s > floor_[win]) | (own[i] <= idcut[win])
                win, i, s = win[ok], i[ok], s[ok]
                # of one window, score and id the first k rows do: the others are interchangeable with them
                order = np.lexsort((numbers[i], own[i], -s, win))
                win, i, s = win[order], i[order], s[order]
                new = np.concatenate([[True], (win[1:] != win[:-1]) | (s[1:] != s[:-1]) | (own[i][1:] != own[i][:-1])]) if len(win) else np.zeros(0, bool)
                nth = np.arange(len(win)) - np.maximum.accumulate(np.where(new, np.arange(len(win)), 0)) if len(win) else np.zeros(0, int)
                win, i, s = win[nth < k], i[nth < k], s[nth < k]
                known = own[i]
                yield pa.RecordBatch.from_arrays([pa.array(win.astype(np.int32)), pa.array(known, mask=known == _ID_LAST), pa.array(numbers[i]), pa.array(s)], names=["w", "vec_id", "row", "score"])

    return rows.mapInArrow(run, "w int, vec_id long, row long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """With their rank: the first k rows of each window by (score, id)."""
    over = Window.partitionBy("w").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(over).cast("int")).where(F.col("rank") <= k)


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(df: DataFrame, anchors: Column, *, id: str = "vec_id", label: str = "label", vector: str = "embedding", relabel: Column | None = None, scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of each anchor's positives the first `negatives`
    rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    `anchors` is a condition on `vec_id`; `relabel` replaces the label.
    """
    spark = df.sparkSession
    rows = normalised(df, id, label, vector, scale, relabel)
    bound = F.aggregate("v", F.lit(0).cast("double"), lambda acc, x: acc + x.cast("double") * x)
    span = rows.agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("b"), F.max(bound).alias("norm"), F.max(F.col("vec_id").isNull()).alias("none")).first()
    if span["norm"] is None:
        drop_stored(rows)
        return spark.createDataFrame([], SCHEMA)
    ids = (span["a"] if span["a"] is not None else 0, int(_ID_LAST) if span["none"] else span["b"])
    parts, last = [], -1
    while True:
        some = rows.where(anchors & F.col("vec_id").isNotNull() & (F.col("row") > last)).orderBy("row").limit(chunk).collect()
        if not some:
            break
        last = some[-1].row
        sent = [(r.row, r.label, np.array(r.v, np.int64)) for r in some]
        # |score| <= |anchor| * longest vector
        reach = np.array([int((float((v.astype(float) ** 2).sum()) * span["norm"]) ** 0.5) + 2 for _, _, v in sent], np.int64)
        every = np.arange(len(sent))
        near = _first(_select(rows, sent, Windows.of(every, -reach, reach, positives), True, positives, ids), positives).collect()
        near.sort(key=lambda r: (r.w, r.rank))
        of, p = np.array([r.w for r in near], np.int64), np.array([r.score for r in near], np.int64)
        w = Windows.of(of, -((-low * p) // 100), (high * p) // 100, negatives)
        far = _first(_select(rows, sent, w, False, negatives, ids), negatives)
        pairs = spark.createDataFrame([(i, some[r.w].vec_id, r.vec_id, r.score) for i, r in enumerate(near)], "w int, anchor_id long, positive_id long, positive_score long")
        # at most chunk * positives rows: a bounded table
        parts.append(stored(far.join(F.broadcast(pairs), "w").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    drop_stored(rows)
    out = spark.createDataFrame([], SCHEMA)
    for part in parts:
        out = out.union(part)
    return out
