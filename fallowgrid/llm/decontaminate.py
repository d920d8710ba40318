"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are compared folded: ASCII lower case, every run of other bytes than letters, digits and
non-ASCII one blank.  A document leaks an item if some window of WINDOW folded bytes of it (or the whole
item, where shorter) occurs in the document within `EDITS` of the window's length in edits.

1. A window of length L within e edits shares at least L - q + 1 - q*e of its q-grams with the document,
   all on diagonals (text place minus item place) within e of each other.  First, places with fewer q-grams
   of any item than the bound go.  2. The q-gram hits that remain are counted by item and overlapping
   diagonal bands (each of 2(e+1) diagonals, a new one every e+1), and by window; regions under the bound
   go.  The lemma holds for every q: within a region it is applied again with 3-grams, which tell
   a window that hangs over the end of an excerpt.  3. Windows with at most one other byte on some diagonal are decided; a banded
   alignment verifies the rest, windows at every place of the item: it is exact, so the filters
   only save work.

Items under LEAST folded bytes count only where they stand whole, with no edit, between word borders, and have
at least SHORT_WORDS words (less can't tell a leak from ordinary speech: such items match nothing).

The corpus is scanned once, without a shuffle.  Items go to the executors in parts of at most PART_BYTES:
a benchmark over that is dealt into more parts, each with a scan of its own whose result is stored before the
next part is read, so neither the broadcast nor the driver's memory grows with it.

Defined cases: null or empty texts and items match nothing, nor do items without an id; documents without an id
are reported with a null one; repeated rows are judged alike; equal items are all reported; empty tables
give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, IS_WORD, U64, Rolling, blocks, mix, ranges, stored

Q, WINDOW, LEAST, SHORT_WORDS = 10, 100, 50, 5
FINE = 3
HITS = 2_000_000
EDITS = 0.07
PART_BYTES = 8 << 20
TABLE_BITS = 22


def fold(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, offsets, and the place of each in `buf`; every text that isn't empty ends in a blank."""
    low = FOLD[buf]
    word = IS_WORD[low]
    keep = word.copy()
    keep[1:] |= word[:-1]
    # the last byte of a text stays, as its blank, unless it's a word's byte
    heads = off[:-1][np.diff(off) > 0]
    keep[heads] = word[heads]
    at = np.flatnonzero(keep)
    out = np.where(word[at], low[at], 32).astype(np.uint8)
    return out, np.searchsorted(at, off), at


class Patterns:
    """The q-grams of the items' windows, in hash order."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.texts = [], []
        for i, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            if len(raw):
                folded = fold(raw, np.array([0, len(raw)]))[0].tobytes().strip()
                if len(folded) >= (LEAST if folded.count(b" ") < SHORT_WORDS - 1 else Q):
                    self.ids.append(i)
                    self.texts.append(np.frombuffer(folded, np.uint8))
        grams, item, place = [], [], []
        for k, t in enumerate(self.texts):
            g = mix(Rolling(t).grams(Q))
            grams.append(g)
            item.append(np.full(len(g), k, np.int32))
            place.append(np.arange(len(g), dtype=np.int32))
        grams = np.concatenate(grams) if grams else np.empty(0, U64)
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.item = np.concatenate(item)[order] if item else np.empty(0, np.int32)
        self.place = np.concatenate(place)[order] if place else np.empty(0, np.int32)
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[self.grams >> U64(64 - TABLE_BITS)] = True
        self.least = min((bound(min(len(t), WINDOW)) for t in self.texts), default=1)
        self.wide = WINDOW + edits(WINDOW)


def edits(length: int) -> int:
    return int(EDITS * length) if length >= LEAST else 0


def bound(length: int) -> int:
    """q-grams that a window of this length shares at least; 1 where the lemma says nothing."""
    return max(1, length - Q + 1 - Q * edits(length))


def distance(patterns: np.ndarray, texts: np.ndarray, most: int, skew: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each row of `patterns` against any part of its row of `texts`, and where that part ends.

    Only cells with -most <= column - row <= skew + most count: the pattern starts within `skew` of the text's
    start.  Distances over `most` may come out larger.  A row of the table holds just these cells, by diagonal.
    """
    k, n = patterns.shape
    wide = skew + 2 * most + 1
    big = np.int16(1 << 13)
    side = np.arange(wide, dtype=np.int16)
    padded = np.full((k, most + max(texts.shape[1], n + skew + most)), -2, np.int16)
    padded[:, most : most + texts.shape[1]] = texts
    d = np.where(side < most, big, np.int16(0))[None, :].repeat(k, 0)
    for i in range(1, n + 1):
        step = d + (padded[:, i - 1 : i - 1 + wide] != patterns[:, i - 1 : i])
        np.minimum(step[:, :-1], d[:, 1:] + np.int16(1), out=step[:, :-1])
        if i < most:
            step[:, : most - i] = big
        step -= side
        d = np.minimum.accumulate(step, axis=1)
        d += side
    end = np.argmin(d, axis=1)
    return d[np.arange(k), end].astype(np.int64), n + end - most


def _matches(p: Patterns, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits): places are folded ones, starts within the allowed edits."""
    if len(buf) < Q or not len(p.grams):
        return
    grams = mix(Rolling(buf).grams(Q))
    hit = p.seen[grams >> U64(64 - TABLE_BITS)]
    doc_of_start = np.searchsorted(off, np.flatnonzero(hit), side="right") - 1
    places = np.flatnonzero(hit)
    fits = places + Q <= off[doc_of_start + 1]
    places, doc = places[fits], doc_of_start[fits]
    lo = np.searchsorted(p.grams, grams[places])
    hi = np.searchsorted(p.grams, grams[places], side="right")
    real = hi > lo
    places, doc, lo, hi = places[real], doc[real], lo[real], hi[real]
    if len(places) < p.least:
        return
    # 1: enough hits of any item around a place
    after = np.searchsorted(places, places + p.wide)
    before = np.searchsorted(places, places - p.wide)
    dense = np.maximum.reduce([after - np.arange(len(places)), np.arange(len(places)) - before + 1]) >= p.least
    # a place inside a dense window stays: spread the mark over the windows that start or end there
    cover = np.zeros(len(places) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(dense), 1)
    np.add.at(cover, after[dense], -1)
    back = np.zeros(len(places) + 1, np.int64)
    np.add.at(back, before[dense], 1)
    np.add.at(back, np.flatnonzero(dense) + 1, -1)
    stay = (np.cumsum(cover)[:-1] > 0) | (np.cumsum(back)[:-1] > 0)
    places, doc, lo, hi = places[stay], doc[stay], lo[stay], hi[stay]
    # 2: hits by text, item and band, a slice of the places at a time
    reps = hi - lo
    upto = np.concatenate([[0], np.cumsum(reps)])
    last = 0
    while last < len(places):
        end = max(last + 1, int(np.searchsorted(upto, upto[last] + HITS, side="right")) - 1)
        while end < len(places) and doc[end] == doc[end - 1]:  # whole texts
            end += 1
        # a text with more hits is worked on by groups of items
        groups = int((upto[end] - upto[last]) // (2 * HITS)) + 1
        for group in range(groups):
            yield from _bands(p, buf, off, *_hits(p, places[last:end], doc[last:end], lo[last:end], reps[last:end], group, groups))
        last = end


def _hits(p: Patterns, places: np.ndarray, doc: np.ndarray, lo: np.ndarray, reps: np.ndarray, group: int, groups: int) -> tuple[np.ndarray, ...]:
    """(text, item, place in the item, diagonal) of every pair of equal q-grams, of one group of items."""
    upto = np.concatenate([[0], np.cumsum(reps)])
    found, at = [], 0
    while at < len(places):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + HITS, side="right")) - 1)
        row = ranges(lo[at:end], reps[at:end])
        text, place = (np.repeat(x[at:end], reps[at:end]).astype(np.int64) for x in (doc, places))
        if groups > 1:
            some = p.item[row] % groups == group
            row, text, place = row[some], text[some], place[some]
        found.append((text, p.item[row].astype(np.int64), p.place[row].astype(np.int64), place - p.place[row]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bands(p, buf, off, text, item, t, diagonal):
    width = edits(WINDOW) + 1
    band = diagonal // width
    base = int(band.min(initial=0)) - 1
    span = int(band.max(initial=0)) - base + 2
    need = np.array([bound(min(len(x), WINDOW)) for x in p.texts], np.int64)
    code = (text * len(p.texts) + item) * span + (band - base)
    code = np.concatenate([code, code - 1])  # each hit is in two bands, which overlap
    t2 = np.concatenate([t, t])
    order = np.lexsort((t2, code))
    code, t2 = code[order], t2[order]
    heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
    sizes = np.diff(np.append(heads, len(code)))
    who = (code[heads] // span) % max(len(p.texts), 1)
    enough = sizes >= need[who]
    spans: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    waiting: dict[int, list[tuple]] = {}  # windows for the alignment, by their length

    def keep(doc_k: int, k: int, long: int, ends: np.ndarray, best: np.ndarray) -> None:
        a, b = off[doc_k], off[doc_k + 1]
        if len(p.texts[k]) < LEAST:  # whole words only; a text that isn't empty ends in a blank
            whole = (ends - long == a) | (buf[ends - long - 1] == 32)
            whole &= (ends == b) | (buf[np.minimum(ends, b - 1)] == 32)
            ends, best = ends[whole], best[whole]
        spans.setdefault((doc_k, k), []).extend(zip(np.maximum(a, ends - long - best).tolist(), np.minimum(b, ends).tolist(), best.tolist(), strict=True))

    def settle(long: int) -> None:
        own = waiting.pop(long)
        e = edits(long)
        best, end = distance(np.concatenate([x[4] for x in own]), np.concatenate([x[5] for x in own]), e, 2 * width + 2 * e)
        at = 0
        for doc_k, k, d0, starts, rows, _ in own:
            n, to = best[at : at + len(rows)], end[at : at + len(rows)]
            ok = np.flatnonzero(n <= e)
            if len(ok):
                keep(doc_k, k, long, d0 + starts[ok] + to[ok], n[ok])
            at += len(rows)

    for h, n, k in zip(heads[enough].tolist(), sizes[enough].tolist(), who[enough].tolist(), strict=True):
        c = int(code[h])
        doc_k = c // span // len(p.texts)
        own, pattern = np.unique(t2[h : h + n]), p.texts[k]
        long = min(len(pattern), WINDOW)
        starts = np.arange(len(pattern) - long + 1)
        shared = np.searchsorted(own, starts + long - Q, side="right") - np.searchsorted(own, starts)
        starts = starts[shared >= bound(long)]
        if not len(starts):
            continue
        e = edits(long)
        d0 = (c % span + base) * width - e
        skew = 2 * width + 2 * e
        a, b = int(off[doc_k]), int(off[doc_k + 1])
        first, last = int(starts[0]), int(starts[-1]) + long
        # the text around, from the lowest diagonal at the first window's start
        low, high = d0 - e + first, d0 + last + skew + e
        around = np.full(high - low, -1, np.int16)
        lo, hi = max(a, low), min(b, high)
        if lo >= hi:
            continue
        around[lo - low : hi - low] = buf[lo:hi]
        diagonals = skew + 2 * e + 1
        equal = np.lib.stride_tricks.sliding_window_view(around, diagonals)[: last - first] == pattern[first:last, None]
        fine = np.logical_and.reduce([equal[i : len(equal) - FINE + 1 + i] for i in range(FINE)]).any(axis=1)
        seen = np.concatenate([[0], np.cumsum(fine)])
        rel = starts - first
        starts = starts[seen[rel + long - FINE + 1] - seen[rel] >= long - FINE + 1 - FINE * e]
        if not len(starts):
            continue
        rel = starts - first
        unlike = np.concatenate([np.zeros((1, diagonals), np.int32), np.cumsum(~equal, axis=0, dtype=np.int32)])
        unlike = unlike[rel + long] - unlike[rel]
        side = np.argmin(unlike, axis=1)
        least = unlike[np.arange(len(side)), side]
        clear = least <= min(e, 1)
        if clear.any():
            keep(doc_k, k, long, d0 - e + starts[clear] + side[clear] + long, least[clear])
        starts = starts[~clear] if e else starts[:0]
        for some in np.array_split(starts, -(-len(starts) // 512)) if len(starts) else []:
            rows = np.lib.stride_tricks.sliding_window_view(around, long + skew + e)[some - first + e]
            waiting.setdefault(long, []).append((doc_k, k, d0, some, pattern[some[:, None] + np.arange(long)].astype(np.int16), rows))
            if sum(len(x[3]) for x in waiting[long]) >= 1024:
                settle(long)
    for long in list(waiting):
        settle(long)
    for (doc_k, k), own in spans.items():
        for span in merged(own):
            yield doc_k, k, *span


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, least edits) of overlapping spans together."""
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), min(n, out[-1][2]))
        else:
            out.append((a, b, n))
    return out


SCHEMA = "doc_id long, item_id long, start long, end long, edits int"


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) with the bytes [start, end) of the document around windows that match, overlapping ones together, and the least edits."""
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // PART_BYTES + 1
    docs = documents.select("doc_id", "text")
    spark = documents.sparkSession
    out = None
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        data = spark.sparkContext.broadcast([(r.item_id, r.text) for r in part])

        def run(batches: Iterator[pa.RecordBatch], data=data) -> Iterator[pa.RecordBatch]:
            p = Patterns(data.value)
            for batch, buf, off in blocks(batches):
                folded, at, source = fold(buf, off)
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], p.ids[k], int(source[a] - off[d]), int((source[b - 1] + 1) - off[d]), n) for d, k, a, b, n in _matches(p, folded, at)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.int32(),), strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])

        found = docs.mapInArrow(run, SCHEMA)
        if parts > 1:
            found = stored(found, "leaks")
            data.unpersist()
        out = found if out is None else out.union(found)
    return out
