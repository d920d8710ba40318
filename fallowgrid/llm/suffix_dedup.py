"""Suffix-array dedup: remove every byte covered by a string of LENGTH bytes that also starts elsewhere.

A sparse suffix array over anchors.  The anchor of a start p is the place of the least ANCHOR-gram hash
within [p, p + LENGTH): equal strings have their anchors at equal offsets.  Neighbouring starts share an
anchor, about 1 anchor per (LENGTH - ANCHOR) / 2 bytes, so suffixes are sorted by anchor, not by byte.
A suffix's sort key is a string of tokens, each a fingerprint of bytes around its anchor:

  level 1, per anchor:  (anchor gram; all bytes of the anchor's starts)
  level 2, per CHUNK starts of an anchor that level 1 left open: (bytes common to the chunk's strings; all its bytes)
  level 3, per start that level 2 left open: (the LENGTH bytes)

At each level sampled splitters range-partition the suffixes by leading tokens (equal ones by document and
place, so hot groups are split too), and buckets sort locally by multikey quicksort: by the first token,
then only runs of equals by the next.  A suffix whose last token equals its neighbour's is repeated; one
whose first token is alone is unique; the rest is open and goes down a level, with one witness of each
repeated group that shares their first token.  At a bucket's boundary an
unmatched suffix stays open, and on the last level the tokens at boundaries are compared across buckets.

Tokens are 64-bit polynomial fingerprints; level 1 and 2 matches also need equal leading tokens (128 bits).

Defined cases: null text is empty; texts under LENGTH bytes keep all bytes; rows are told apart by
doc_id and a 64-bit hash of the text (128 bits without an id), so null and repeated ids are fine and equal rows
repeat each other; a text over SLICE bytes is searched in slices that overlap; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, blocks, drop_stored, mix, partitions, stored, text_bytes, window_min

LENGTH, ANCHOR, CHUNK = 400, 128, 16
PLACE_BITS = U64(24)
#: A longer text is searched in slices of this size, which overlap by a window.
SLICE = 1 << 22


def _anchors(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """For each run of starts with one anchor: (text, anchor, first start, last start, gram token, token of all bytes)."""
    if len(buf) < length:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, np.empty(0, U64), np.empty(0, U64)
    roll = Rolling(buf)
    g = mix(roll.grams(gram))
    mask = (U64(1) << PLACE_BITS) - U64(1)
    least = window_min((g & ~mask) | np.arange(len(g), dtype=np.uint64), length - gram + 1)
    p = np.arange(len(least))
    text = np.searchsorted(off, p, side="right") - 1
    ok = p + length <= off[text + 1]
    p, text, anchor = p[ok], text[ok], (least[ok] & mask).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    cut = np.flatnonzero(new)
    lo, hi = p[cut], p[np.append(cut[1:], len(p)) - 1] if len(p) else p[cut]
    a = anchor[cut]
    # the second token also holds where the starts lie around the anchor
    whole = mix(roll.of(lo, hi + length) + ((a - lo).astype(U64) << U64(40)) + (hi - lo).astype(U64))
    return text[cut], a, lo, hi, g[a], whole


def _pieces(batches: Iterator[pa.RecordBatch], length: int):
    """Blocks of texts; a text over SLICE comes in overlapping slices, with the place where each begins."""
    for batch, buf, off in blocks(batches):
        if len(off) == 2 and off[1] > SLICE:
            for at in range(0, int(off[1]) - length + 1, SLICE - length + 1):
                part = buf[at : at + SLICE]
                yield batch, part, np.array([0, len(part)]), at
        else:
            yield batch, buf, off, 0


L1 = "t0 long, t1 long, d long, th long, anchor int, lo int, hi int"


def _level1(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off, base in _pieces(batches, length):
            text, a, lo, hi, t0, t1 = _anchors(buf, off, length, gram)
            rel = base - off[text]
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t0.view(np.int64)), pa.array(t1.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), *(pa.array((x + rel).astype(np.int32)) for x in (a, lo, hi))],
                names=["t0", "t1", "d", "th", "anchor", "lo", "hi"],
            )

    return run


L2 = "t0 long, t1 long, d long, th long, lo int, hi int, tokens binary"


def _level2(length: int):
    """Chunks of the open anchors' starts, with the tokens of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                d, th = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                buf = np.frombuffer(unpack.decompress(batch.column(2)[i].as_buffer()), np.uint8)
                spots = batch.column(3)[i].values.flatten()
                roll = Rolling(buf)
                for a, lo, hi, g in zip(*(x.to_numpy() for x in spots), strict=True):
                    own = mix(roll.of(np.arange(lo, hi + 1), np.arange(lo, hi + 1) + length))
                    first, last = (int(a) - int(hi)) // CHUNK, (int(a) - int(lo)) // CHUNK
                    for b in range(first, last + 1):
                        p1, p2 = max(int(lo), int(a) - CHUNK * b - CHUNK + 1), min(int(hi), int(a) - CHUNK * b)
                        core = int(a) - CHUNK * b
                        out.append((core, core + length - CHUNK + 1, p1, p2, b, int(g), d, th, own[p1 - lo : p2 - lo + 1].tobytes(), roll))
            if not out:
                continue
            core = np.array([int(r.of(np.array([x]), np.array([y]))[0]) for x, y, *_, r in out], U64)
            whole = np.array([int(r.of(np.array([p]), np.array([q + length]))[0]) for _, _, p, q, *_, r in out], U64)
            b, g = np.array([x[4] for x in out], np.int64), np.array([x[5] for x in out], np.int64).view(U64)
            lo, hi, c = (np.array([x[k] for x in out], np.int64) for k in (2, 3, 0))
            t0 = mix(mix(core + b.astype(U64)) + g)
            t1 = mix(whole + ((c - lo).astype(U64) << U64(40)) + ((hi - lo).astype(U64) << U64(20)) + mix(t0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(t0.view(np.int64)), pa.array(t1.view(np.int64)), pa.array([x[6] for x in out], pa.int64()), pa.array([x[7] for x in out], pa.int64()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array([x[8] for x in out], pa.binary())],
                names=["t0", "t1", "d", "th", "lo", "hi", "tokens"],
            )

    return run


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order of the rows by keys[0], then keys[1], ..: only rows that are still tied are sorted by the next key."""
    order = np.argsort(keys[0], kind="stable")
    for depth in range(1, len(keys)):
        sorted_by = [k[order] for k in keys[:depth]]
        same = np.logical_and.reduce([k[1:] == k[:-1] for k in sorted_by])
        tied = np.zeros(len(order), bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(~np.concatenate([[False], same]))[at]
        rest = order[at]
        order[at] = rest[np.lexsort((keys[depth][rest], group))]
    return order


def _runs(sorted_keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's run of equal keys, and the size of every run."""
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])]) if len(sorted_keys[0]) else np.empty(0, bool)
    run = np.cumsum(new) - 1
    return run, np.bincount(run) if len(run) else np.empty(0, np.int64)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _judge(columns: list[str]):
    """Of a bucket's rows sorted by (t0, t1): state 1 repeated, 0 open; unique ones go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _whole(batches)
        if rows is None:
            return
        t0, t1 = rows.column("t0").to_numpy(), rows.column("t1").to_numpy()
        order = multikey_order([t0, t1])
        lead, n_lead = _runs([t0[order]])
        both, n_both = _runs([t0[order], t1[order]])
        repeated = n_both[both] > 1
        # the first and the last group may go on in the neighbouring buckets
        edge = (lead == 0) | (lead == lead[-1])
        keep = repeated | (n_lead[lead] > 1) | edge
        # of a repeated group beside others with its first token, one member also goes down, for them to meet
        first = np.concatenate([[True], both[1:] != both[:-1]])
        witness = repeated & first & ((n_lead[lead] > n_both[both]) | edge)
        at = np.concatenate([order[keep], order[witness]])
        state = np.concatenate([repeated[keep], np.zeros(int(witness.sum()), bool)]).astype(np.int8)
        yield from rows.take(pa.array(at)).select(columns).append_column("state", pa.array(state)).to_batches()

    return run


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level 3: state 1 repeated, 0 unmatched at a boundary, 2 witness of a boundary token; all with their token."""
    rows = _whole(batches)
    if rows is None:
        return
    t = rows.column("t0").to_numpy()
    order = multikey_order([t])
    run, size = _runs([t[order]])
    repeated = size[run] > 1
    edge = (run == 0) | (run == run[-1])
    state = np.where(repeated, 1, 0).astype(np.int8)
    keep = repeated | edge
    part = np.int32(TaskContext.get().partitionId())
    got = rows.take(pa.array(order[keep])).append_column("state", pa.array(state[keep])).append_column("part", pa.array(np.full(int(keep.sum()), part)))
    yield from got.to_batches()
    ends = np.unique(t[order][[0, -1]])
    n = len(ends)
    none = lambda k: pa.nulls(n, k)
    yield pa.RecordBatch.from_arrays([pa.array(ends), none(pa.int64()), none(pa.int64()), none(pa.int32()), pa.array(np.full(n, 2, np.int8)), pa.array(np.full(n, part))], names=["t0", "d", "th", "lo", "state", "part"])


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens, off = text_bytes(batch.column(3))
        n = np.diff(off) // 8
        row = np.repeat(np.arange(batch.num_rows), n)
        lo = batch.column(2).to_numpy()[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(tokens.tobytes(), np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(lo.astype(np.int32))], names=["t0", "d", "th", "lo"])


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = ANCHOR) -> DataFrame:
    """(d, th, spans): by document key, the places [lo, hi) of strings that occur elsewhere; they may overlap."""
    spark = documents.sparkSession
    n = 2 * partitions(spark)
    keyed = _keyed(documents).where(F.octet_length("text") >= length)
    first = stored(keyed.select("d", "th", "text").mapInArrow(_level1(length, gram), L1), "suffixes")
    judged = first.repartitionByRange(n, "t0", "t1", "d", "lo").mapInArrow(_judge(["t0", "d", "th", "anchor", "lo", "hi"]), "t0 long, d long, th long, anchor int, lo int, hi int, state byte")
    judged = stored(judged, "judged")
    drop_stored(first)
    done = judged.where("state = 1").select("d", "th", "lo", (F.col("hi") + length).alias("hi"))
    # open anchors of a document: at most one per start, so a list is bounded by its document
    spots = judged.where("state = 0").groupBy("d", "th").agg(F.collect_list(F.struct("anchor", "lo", "hi", "t0")).alias("spots"))
    chunks = _packed(keyed).join(spots, ["d", "th"]).select("d", "th", "packed", "spots").mapInArrow(_level2(length), L2)
    second = stored(chunks.repartitionByRange(n, "t0", "t1", "d", "lo").mapInArrow(_judge(["d", "th", "lo", "hi", "tokens"]), "d long, th long, lo int, hi int, tokens binary, state byte"), "chunks")
    done = done.union(second.where("state = 1").select("d", "th", "lo", (F.col("hi") + length).alias("hi")))
    starts = second.where("state = 0").select("d", "th", "lo", "tokens").mapInArrow(_explode, "t0 long, d long, th long, lo int")
    third = stored(starts.repartitionByRange(n, "t0", "d", "th", "lo").mapInArrow(_last, "t0 long, d long, th long, lo int, state byte, part int"), "starts")
    across = third.where("state = 2").groupBy("t0").agg(F.countDistinct("part").alias("parts")).where("parts > 1").select("t0")
    matched = third.where("state = 1").union(third.where("state = 0").join(across, "t0", "left_semi").select(third.columns))
    done = done.union(matched.select("d", "th", "lo", (F.col("lo") + length).alias("hi")))
    return done.groupBy("d", "th").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def _keyed(documents: DataFrame) -> DataFrame:
    """Rows with the key (d, th) of their id and text: two hashes of the text where the id is null."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("d"), F.xxhash64(F.lit("th"), text).alias("th"))


def _packed(keyed: DataFrame) -> DataFrame:
    """Texts as Zstandard frames: about half of what the shuffle's own compression leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack.compress(t.as_buffer()) for t in batch.column(3)], pa.binary())], names=["doc_id", "d", "th", "packed"])

    return keyed.select("doc_id", "d", "th", "text").mapInArrow(run, "doc_id long, d long, th long, packed binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for packed, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = unpack.decompress(packed.as_buffer())
            kept, runs, at = [], [], 0
            if spans.is_valid:
                for lo, hi in zip(*(x.to_pylist() for x in spans.values.flatten()), strict=True):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
            for lo, hi in runs:
                kept.append(data[at:lo])
                at = hi
            kept.append(data[at:])
            rows.append((len(data), sum(b - a for a, b in runs), len(runs), [x for x, _ in runs], [y for _, y in runs], b"".join(kept)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept"])


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = ANCHOR) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, the removed runs' starts and ends, and the kept bytes."""
    spans = repeated_spans(documents, length, gram)
    rows = _packed(_keyed(documents)).join(spans, ["d", "th"], "left").select("doc_id", "packed", "spans")
    return rows.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary")
