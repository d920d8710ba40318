"""What the turns of the substring dedup hold at once, and what it and the Jaccard join leave behind."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa

from fallowgrid.llm import jaccard_join, substring_dedup
from fallowgrid.llm.common import shared_dir


def _left(spark, tag):
    return set(Path(shared_dir(spark).removeprefix("file://"), "fallowgrid").glob(f"{tag}-*"))


def _junk(spark):
    """Words repeated over and over: each pair of seeds stands at many places of every document."""
    dice, rows = random.Random(5), []
    for i in range(24):
        runs = [(w, dice.randint(8, 36)) for w in dice.sample(["an", "of", "reea", "ouly", "hean"], 3)]
        rows.append((i, " ".join(" ".join([w] * n) + f" end{i}x{k}" for k, (w, n) in enumerate(runs))))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_pairs_at_many_places_meet_as_one_row(spark, monkeypatch):
    counted, kept = {}, substring_dedup.stored

    def stored(df, tag):
        out = kept(df, tag)
        counted.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "stored", stored)
    substring_dedup.find_passages(_junk(spark)).collect()
    assert counted["met"]
    # one row per document and pair of seeds, and so at most FEW rows of each that is left in the first turn
    assert counted["met"][0] <= substring_dedup.FEW * counted["left"][0]
    assert counted["left"][0] <= counted["pairs"][0]


def test_meetings_are_all_places_some_rows_at_a_time(monkeypatch):
    dice = np.random.default_rng(3)
    rows = [[{"pd": int(dice.integers(9)), "gap": int(dice.integers(1, 9)), "places": dice.integers(0, 99, dice.integers(1, 6)).tolist(), "there": dice.integers(0, 99, dice.integers(1, 6)).tolist()} for _ in range(dice.integers(1, 5))] for _ in range(40)]
    kind = pa.list_(pa.struct([("pd", pa.int64()), ("gap", pa.int32()), ("places", pa.list_(pa.int32())), ("there", pa.list_(pa.int32()))]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.nulls(40, pa.binary()), pa.array(rows, kind)], names=["d", "packed", "m"])
    monkeypatch.setattr(substring_dedup, "MEETINGS", 50)
    parts = list(substring_dedup._met(batch, 3, 38))
    got = sorted(x for p in parts for x in zip(*(c.tolist() for c in p), strict=True))
    want = sorted((i - 3, p + s, m["pd"], q + s) for i in range(3, 38) for m in rows[i] for p in m["places"] for q in m["there"] for s in (0, m["gap"]))
    assert got == want
    assert len(parts) > 5
    assert all(len(p[0]) <= 100 or len(set(p[0].tolist())) == 1 for p in parts)


def test_lone_blocks_are_judged_as_one_by_one():
    dice = np.random.default_rng(4)
    for _ in range(20):
        n = 30
        sizes, others = dice.integers(12, 120, n), dice.integers(12, 120, 6)
        off, high = np.concatenate([[0], np.cumsum(sizes)]), np.cumsum(others)
        words, other, who = dice.integers(0, 2, off[-1]).astype(np.uint16), dice.integers(0, 2, high[-1]).astype(np.uint16), dice.integers(0, 6, n)
        low, high = (high - others)[who], high[who]
        reach = dice.integers(0, 5, n)
        x, y = dice.integers(0, sizes - 8), dice.integers(0, others[who] - 8)
        for least in (0.4, 0.8):
            got = substring_dedup._likely(words, off, other, low, high, x, y, reach, 40, least)
            want = [substring_dedup.promising(words[off[i] : off[i + 1]], other[low[i] : high[i]], int(x[i]), int(y[i]), 40, least, int(reach[i])) for i in range(n)]
            assert got.tolist() == want


def test_tables_that_nothing_reads_any_more_are_dropped(spark):
    docs = _junk(spark)
    tags = ("matched", "second", "left", "met", "pairs", "sketches", "reps", "members", "joined")
    before = {t: _left(spark, t) for t in tags}
    assert jaccard_join.keep_one(docs).count() == 24
    substring_dedup.find_passages(docs).collect()
    assert {t: _left(spark, t) - before[t] for t in tags} == dict.fromkeys(tags, set())
