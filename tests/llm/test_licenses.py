"""License blocks against plain windows, long texts, whole license texts."""

import time
from collections import Counter

import numpy as np
import pytest

from fallowgrid.llm import license_scan
from fallowgrid.llm.license_texts import TEMPLATES, WHOLE


def plain_blocks(own, templates, threshold):
    """Every window by itself; runs of windows that meet."""
    out = []
    for name, text in templates.items():
        ws = license_scan.words(text.encode())
        target, span = set(ws), int(np.ceil(license_scan.SPAN * len(ws)))
        need = int(np.ceil(threshold * len(target) - 1e-9))
        run = []
        for e in range(len(own) + span):
            inside = [i for i in range(max(0, e - span + 1), min(e + 1, len(own))) if own[i] in target]
            n = len({own[i] for i in inside})
            if n >= need:
                run.append((inside[0], inside[-1] + 1, n))
            if (n < need or e == len(own) + span - 1) and run:
                out.append((name, run[0][0], run[-1][1], max(x[2] for x in run) / len(target)))
                run = []
    return out


def test_blocks_equal_plain_windows():
    r = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(40)]
    templates = {f"t{k}": " ".join(r.choice(vocab, int(r.integers(1, 12)))) for k in range(8)}
    for seed in range(150):
        r = np.random.default_rng(seed)
        own = [w.encode() for w in r.choice(vocab + ["x"] * 30, int(r.integers(0, 90)))]
        if seed % 3:
            for t in list(templates.values())[: seed % 4]:
                a = int(r.integers(0, len(own) + 1))
                own[a:a] = [w.encode() for w in t.split()]
        frequency = Counter({w.encode(): int(r.integers(0, 9)) for w in vocab})
        for threshold in (0.8, 0.5, 1.0):
            known = license_scan.Templates(frequency, templates, threshold)
            got = known.blocks(own, set(own))
            assert sorted(got) == sorted(plain_blocks(own, templates, threshold))


def test_the_positional_filter_removes():
    """Two frequent words shared, but the only prefix word stands last in the stretch's order: too few words can follow."""
    frequency = Counter({b"a": 1, b"b": 2, b"c": 3, b"d": 4, b"e": 5, b"p": 0, b"q": 0, b"r": 0})
    known = license_scan.Templates(frequency, {"t": "a b c d e", "other": "p q r"}, 0.8)
    ids = lambda ws: np.array(sorted(known.number[w] for w in ws))
    assert known.possible(0, ids([b"a", b"b", b"c", b"d"]))
    assert not known.possible(0, ids([b"p", b"q", b"r", b"b", b"c"]))  # five words, but at most two from b on
    assert not known.possible(0, ids([b"b", b"c", b"d"]))  # length


def test_a_long_text_of_notices_takes_linear_time(spark):
    line = "released under the mit license and licensed under the apache license version 2 0 plus gnu general public license words "
    known = license_scan.Templates({}, TEMPLATES, 0.8)
    took = []
    for n in (10_000, 85_000):  # 1.2 and 10 MB
        text = (line * n).encode()
        began = time.process_time()
        own = license_scan.words(text)
        joined = b" " + b" ".join(own) + b" "
        assert [len(license_scan._places(joined, p.encode())) for p in license_scan.PHRASES] == [n] * 3
        found = known.blocks(own, set(own))
        took.append(time.process_time() - began)
        assert {x[0] for x in found} >= {"mit-notice", "apache-notice"}
    assert took[1] < 10 and took[1] < 14 * took[0]


def test_whole_texts_are_found_with_their_places(spark):
    rows, filler = [], "uno dos tres cuatro cinco seis siete ocho nueve diez " * 40
    for i, (name, text) in enumerate(WHOLE.items()):
        rows.append((i, filler + text.replace("software", "program") + " " + filler + text))
    rows += [(None, filler), (50, None), (51, ""), (60, "mit license"), (60, "mit license")]
    got = license_scan.scan(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, labels string")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, name in enumerate(WHOLE):
        mine = [b for b in by_id[i].blocks if b.template == name]
        assert len(mine) == 2 and license_scan.label(name) in by_id[i].labels.split(",")
        words = license_scan.words(rows[i][1].encode())
        assert abs(mine[0].first - 400) <= 2 and mine[1].containment == 1.0 and mine[1].end == len(words)
    assert by_id[None].blocks == [] and by_id[50].n_words == 0 and [r.n_base for r in got if r.doc_id == 60] == [1, 1]


def test_templates_of_a_folder(tmp_path):
    (tmp_path / "own").write_text("all rights reversed by the makers")
    (tmp_path / "empty").write_text("")
    assert license_scan.from_folder(str(tmp_path)) == {"own": "all rights reversed by the makers"}
    with pytest.raises(ValueError):
        license_scan.from_folder(str(tmp_path), 10)
