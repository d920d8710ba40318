"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from fallowgrid.llm import chat_format, decontaminate, jaccard_join, license_scan, pu_classifier, quality_rules, sentencepiece_codec, substring_dedup, suffix_dedup, warc
from fallowgrid.llm.queries import QUERIES

rng = np.random.default_rng(5)
VOCAB = ["".join(rng.choice(list("abcdefgé"), 5)) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCAB, n))


PASSAGE = prose(120, 900)
TEXTS = [(1, prose(200, 1)), (2, prose(80, 2) + " " + PASSAGE + " " + prose(50, 3)), (3, PASSAGE + " " + prose(90, 4)), (4, prose(200, 1)), (5, None), (6, ""), (7, "one two"), (8, prose(200, 1).replace(VOCAB[3], "zz")), (None, prose(60, 8)), (9, "x " * 3000), (9, "x " * 3000), (10, prose(30, 11) + "\n" + prose(30, 11))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_words string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_suffix_dedup(docs, none):
    data = [(t or "").encode() for _, t in TEXTS]
    seen = Counter(b[p : p + 400] for b in data for p in range(len(b) - 399))
    want = []
    for (i, _), b in zip(TEXTS, data, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        want.append((str(i), len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_of_rows_without_ids_and_of_long_texts(spark, monkeypatch):
    """Many rows share the null id or one id; texts over SLICE bytes (op1)."""
    monkeypatch.setattr(suffix_dedup, "SLICE", 1500)
    own = [prose(70 + k, 300 + k) for k in range(30)]
    texts = [*own, *(prose(400, 350) + " " + x for x in own[:3]), prose(2000, 351), prose(2000, 351)[3000:9000], None, ""]
    rows = [(None if k % 3 else 7, t) for k, t in enumerate(texts)]
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + 400] for b in data for p in range(len(b) - 399))
    want = Counter()
    for (i, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        want[i, len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()) == want


def test_multikey_order():
    keys = [rng.integers(0, 4, 500), rng.integers(0, 3, 500), rng.integers(0, 9, 500)]
    order = suffix_dedup.multikey_order(keys)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*keys, strict=True))


def test_substring_dedup(docs, none):
    got = {(r.doc_id, r.first_doc_id): r for r in substring_dedup.find_passages(docs).collect()}
    r = got[3, 2]
    assert (r.start_word, r.end_word, r.first_start_word, r.first_end_word) == (0, 120, 80, 200)
    assert (4, 1) in got and (8, 1) in got
    cut = {r.doc_id: r.text for r in substring_dedup.cut_passages(docs, substring_dedup.find_passages(docs)).collect()}
    assert cut[3] == prose(90, 4) and cut[1] == TEXTS[0][1] and cut[5] is None
    assert substring_dedup.find_passages(none).count() == 0


def test_chains_are_collinear_and_disjoint():
    x, y = np.array([0, 10, 20, 5, 25]), np.array([0, 10, 20, 300, 2])
    found = substring_dedup.chain(x, y)
    assert found[0] == [0, 1, 2]
    assert sorted(i for c in found for i in c) == [0, 1, 2, 3, 4]


def test_passages_between_many_edits_are_found(spark):
    """Copied stretches of a document that differs too often elsewhere for one chain over all of it."""
    words = prose(330, 77).split(" ")
    other = [w if 30 <= k < 95 or 180 <= k < 250 or k % 12 > 5 else f"x{k}" for k, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    got = substring_dedup.find_passages(df).collect()
    covered = {k for r in got for k in range(r.start_word, r.end_word)}
    assert set(range(30, 95)) | set(range(180, 250)) <= covered and len(covered) < 200
    assert all(r.identity >= 0.8 for r in got)


def exact_windows(texts, size=40):
    """Places of words in windows of `size` words that a smaller document has, by plain loops."""
    seen, out = {}, {}
    for i, text in sorted(texts):
        w = re.findall(r"[0-9a-zé]+", text.lower())
        for p in range(len(w) - size + 1):
            if seen.setdefault(tuple(w[p : p + size]), i) != i:
                out.setdefault(i, set()).update(range(p, p + size))
    return out


def spans_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_exact_windows_are_found_whatever_has_their_parts(spark):
    """Passages whose parts first stand in different documents, also of many rows (op2)."""
    a, b, c = prose(30, 61), prose(30, 62), prose(25, 63)
    texts = [(1, a), (2, b), (3, c + " " + prose(40, 64)), (10, a + " " + b), (11, a + " " + b), (12, prose(20, 65) + " " + b + " " + c), (13, b + " " + c + " " + a)]
    texts += [(20 + k, prose(7 * k, 70 + k) + " " + a + " " + b + " " + c) for k in range(30)]
    want = exact_windows(texts)
    got = spans_of(substring_dedup.find_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got[11] == set(range(60)) and all(want[i] <= got.get(i, set()) for i in want)


def edited_pairs(step, size, n, seed):
    """Passages of `size` words within own text, and copies with every `step`-th word replaced."""
    r, rows = np.random.default_rng(seed), []
    own = lambda k: [f"w{x}" for x in r.integers(0, 10**9, k)]
    for k in range(n):
        words = own(size)
        copy = [f"q{k}x{i}" if i % step == step - 1 else w for i, w in enumerate(words)]
        rows += [(2 * k, " ".join(own(50) + words + own(50))), (2 * k + 1, " ".join(own(30) + copy + own(30)))]
    return rows


@pytest.mark.parametrize(("step", "size"), [(6, 60), (8, 50), (8, 60)])
def test_edited_passages_are_found(spark, step, size):
    """Recall of passages with edits at even distances (op2)."""
    found = substring_dedup.find_passages(spark.createDataFrame(edited_pairs(step, size, 40, step), "doc_id long, text string"))
    got = {(r.doc_id, r.first_doc_id) for r in found.collect() if r.end_word - r.start_word >= 0.9 * size}
    assert len(got & {(2 * k + 1, 2 * k) for k in range(40)}) >= 38


def test_segments_are_maximal():
    def best(equal):  # all ranges by brute force: highest score, then the rest on both sides
        if not equal.any():
            return []
        score = {(i, j): np.where(equal[i:j], 1, -4).sum() for i in range(len(equal)) for j in range(i + 1, len(equal) + 1)}
        i, j = min(score, key=lambda r: (-score[r], r[1] - r[0], r))
        return [*best(equal[:i]), (i, j), *((i2 + j, j2 + j) for i2, j2 in best(equal[j:]))]

    for seed in range(20):
        equal = np.random.default_rng(seed).random(40) < 0.85
        assert substring_dedup.segments(equal, 0.8) == best(equal)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<|| <||| <|im_start|>é"), (1, 1, "assistant", None), (2, None, None, "x"), (None, 0, "a\nb", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert chat_format.read_back(bytes(got[1].formatted), got[1].turn_starts) == [("user", "hi <|im_end|>"), ("assistant", ""), ("assistant", "<|| <||| <|im_start|>é")]
    assert chat_format.parse(bytes(got[None].formatted)) == [("a\nb", "")]
    loss = "".join(chat_format.unescape(bytes(got[1].formatted)[a:b].decode()) for a, b in zip(got[1].loss_starts, got[1].loss_ends, strict=True))
    assert loss == "<|| <||| <|im_start|>é"
    assert chat_format.digests(chat_format.format_conversations(df.where("false"))).count() == 0


def test_sentencepiece_equals_library(docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    texts = [t or "" for _, t in TEXTS] + ["  a   b\n\n\tc é😀 日本語 \x01", "q" * 300, " "]
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Model.parse(open(sentencepiece_codec.MODEL, "rb").read()))
    data = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in data])])
    ids, at = codec.encode(np.frombuffer(b"".join(data), np.uint8), off)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == lib.encode(texts, num_threads=1)
    back, b_off = codec.decode(ids, at)
    assert [back[a:b].tobytes().decode() for a, b in zip(b_off, b_off[1:], strict=False)] == texts
    out = sentencepiece_codec.encode(docs)
    assert all(r.round_trip for r in out.collect())
    assert {r.text for r in sentencepiece_codec.decode(out).collect()} == {t or "" for _, t in TEXTS}
    assert sentencepiece_codec.encode(none).count() == 0


def test_unigram_viterbi_is_optimal():
    pieces = ["<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a"]
    scores = np.array([0, -2.0, -2.5, -3.0, -2.9, -4.1, -1.0, -2.2])
    model = sentencepiece_codec.Model(pieces, scores, np.array([2] + [1] * 7, np.int8), True, True)

    def best(w):
        table = {0: 0.0}
        for j in range(1, len(w) + 1):
            table[j] = max(table[i] + (scores[pieces.index(w[i:j])] if w[i:j] in pieces[1:] else -14.1 if j - i == 1 else -1e9) for i in range(max(0, j - 3), j))
        return table[len(w)]

    words = ["▁abab", "▁baab", "aabba", "abcab"]
    chars = np.array([ord(c) for w in words for c in w], np.uint32)
    ids, n = model.segment(chars, np.cumsum([len(w) for w in words]))
    for w, own in zip(words, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert sum(scores[i] if i else -14.1 for i in own) == pytest.approx(best(w))


def test_long_and_colliding_segments_equal_library(monkeypatch):
    """Windows over long segments, runs of equals, and two segments of one polynomial hash (op4)."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Model.parse(open(sentencepiece_codec.MODEL, "rb").read()))
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    r = np.random.default_rng(3)
    texts = ["a" * 3000, " " * 700, thue + " " + thue.translate(str.maketrans("ab", "ba")), *("".join(r.choice(list(a), n)) for a in ("abcdefghij", "the ofan", "aé漢字ཨ😀▁ ") for n in (1, 40, 257, 900, 2500))]
    data = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in data])])
    for size in (1 << 18, 100):
        monkeypatch.setattr(sentencepiece_codec, "SLICE", size)
        ids, at = codec.encode(np.frombuffer(b"".join(data), np.uint8), off)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == lib.encode(texts, num_threads=1)


def test_decontamination(spark, none):
    item = prose(30, 77)
    edited = item[:60] + "Q" + item[61:]
    rows = [(1, prose(50, 1) + " " + item.replace("a", "A").replace(" ", ", ") + " " + prose(50, 2)), (2, prose(90, 3)), (3, edited), (4, None), (5, ""), (6, item[:40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short"), (None, "x")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == {(1, 7), (3, 7)}
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0


def test_short_items_and_hot_grams(spark, monkeypatch):
    """Items under 50 bytes count whole, unedited and between words only; a text with many hits is worked on by groups of items (op5)."""
    monkeypatch.setattr(decontaminate, "HITS", 50)
    short = "one two three four five six"
    long = [prose(40, 600)[:30] + " " + prose(30, 600 + k % 2) for k in range(6)]
    rows = [(1, f"Say: {short.upper()}, yes"), (2, short), (3, "b" + short), (4, short[:-1] + "y"), (5, short + "x"), (6, f"{long[0]} {long[1]} {prose(20, 9)}"), (None, f"{prose(20, 10)} {long[0]}"), (6, long[1])]
    bench = [(10, short), (11, "one two three"), *((20 + k, t) for k, t in enumerate(long))]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, item_id int, edits string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect())
    want = Counter({(1, 10): 1, (2, 10): 1})
    for i, k in ((6, 0), (6, 1), (None, 0), (6, 1)):
        want.update({(i, 20 + k + 2 * j): 1 for j in range(3)})
    assert set(got) == set(want) and all(got[x] >= want[x] for x in want)


def nearest(window, text):
    """Least edits of `window` against any part of `text`, by a plain table."""
    row = np.zeros(len(text) + 1, int)
    cols, own = np.arange(len(text) + 1), np.frombuffer(text.encode(), np.uint8)
    for i, ch in enumerate(window.encode(), 1):
        step = np.concatenate([[i], np.minimum(row[:-1] + (own != ch), row[1:] + 1)])
        row = np.minimum.accumulate(step - cols) + cols
    return row.min()


def test_leaks_equal_windows_at_every_place(spark):
    """Excerpts that begin off any stride, with up to and over the allowed edits, against all windows (op5)."""
    item = " ".join(np.random.default_rng(8).choice([v.replace("é", "h") for v in VOCAB], 40))
    rows = []
    for k in range(40):
        r = np.random.default_rng(k)
        own, at = list(item[(a := 3 + 4 * (k % 20)) : a + 100 + k % 4]), r.choice(100, 3 + k % 7, replace=False)
        for i in at:
            own[i] = "z"
        rows.append((k, f"{'x' * 30} {''.join(own)} {'y' * 30}"))
    want = {i for i, t in rows if min(nearest(item[a : a + 100], t) for a in range(len(item) - 99)) <= 7}
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == want and 0 < len(want) < 40


def test_every_excerpt_of_an_item_is_reported(spark):
    """An item twice in a document, and two excerpts of it on different diagonals; a window may hang over by its 7 edits, thrice counted (op5)."""
    item, gap = prose(60, 78), prose(40, 79)
    rows = [(1, f"{item} {gap} {item}"), (2, f"{gap} {item[200:]} {gap} {item[:150]}"), (3, f"{item} {gap}")]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    size = lambda t: len(t.encode())
    want = {1: [(0, size(item)), (size(f"{item} {gap} "), size(rows[0][1]))], 2: [(size(gap) + 1, size(f"{gap} {item[200:]}")), (size(f"{gap} {item[200:]} {gap} "), size(rows[1][1]))], 3: [(0, size(item))]}
    for i, spans in want.items():
        own = sorted((r.start, r.end) for r in got if r.doc_id == i)
        assert len(own) == len(spans) and all(abs(a - c) <= 21 and abs(b - d) <= 21 for (a, b), (c, d) in zip(own, spans, strict=True))


def test_jaccard_classes(spark, docs, none):
    base = prose(300, 5).split()
    near = [(100 + k, " ".join(base[: 5 * k] + [f"w{k}"] + base[5 * k + 1 :])) for k in range(60)]
    rows = near + [(i, t) for i, t in TEXTS if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = [re.findall(r"[0-9a-zé]+", (t or "").lower()) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    linked = [[i != j and bool(a) and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = Counter((r.doc_id, r.n_links) for r in jaccard_join.jaccard_classes(df, leaf=8, block=16).collect())
    assert got == Counter((rows[i][0], sum(x)) for i, x in enumerate(linked))
    classes = {r.doc_id: r.class_id for r in jaccard_join.jaccard_classes(df, leaf=8, block=16).collect()}
    assert {classes[i] for i, _ in near} == {100}
    assert jaccard_join.jaccard_classes(none).count() == 0


def test_warc(spark):
    long = "é" * 800
    rows = [(1, "http://a", long), (2, None, long), (3, "u", None), (4, "u", "x"), (5, "u", "x"), (6, "u\r\nv", long + "y"), (None, "n", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_bundles(df)
    got = {r.page_id: r for r in warc.decode_bundles(spark, path).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
    assert all(got[i].record_type == "response" for i in (3, 4, 5, 6, None))
    for i, _, html in rows:
        assert got[i].digest == hashlib.sha1((html or "").encode()).hexdigest() and got[i].size == len((html or "").encode())
    some = warc.fetch(spark, path, spark.createDataFrame([(6,), (4,)], "page_id long")).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in some} == {(6, long + "y"), (4, "x")}
    assert warc.decode_bundles(spark, warc.write_bundles(df.where("false"))).count() == 0


def test_license_scan(spark, none):
    rows = [(1, "Foo.\nReleased under the MIT License. bar MIT LICENSE"), (2, None), (3, "gnu general public license"), (4, license_scan.TEMPLATES["bsd"].replace("source", "src")), (5, "a b c"), (6, "permission granted")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (2, 4, 7, "mit", "mit")
    assert (got[3].n_base, got[3].first_word, got[3].base_labels) == (1, 1, "gpl")
    assert got[4].labels == "bsd" and got[4].base_labels == "" and 0.8 <= got[4].score < 1
    assert (got[2].n_words, got[2].first_word, got[6].labels, got[5].score) == (0, None, "", 0.0)
    assert license_scan.scan(none).count() == 0


def test_license_join_loses_no_block():
    templates = {f"t{k}": prose(10, 500 + k) for k in range(6)}
    known = license_scan.Templates({}, templates, 0.8)
    for seed in range(200):
        r = np.random.default_rng(seed)
        own = [w.encode() for w in r.choice([w for t in templates.values() for w in t.split()][:25], 40)]
        want = {}
        for name, text in templates.items():
            target = set(license_scan.words(text.encode()))
            span = int(np.ceil(license_scan.SPAN * len(text.split())))
            best = max(len(target & set(own[i : i + span])) for i in range(len(own))) / len(target)
            if best >= 0.8 - 1e-9:
                want[name] = best
        got = {}
        for name, _, _, c in known.blocks(own, set(own)):
            got[name] = max(got.get(name, 0), c)
        assert got == pytest.approx(want)


def test_quality_statistics(docs, none):
    for r in quality_rules.text_statistics(docs.select("doc_id", "text"), keep=["doc_id", "text"]).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_quality_list_learns_a_threshold(docs, none):
    x = {f: rng.random(600) for f in quality_rules.FEATURES}
    rules = quality_rules.cover(x, x["symbol_ratio"] > 0.7).rules
    assert rules and rules[0].tests[0][:2] == ("symbol_ratio", ">=")
    assert quality_rules.apply_rules(none, quality_rules.DecisionList(rules), ["doc_id"]).count() == 0
    labels = none.selectExpr("doc_id", "1 AS quality")
    assert quality_rules.learn(docs, labels).rules == []


def test_classifier_on_held_out_rows(spark, none):
    got = QUERIES["op9_quality_classifier"](spark, "/root/testdata/sf0.1").where("held_out").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    seen = [(r.predicted, labels[r.doc_id]) for r in got if r.doc_id in labels]
    assert np.mean([a == b for a, b in seen]) > 0.97
    net = pu_classifier.fit(np.zeros((0, 9)), np.zeros((3, 9)))
    assert [r.score for r in pu_classifier.score(none.sparkSession.createDataFrame([(1, None)], "doc_id long, text string"), net).collect()] == [0.0]


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[0] == "doc_id" and out.count() == out.select("doc_id").distinct().count() > 0


def test_quality_stage_computes_statistics_once(spark):
    """The filter stays above the statistics: one window hash in the plan, not one for each mention (pipeline)."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    plan = pipeline.drop_low_quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1


def test_license_base_columns_equal_brute_force(spark):
    """Words, phrase places and base labels of whole texts (op8)."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op8_license_scan"](spark, "/root/testdata/sf0.001").collect()}
    for doc in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), doc.text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, name) for p, name in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[doc.doc_id]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({n for _, n in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_near_copies_by_row(spark):
    """Rows without ids, of one id, and equal rows: one of each class stays (op6, pipeline)."""
    a, b = prose(60, 401), prose(60, 402)
    rows = [(5, a), (None, a), (3, a + " end"), (7, b), (7, a), (7, b), (None, b), (None, None), (8, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(df).collect())
    assert got == Counter([(5, 3, 3), (None, 3, 3), (3, 3, 3), (7, 3, 3), (7, 7, 2), (7, 7, 2), (None, 7, 2), (None, None, 0), (8, 8, 0)])
    kept = Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(df).collect())
    assert kept == Counter([(3, a + " end"), (7, b), (None, None), (8, "")])
