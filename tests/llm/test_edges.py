"""Very long texts, clashing columns, rows without ids, repeated rows and empty tables through the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fallowgrid.llm import chat_format, decontaminate, jaccard_join, pu_classifier, quality_rules, warc

WORDS = ["".join(np.random.default_rng(k).choice(list("abcdefghijklmnop"), 7)) for k in range(3000)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


ITEM = prose(1, 60)
LONG = prose(2, 120_000) + " " + ITEM + " " + prose(3, 120_000)  # about 2 MB


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG), (2, LONG), (3, prose(4, 200)), (None, prose(4, 200)), (None, prose(4, 200)), (5, None), (6, ""), (6, "")]
    clash = "score double, kept boolean, labels string, n_words string, payload string, label string, d long, m string"
    return spark.createDataFrame([(i, t, "en", "s", 0.0, True, "x", "y", "p", "l", 1, "m") for i, t in rows], f"doc_id long, text string, lang string, source string, {clash}")


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(10, ITEM, "z"), (11, None, "z"), (12, prose(99, 60), "z")], "item_id long, text string, score string")
    assert sorted({(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}) == [(1, 10), (2, 10)]
    assert decontaminate.find_leaks(docs.where("false"), bench).count() == 0 and decontaminate.find_leaks(docs, bench.where("false")).count() == 0


def test_jaccard_classes(docs):
    rows = jaccard_join.jaccard_classes(docs.select("doc_id", "text", "score", "label", "d")).collect()
    assert len(rows) == 8
    assert jaccard_join.jaccard_classes(docs.where("false")).count() == 0


def test_quality_rules(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn(docs, labels)
    rows = quality_rules.apply_rules(docs.drop("n_words", "kept"), rules, ["doc_id", "label"]).collect()
    assert len(rows) == 8 and {r.n_words for r in rows if r.doc_id in (1, 2)} == {240_060}
    assert [r.kept for r in rows if r.doc_id in (5, 6)] == [False] * 3
    assert quality_rules.learn(docs.where("false"), labels).rules == [] and quality_rules.apply_rules(docs.where("false"), rules, ["doc_id"]).count() == 0


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    for table, marks in ((docs, labels), (docs.where("false"), labels), (docs, labels.where("false"))):
        net = pu_classifier.train(table, marks)
        rows = pu_classifier.score(docs, net).collect()
        assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
        alike = [r.score for r in rows if r.doc_id is None]
        assert alike[0] == alike[1]
    assert pu_classifier.score(docs.where("false"), net).count() == 0


def test_chats(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", LONG), (2, 0, None, None), (2, 0, None, None), (None, 0, "assistant", "a <| b"), (3, None, "assistant", "ok")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(df.select("conv_id", "turn", "role", "text"))).collect()}
    assert got[1].loss_chars == len(LONG) and got[1].n_turns == 2 and got[2].n_turns == 2 and got[None].loss_chars == 6 and got[3].loss_chars == 2


def test_archives(spark):
    rows = [(1, "u", LONG), (2, "u", LONG), (2, "u", LONG), (3, None, None), (4, "u", "")]
    pages = spark.createDataFrame([(*r, 1.5) for r in rows], "page_id long, url string, html string, size double")
    got = warc.decode_bundles(spark, warc.write_bundles(pages.select("page_id", "url", "html"))).collect()
    assert len(got) == 5 and {r.size for r in got if r.page_id in (1, 2)} == {len(LONG.encode())} and [r.size for r in got if r.page_id in (3, 4)] == [0, 0]
    assert {r.record_type for r in got if r.page_id == 1} == {"revisit"} and F is not None
