"""Centroid clustering, hard negatives and language identification against brute force and held-out accuracy."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fallowgrid.llm import centroid_clustering, hard_negatives, language_id
from fallowgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
RELABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def lloyd(rows, k, rounds):
    """Plain rounds on (id, integer vector); (id, cluster, distance, digest)."""
    x = np.array([v for _, v in rows])
    h = [hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest() for i, _ in rows]
    c = [x[j].tolist() for j in sorted(range(len(rows)), key=lambda j: (h[j], x[j].tolist()))[:k]]
    for r in range(rounds + 1):
        d = ((x[:, None] - np.array(c)[None]) ** 2).sum(2)
        who = d.argmin(1)
        if r < rounds:
            c = [[int(s) // int((who == g).sum()) for s in x[who == g].sum(0)] if (who == g).any() else c[g] for g in range(len(c))]
    return [(i, int(w), int(d[j, w]), hashlib.sha256(",".join(map(str, c[w])).encode()).hexdigest()) for j, ((i, _), w) in enumerate(zip(rows, who, strict=True))]


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(9, 64))
    rows = [(int(i), (base[i % 9] + (i % 5) * 0.01).tolist()) for i in range(150)] + [(3, base[0].tolist()), (None, base[1].tolist()), (None, base[1].tolist())]
    odd = [(900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [1.0] * 63 + [float("nan")]), (904, [float("inf")] + [0.0] * 63), (905, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, cluster string").repartition(5)
    model = centroid_clustering.fit(df, k=7, rounds=4)
    got = centroid_clustering.assign(df, model).collect()
    want = lloyd([(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows], 7, 4)
    assert Counter((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == Counter(want)
    assert {r.inertia for r in got} == {sum(x[2] for x in want)}
    assert {(r.cluster, r.cluster_inertia) for r in got} == {(g, sum(x[2] for x in want if x[1] == g)) for g in {x[1] for x in want}}
    few = df.where("vec_id < 4")
    assert centroid_clustering.assign(few, centroid_clustering.fit(few)).count() == 5
    none = df.where("false")
    assert centroid_clustering.assign(none, centroid_clustering.fit(none)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroid_clustering.fit(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("scale", [3, 100, 90_000_000])
def test_nearest_takes_the_smallest_of_equal_centroids(scale):
    rng = np.random.default_rng(scale)
    x, c = rng.integers(-scale, scale, (300, 64)), rng.integers(-scale, scale, (40, 64))
    c[7], c[30], x[:90] = c[3], c[3], c[3]
    x[90:150, :20] = c[5, :20]
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    who, far = centroid_clustering.nearest(x, c, rng.permutation(64))
    assert (who == d.argmin(1)).all() and (far == d.min(1)).all()


def mined(rows):
    """Plain sorting of all scores."""
    rows = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, v) in enumerate(rows):
        if i is None or i % 50:
            continue
        scored = sorted(((-int(x @ v), 2**63 if j is None else j, n) for n, (j, _, x) in enumerate(rows) if len(x) == len(v) and n != a))
        for p in [s for s in scored if rows[s[2]][1] == lab][:5]:
            inside = [s for s in scored if rows[s[2]][1] != lab and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]]
            out += [(i, rows[p[2]][0], r, rows[s[2]][0], -p[0], -s[0]) for r, s in enumerate(inside[:3], 1)]
    return Counter(out)


def test_hard_negatives_equal_sorting(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 4))
    rows = [(i if i % 41 else None, int(rng.integers(0, 3)), (base[rng.integers(0, 6)] if i % 5 else rng.normal(size=4)).tolist()) for i in range(700)]
    rows += [(50, 1, base[0].tolist())] * 2 + [(2**62, 2, base[1].tolist()), (-100, 1, base[1].tolist()), (800, 1, [1.0, 2.0]), (801, 1, [1.0, 2.5]), (802, 2, [1.0, 1.5]), (850, 0, []), (851, None, [1.0] * 4), (900, 1, None), (950, 1, [1.0, None, 1.0, 1.0]), (1000, 1, [float("nan")] * 4)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, label int, embedding array<double>, score int").repartition(5)
    want = mined(rows)
    assert len(want) > 100
    for chunk, gather in ((7, 3), (8192, 32)):
        monkeypatch.setattr(hard_negatives, "GATHER", gather)
        got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, relabel=F.expr(RELABEL), chunk=chunk)
        assert Counter(tuple(r) for r in got.collect()) == want
    assert hard_negatives.mine(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_a_third_of_equal_vectors(spark, monkeypatch):
    """Equal scores by the hundred: the digits of the ids decide."""
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    rows = [(i, i % 2, [1.0, 0.5] if i % 3 else [0.1 * (i % 17), 0.7]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert Counter(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0, relabel=F.expr(RELABEL)).collect()) == mined(rows)


def test_vector_queries_equal_sql(spark):
    import duckdb

    from fallowgrid.llm.queries import ORACLE

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS FROM read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    for name in ("op11_centroid_clustering", "op12_hard_negatives"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        want = con.execute(ORACLE[name])
        order = [[c[0] for c in want.description].index(c) for c in df.columns]
        assert Counter(tuple(r) for r in df.collect()) == Counter(tuple(r[i] for i in order) for r in want.fetchall())


def test_language_filter_and_masks():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    member = rng.random((3000, 11)) < 0.2
    f = language_id.Filter.build([f"l{i:02}" for i in range(11)], keys, member, np.ones(11), np.ones(11))
    seen = np.unpackbits(f.masks(keys), axis=1, bitorder="little")[:, :11].astype(bool)
    assert (seen | ~member).all()  # nothing that was put in is missed
    other = np.unpackbits(f.masks(rng.integers(0, 2**63, 200_000).astype(np.uint64)), axis=1, bitorder="little")[:, :11]
    assert np.abs(other.mean(0) - f.false).max() < 0.002  # the corrected share


def test_grams_of_words():
    letters = language_id.letters()

    def found(texts, piece):
        import pyarrow as pa

        out = Counter()
        for a, b, codes, number in language_id._pieces(pa.array(texts, pa.string()), piece):
            for n, h, of in language_id.grams(codes, number, b - a, letters):
                out.update((n, int(x), int(t)) for x, t in zip(h, of, strict=True))
        return out

    texts = ["Ab cdé, x", None, "", "ab  ab", "é" * 50, "1 2 3"]
    sizes = {k: sum(v for (n, _, t), v in found(texts, 1 << 17).items() if n == k) for k in language_id.SIZES}
    words = [w for t in texts if t for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
    assert sizes == {n: sum(max(len(w) + 2 - n + 1, 0) for w in words) for n in language_id.SIZES}
    assert found(texts, 7) == found(texts, 1 << 17)  # texts cut into pieces lose nothing
    assert {h for n, h, t in found(texts, 99) if t == 3} <= {h for n, h, t in found(["AB"], 99)}


def test_language_id_of_odd_rows(spark):
    texts = [("de", "der Hund und die Katze"), ("en", "the dog and the cat"), ("de", "und der Baum und das Haus"), (None, "the tree and the house"), ("en", None), ("en", "the house and the tree")]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts)] + [(None, "und der Hund", "de"), (7, "Und die Katze", "xx"), (8, "", "en"), (9, "12 + 3", "en"), (10, "ω", "en"), (11, "the cat " * 40_000, "en"), (11, "the cat " * 40_000, "en")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    model = language_id.learn(df.where("lang <> 'xx'"))
    got = Counter((r.doc_id, r.lang_pred) for r in language_id.predict(df, model).collect())
    assert got == Counter({(0, "de"): 1, (1, "en"): 1, (2, "de"): 1, (3, "en"): 1, (4, "und"): 1, (5, "en"): 1, (None, "de"): 1, (7, "de"): 1, (8, "und"): 1, (9, "und"): 1, (10, "en"): 1, (11, "en"): 2})
    none = df.where("false")
    assert language_id.predict(none, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(df, language_id.learn(none)).collect()} == {"und"}


def test_language_id_counts_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "HELD", 50)
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").select("lang", "text")
    got = {(r.lang, r["size"]): r.n for r in language_id.counts(df).groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    want = Counter()
    for r in df.collect():
        for w in "".join(c if c.isalpha() else " " for c in r.text.lower()).split():
            for n in language_id.SIZES:
                want[r.lang, n] += max(len(w) + 3 - n, 0)
    assert got == {k: v for k, v in want.items() if v}


def test_language_id_accuracy_on_held_out_rows(spark):
    rows = QUERIES["op13_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 150 and sum(r.lang == r.lang_pred for r in unseen) >= 0.99 * len(unseen)
