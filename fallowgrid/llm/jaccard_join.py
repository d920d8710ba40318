"""N-gram Jaccard self-join by chosen paths.

Documents are sets of word 5-grams.  Texts with the same grams collapse to one representative.  In each of
RUNS independent runs a set walks down a tree: at each node a shared random function picks one of its
grams (a minimum under a random order), and sets that pick the same gram share the child.  Small buckets are
brute-forced, large ones split further by the next pick, up to DEPTH picks.  Two sets of similarity s meet
in a run with probability at least s^DEPTH, so all runs miss a pair with (1 - s^DEPTH)^RUNS at most; RUNS is
the least number of runs that reaches the target recall at the threshold.

Buckets only propose: within small ones, pairs of like sketches are linked (sketches hold a byte of each pick; at
the threshold fewer than NEAR of them are equal with a probability of about 1e-7, on top of the stated recall); the last large ones are linked
to their smallest member.  Connected proposals form candidate components, and these are joined exactly, in
square blocks of at most about BLOCK sets a side, so a component with a third of all rows is many tasks.
Blocks count links and keep a spanning forest; pairs are never emitted.

Result, one row per document: doc_id, class_id (smallest id of the documents that are connected by links),
n_links (other documents of similarity >= threshold, equal copies included), n_copies (documents with the
same grams, itself included) and n_grams.  `keep_one` keeps one document of each class.

Defined cases: null, empty or wordless texts have no grams, link to nothing and are classes of their own;
texts of 1 to 4 words have one gram, all their words; repeated rows are copies; rows are told apart by id and a
64-bit hash of the text, so rows with one id or without one are judged each by its own text; a class_id is null
only where no row of the class has an id; ties can't matter; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, components, drop_stored, grouped, mix, partitions, shingles, stored, word_hashes

THRESHOLD, RECALL, DEPTH, LEAF, BLOCK, WORDS = 0.8, 0.9999, 4, 48, 256, 5
NEAR = 0.55


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def _picks(grams: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The minimum of each text's grams under `count` random orders; texts without grams get zeros."""
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
    out = np.zeros((len(off) - 1, count), np.uint32)
    some = np.flatnonzero(np.diff(off) > 0)
    if len(some):
        for k, s in enumerate(seeds):
            out[some, k] = np.minimum.reduceat((grams ^ s) * (s | U64(1)), off[some]) >> U64(20)
    return out


def _sketch(count: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in blocks(batches):
            hashes, at, _, _ = word_hashes(buf, off)
            grams, g = shingles(hashes, at, words)
            some = np.flatnonzero(np.diff(g) > 0)
            a, b = np.zeros(len(off) - 1, U64), np.zeros(len(off) - 1, U64)
            if len(some):
                a[some], b[some] = np.add.reduceat(grams, g[some]), np.add.reduceat(mix(grams + U64(77)), g[some])
            picks = _picks(grams, g, count)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.diff(g)), pa.array([r.tobytes() for r in picks], pa.binary())], names=["doc_id", "th", "sa", "sb", "n_grams", "picks"])

    return run


def _first(runs: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            picks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, runs, depth)
            path = mix(picks[:, :, 0].astype(U64) | (np.arange(1, runs + 1, dtype=np.uint64)[None, :] << U64(44)))
            yield pa.RecordBatch.from_arrays([pa.array(path.ravel().view(np.int64)), pa.array(np.tile(np.arange(runs, dtype=np.int32), batch.num_rows)), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), runs)))], names=["path", "run", "id"])

    return run


def _next(runs: int, depth: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path, turn = batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy()
            picks = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(batch.num_rows, runs, depth)
            path = mix(path * U64(0x9FB21C651E98DF25) + picks[np.arange(len(turn)), turn, level].astype(U64) + U64(level))
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column(1), batch.column(2)], names=["path", "run", "id"])

    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """For each of n, the smallest index of its component under the edges a, b."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brute force of small buckets: spanning edges of the pairs with like sketches."""
    for batch in batches:
        out_a, out_b = [], []
        for member in batch.column(0).to_pylist():
            ids = [x["id"] for x in member]
            sketch = np.frombuffer(b"".join(x["sketch"] for x in member), np.uint8).reshape(len(ids), -1)
            i, j = np.triu_indices(len(ids), 1)
            like = (sketch[i] == sketch[j]).mean(1) >= NEAR
            for x, r in enumerate(_forest(len(ids), i[like], j[like])):
                if r != x:
                    out_a.append(ids[r])
                    out_b.append(ids[x])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _candidates(reps: DataFrame, runs: int, depth: int, leaf: int) -> DataFrame:
    """Edges (a, b) whose components hold every pair of sets that meet in some bucket with like sketches."""
    level = stored(reps.select("id", "picks").mapInArrow(_first(runs, depth), "path long, run int, id long"), "paths")
    edges, used = None, [level]
    for d in range(1, depth + 1):
        # stored, so that the join deals both sides anew and adaptive execution can split a path that many sets share
        counts = stored(level.groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1"), "counts")
        shared = stored(level.join(counts.hint("merge"), "path"), "shared")
        used += [counts, shared]
        small = shared.where(F.col("n") <= leaf).join(reps.select("id", "sketch"), "id").groupBy("path").agg(F.collect_list(F.struct("id", "sketch")).alias("m"))
        found = small.select("m").mapInArrow(_leaves, "a long, b long").distinct()
        large = shared.where(F.col("n") > leaf)
        if d == depth:
            found = found.union(large.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")))
        edges = found if edges is None else edges.union(found)
        if d == depth or large.isEmpty():
            break
        level = stored(large.select("path", "run", "id").join(reps.select("id", "picks"), "id").select("path", "run", "id", "picks").mapInArrow(_next(runs, depth, d), "path long, run int, id long"), "paths")
        used.append(level)
    edges = stored(edges, "proposals")
    for x in used:
        drop_stored(x)
    return edges


def _gram_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in blocks(batches):
            hashes, at, _, _ = word_hashes(buf, off)
            grams, g = shingles(hashes, at, words)
            sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(g, g[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("root", "nb", "block", "id", "n_copies")), pa.array(sets, pa.binary())], names=["root", "nb", "block", "id", "n_copies", "grams"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over slices of the shared grams."""
    n = len(sets)
    if n == 2:
        return np.array([[len(sets[0]), (k := len(np.intersect1d(*sets, assume_unique=True)))], [k, len(sets[1])]])
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    both = count > 1
    new = np.cumsum(both) - 1
    keep = both[column]
    column, owner = new[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n), np.int64)
    wide = 8192
    for a in range(0, int(both.sum()), wide):
        lo, hi = np.searchsorted(column, [a, a + wide])
        m = np.zeros((n, wide), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        out += (m @ m.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _join(threshold: float):
    top = round(threshold * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["root", "bi", "bj"]):
            ids, block, copies = (group.column(c).to_numpy() for c in ("id", "block", "n_copies"))
            ids, order = np.unique(ids, return_index=True)  # a text may come from several equal rows
            block, copies = block[order], copies[order]
            data = group.column("grams").to_pylist()
            sets = [np.frombuffer(data[i], U64) for i in order]
            bi, bj, nb = (group.column(c)[0].as_py() for c in ("bi", "bj", "nb"))
            inter = _overlaps(sets) if len(sets) > 1 else np.zeros((len(sets), len(sets)), np.int64)
            size = np.array([len(s) for s in sets], np.int64)
            union = size[:, None] + size[None, :] - inter
            linked = inter * 1_000_000 >= union * top
            np.fill_diagonal(linked, False)
            if bi != bj:
                linked &= block[:, None] != block[None, :]
            i, j = np.nonzero(np.triu(linked))
            root = _forest(len(ids), i, j)
            links = linked @ copies
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root]), pa.array(links.astype(np.int64)), pa.array(np.full(len(ids), nb > 1))], names=["id", "class_id", "links", "split"])

    return run


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _classes(documents: DataFrame, threshold: float, recall: float, words: int, depth: int, leaf: int, block: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(one row per document: doc_id, th, sa, sb, n_grams; one row per set: its class's first document, its links and copies; the stored tables these read)."""
    spark = documents.sparkSession
    runs = runs_needed(threshold, recall, depth)
    docs = documents.select("doc_id", "text", _text_key().alias("th"))
    sketches = stored(docs.mapInArrow(_sketch(runs * depth, words), "doc_id long, th long, sa long, sb long, n_grams long, picks binary"), "sketches")
    full = sketches.where("n_grams > 0")
    low = F.transform(F.sequence(F.lit(0), F.lit(runs * depth - 1)), lambda k: F.substring(F.col("picks"), k * 4 + 1, F.lit(1)))
    # the first row of a set: by id, rows without one last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))).alias("first")
    reps = full.groupBy("sa", "sb", "n_grams").agg(first, F.count("*").alias("n_copies"), F.first("picks").alias("picks"))
    # numbered once, as the stored table is written
    reps = stored(reps.select("*", F.monotonically_increasing_id().alias("id"), F.aggregate(low, F.lit(b""), lambda a, x: F.concat(a, x)).alias("sketch")), "reps")
    edges = _candidates(reps, runs, depth, leaf)
    proposals = components(edges)
    grouped_sets = stored(proposals.join(reps.select("id", "first", "n_copies"), "id"), "members")
    drop_stored(edges)
    sizes = grouped_sets.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    members = grouped_sets.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).alias("m")
    texts = docs.alias("t")
    repeated = full.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():  # equal rows: one of them is enough
        texts = docs.groupBy("doc_id", "th").agg(F.first("text").alias("text")).alias("t")
    # always a merge join: components are not bounded, so they are never broadcast
    same = F.col("t.doc_id").eqNullSafe(F.col("m.first.doc_id")) & (F.col("t.th") == F.col("m.first.th"))
    sets = members.hint("merge").join(texts, same).select("root", "nb", "block", "id", "n_copies", "text").mapInArrow(_gram_sets(words), "root long, nb int, block int, id long, n_copies long, grams binary")
    tasks = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    tasks = tasks.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    tasks = tasks.repartition(4 * partitions(spark), "root", "bi", "bj").sortWithinPartitions("root", "bi", "bj")
    joined = stored(tasks.select("root", "bi", "bj", "nb", "block", "id", "n_copies", "grams").mapInArrow(_join(threshold), "id long, class_id long, links long, split boolean"), "joined")
    apart = joined.where("split").where("id <> class_id").select(F.col("id").alias("a"), F.col("class_id").alias("b"))
    whole = joined.where("NOT split").select("id", "class_id", "links")
    if not apart.isEmpty():
        counted = joined.where("split").groupBy("id").agg(F.sum("links").alias("links"))
        whole = whole.union(counted.join(components(apart), "id", "left").select("id", F.coalesce("root", "id").alias("class_id"), "links"))
    linked = reps.select("sa", "sb", F.col("n_grams").alias("n"), "id", "first", "n_copies").join(whole, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    heads = linked.where("links > 0").groupBy("class_id").agg(F.min("first").alias("head"))
    linked = linked.join(heads, "class_id", "left")
    drop_stored(grouped_sets)
    classes = linked.select("sa", "sb", "n", F.coalesce("head", "first").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"), "n_copies")
    return sketches, classes, [sketches, reps, joined]


def _with_class(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    rows = sketches.select("doc_id", "th", "sa", "sb", "n_grams").alias("r")
    return rows.join(classes.alias("c"), (F.col("r.sa") == F.col("c.sa")) & (F.col("r.sb") == F.col("c.sb")) & (F.col("r.n_grams") == F.col("c.n")), "left")


def jaccard_classes(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, depth: int = DEPTH, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """See the module's docstring."""
    rows = _with_class(*_classes(documents, threshold, recall, words, depth, leaf, block)[:2])
    class_id = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    return rows.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.col("n_grams"))


def keep_one(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, depth: int = DEPTH, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """The first document of each class (by id, rows without one last), with all its columns; of equal rows one stays."""
    sketches, classes, used = _classes(documents, threshold, recall, words, depth, leaf, block)
    rows = _with_class(sketches, classes)
    later = F.col("head").isNotNull() & ~(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("th") == F.col("head.th")))
    gone = stored(rows.where(later).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct(), "gone")
    keyed = documents.withColumn("__th", _text_key())
    kept = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["gone_id"]) & (keyed["__th"] == gone["gone_th"]), "left_anti")
    repeated = stored(sketches.where("n_grams > 0").groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")), "repeated")
    for x in used:
        drop_stored(x)
    if not repeated.isEmpty():
        same = kept["doc_id"].eqNullSafe(repeated["gone_id"]) & (kept["__th"] == repeated["gone_th"])
        kept = kept.join(repeated, same, "left_anti").union(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__th"]))
    return kept.select(documents.columns)
