"""Quality rules: learned decision lists over text statistics, in DataFrame functions only.

`text_statistics` derives per-text figures with built-in functions; `learn` grows and prunes threshold
conjunctions by sequential covering on the statistics of a bounded, hash-ordered sample of labelled rows;
`DecisionList.rejects` emits the ordered CASE expression.  The corpus is only ever scanned, never shuffled.

Defined cases: a null or empty text has no words (every figure 0, ratios 0.0); repeated rows are judged
alike, one result row each; rows without an id are judged and never learned from; of rows with one id the one
with the least statistics is learned from; an empty table gives an empty result; an empty label table gives a list
without rules (the base rules still hold); extra columns are carried by `apply_rules` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a list is learned from, at most: the ones with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
BLANKS = " \t\n\x0b\x0c\r"
FEATURES = ("n_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "stop_ratio", "distinct_ratio", "bang_ratio", "line_words")


def _count(text: Column, marks: str) -> Column:
    """How often the given ASCII characters occur: replacing one fixed character is a byte search."""
    rest = text
    for c in marks:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def _words(text: Column) -> Column:
    """Maximal runs of other characters than blanks; a split at one fixed character needs no regular expression."""
    for c in BLANKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def text_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, the exact counts, and the ratios in FEATURES (prefixed f_)."""
    keep = keep or []
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    df = df.select(
        *keep,
        _words(t).alias("__w"), lines.alias("__l"),
        _count(t, "#*$%&|<>").alias("n_symbols"), _count(t, ".").alias("__stop"), _count(t, "!").alias("__bang"),
    )
    n = F.size("__w")
    # windows of three words, sorted by hash: equal ones become neighbours
    window = F.transform(
        F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", 2, F.greatest(n - 1, F.lit(0))).alias("b"), F.slice("__w", 3, F.greatest(n - 2, F.lit(0))).alias("c")),
        lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")),
    )
    df = df.select(
        *keep, "n_symbols", "__stop", "__bang", F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        n.cast("long").alias("n_words"), F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct_words"),
        F.sort_array(F.slice(window, 1, F.greatest(n - 2, F.lit(0)))).alias("__s"),
    )
    m = F.size("__s")
    near = F.arrays_zip(F.col("__s").alias("x"), F.slice("__s", 2, F.greatest(m - 1, F.lit(0))).alias("y"))
    # in sorted order, a window equal to the next marks itself and the next; positions may come twice
    hit = F.filter(near, lambda p: p["x"]["h"] == p["y"]["h"])
    df = df.withColumn("__p", F.sort_array(F.array_distinct(F.flatten(F.transform(hit, lambda p: F.array(p["x"]["i"], p["y"]["i"]))))))
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    df = df.withColumn("n_repeat_words", F.when(F.size("__p") == 0, F.lit(0).cast("long")).otherwise(covered))
    n = F.greatest(F.col("n_words"), F.lit(1))
    ratios = {
        "n_words": F.col("n_words"), "word_length": F.col("word_chars") / n, "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_ratio": F.col("n_repeat_words") / n,
        "stop_ratio": F.col("__stop") / n,
        "distinct_ratio": F.col("n_distinct_words") / n, "bang_ratio": F.col("__bang") / n, "line_words": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[x.cast("double").alias(f"f_{k}") for k, x in ratios.items()])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, ">=" or "<=", threshold), with its support on the pruning rows."""

    tests: tuple[tuple[str, str, float], ...]
    covered: int = 0
    precision: float = 0.0

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([x[f] >= v if op == ">=" else x[f] <= v for f, op, v in self.tests])

    def column(self) -> Column:
        out = None
        for f, op, v in self.tests:
            test = F.col(f"f_{f}") >= F.lit(v) if op == ">=" else F.col(f"f_{f}") <= F.lit(v)
            out = test if out is None else out & test
        return out


@dataclass(frozen=True)
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def rejects(self) -> Column:
        """True where the first rule that holds rejects; the default accepts."""
        out = F.lit(False)
        for rule in reversed(self.rules):
            out = F.when(rule.column(), F.lit(True)).otherwise(out)
        return out

    def fired(self) -> Column:
        """Number of the first rule that holds, from 1; null if none does."""
        out = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(rule.column(), F.lit(k)).otherwise(out)
        return out


def cover(x: dict[str, np.ndarray], bad: np.ndarray, *, most_rules: int = 16, most_tests: int = 3, least: int = 8, precision: float = 0.95, cuts: int = 48) -> DecisionList:
    """Sequential covering: grow by information gain on two rows of three, prune on the third, drop what is covered.

    A rule is kept if, on the pruning rows, it covers something and at least `precision` of that is bad.
    """
    n = len(bad)
    third = np.arange(n) % 3 == 2
    left = np.ones(n, bool)
    rules: list[Rule] = []
    edges = {f: np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1))) for f, v in x.items()} if n else {}
    # midpoints between neighbouring quantiles, so that a rule doesn't hang on one row's exact figure
    edges = {f: np.unique(np.concatenate([(v[1:] + v[:-1]) / 2, v[1:-1]])) if len(v) > 1 else v for f, v in edges.items()}
    while len(rules) < most_rules:
        grow, tests = left & ~third, []
        inside = grow.copy()
        while len(tests) < most_tests and inside.any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            if p0 < least or not n0:
                break
            best = (0.0, None)
            base = np.log2(p0 / (p0 + n0))
            for f, cut in edges.items():
                v, b = x[f][inside], bad[inside]
                order = np.argsort(v, kind="stable")
                v, good = v[order], np.concatenate([[0], np.cumsum(b[order])])
                lo, hi = np.searchsorted(v, cut, "left"), np.searchsorted(v, cut, "right")
                for op, pos, tot in ((">=", good[-1] - good[lo], len(v) - lo), ("<=", good[hi], hi)):
                    gain = np.where((pos >= least) & (tot > 0), pos * (np.log2(np.maximum(pos, 1) / np.maximum(tot, 1)) - base), 0.0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), (f, op, float(cut[k])))
            if best[1] is None:
                break
            tests.append(best[1])
            inside &= Rule((best[1],)).mask(x)
        if not tests:
            break
        prune = left & third

        def worth(some: tuple) -> float:
            m = Rule(some).mask(x) & prune
            return ((m & bad).sum() - (m & ~bad).sum()) / max(m.sum(), 1)

        kept = tuple(tests)
        while len(kept) > 1 and worth(kept[:-1]) >= worth(kept):
            kept = kept[:-1]
        m = Rule(kept).mask(x)
        seen = m & prune
        share = (seen & bad).sum() / max(seen.sum(), 1)
        if not seen.any() or share < precision:
            break
        rules.append(Rule(kept, int(seen.sum()), float(share)))
        left &= ~m
    return DecisionList(rules)


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **how) -> DecisionList:
    """Learn from the labelled rows with the smallest (hash, id); `sample_rows` bounds what reaches the driver."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_q"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = text_statistics(documents.select("doc_id", "text").join(F.broadcast(rows), "doc_id"), keep=["doc_id", "_q"])
    # of rows with one id the one with the least statistics: at most one per labelled id
    got = sample.groupBy("doc_id", "_q").agg(F.min(F.struct(*[f"f_{f}" for f in FEATURES])).alias("x")).collect()
    got.sort(key=lambda r: r["doc_id"])
    x = {f: np.array([r["x"][f"f_{f}"] for r in got]) for f in FEATURES}
    return cover(x, np.array([r["_q"] == 0 for r in got], bool), **how)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def apply_rules(documents: DataFrame, rules: DecisionList, keep: list[str]) -> DataFrame:
    """`keep` columns, the counts, base_failed, kept and the number of the rule that rejected."""
    stats = text_statistics(documents, keep=keep)
    return stats.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & ~rules.rejects()).alias("kept"), rules.fired().alias("rule"),
    )
