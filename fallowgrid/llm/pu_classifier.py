"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the unlabelled set is web text whose labels are not
looked at.  A small network on text statistics minimises the non-negative unbiased risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]),    l(z) = log(1 + exp(-z)),

where the class prior comes from the unlabelled and positive score distributions: the least ratio of their
upper bounds' tail shares over all thresholds of a first classifier (positives against unlabelled), found on
rows that it wasn't fitted to.  Negative labels are never used.

Both training samples are bounded by `sample_rows` each (the rows with the smallest hashes of their ids); all
documents are scored.  Statistics come from built-in functions, the network runs on Arrow batches of them.

Defined cases: null and empty texts have all statistics 0 and get a score as well; repeated rows score alike;
rows without an id are scored, not held out, and never learned from; of rows with one id the one with the least statistics is
learned from; an empty table gives no rows; without positives the prior is 0 and every score is 0; labels of documents that
don't exist are ignored; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import FEATURES, text_statistics

SAMPLE_ROWS = 12_000
CUT = 0.7


def held_out() -> Column:
    """Rows whose labels are never learned from (a null id counts as empty text: not held out)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Network:
    """Quantile-coded statistics, one hidden layer."""

    edges: list[np.ndarray]
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def code(self, x: np.ndarray) -> np.ndarray:
        """Each statistic as its share of the reference below it (piecewise linear), and whether it's 0."""
        cols = []
        for j, e in enumerate(self.edges):
            cols.append(np.interp(x[:, j], e, np.linspace(-1, 1, len(e))) if len(e) > 1 else np.zeros(len(x)))
            cols.append((x[:, j] == 0).astype(float))
        return np.column_stack(cols)

    def raw(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(self.code(x))) if self.prior > 0 else np.zeros(len(x))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33))) for j in range(x.shape[1])]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, hidden: int = 24, steps: int = 1500, batch: int = 512, seed: int = 7) -> Network:
    """Minimise the non-negative risk by Adam; with `prior` None, first estimate it."""
    if not len(positive) or not len(unlabelled):
        return Network([], np.zeros((0, 1)), np.zeros(1), np.zeros(1), 0.0, 0.0)
    if prior is None:
        prior = estimate_prior(positive, unlabelled, hidden, seed)
    rng = np.random.default_rng(seed)
    net = Network(_edges(np.concatenate([positive, unlabelled])), np.empty(0), np.zeros(hidden), np.empty(0), 0.0, prior)
    p, u = net.code(positive), net.code(unlabelled)
    net.w1, net.w2 = rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), rng.normal(0, 1 / np.sqrt(hidden), hidden)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, t = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], 0
    rate = 0.01
    epochs = -(-steps // -(-len(u) // batch))
    for epoch in range(epochs):
        if epoch == epochs * 2 // 3:
            rate /= 4
        order = rng.permutation(len(u))
        for a in range(0, len(u), batch):
            xu, xp = u[order[a : a + batch]], p[rng.integers(0, len(p), batch)]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ params[0] + params[1])
            f = h @ params[2] + params[3]
            fp, fu = f[: len(xp)], f[len(xp) :]
            soft = lambda z: np.logaddexp(0, -z)
            negative = soft(-fu).mean() - prior * soft(-fp).mean()
            # gradients of l(z) and l(-z) by f
            gp_pos, gp_neg = -_sigmoid(-fp) / len(xp), _sigmoid(fp) / len(xp)
            gu_neg = _sigmoid(fu) / len(xu)
            if negative >= 0:
                g = np.concatenate([prior * gp_pos - prior * gp_neg, gu_neg])
            else:  # step back out of the overfitted negative part
                g = np.concatenate([prior * gp_neg, -gu_neg])
            gh = np.outer(g, params[2]) * (1 - h * h)
            grads = [x.T @ gh + 1e-4 * params[0], gh.sum(0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            t += 1
            for i, d in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * d
                second[i] = 0.999 * second[i] + 0.001 * d * d
                params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, hidden: int, seed: int) -> float:
    """Share of positives among the unlabelled: the least (tail share of U + slack) / (tail share of P) over thresholds."""
    half_p, half_u = positive[::2], unlabelled[::2]
    first = fit(half_p, half_u, prior=0.5, hidden=hidden, steps=500, seed=seed)
    sp = np.sort(first.score(positive[1::2])) if len(positive) > 1 else first.score(positive)
    su = np.sort(first.score(unlabelled[1::2])) if len(unlabelled) > 1 else first.score(unlabelled)
    cuts = np.unique(np.quantile(sp, np.linspace(0, 0.95, 200)))
    tail_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    tail_u = 1 - np.searchsorted(su, cuts) / len(su)
    slack = (np.sqrt(1 / len(sp)) + np.sqrt(1 / len(su))) / 2
    return float(np.clip(np.min((tail_u + slack * (1 - tail_p)) / np.maximum(tail_p, 1e-9)), 0.02, 0.98))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """Fit on at most `sample_rows` positives and as many unlabelled rows; held-out rows are in neither."""
    ids = documents.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out())
    trusted = labels.where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    pick = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = pick(trusted).select("doc_id", F.lit(1).alias("_p")).union(pick(ids).select("doc_id", F.lit(0).alias("_p")))
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # of rows with one id the one with the least statistics: at most one per chosen id and role
    rows = text_statistics(sample, keep=["doc_id", "_p"]).groupBy("doc_id", "_p").agg(F.min(F.struct(*[f"f_{f}" for f in FEATURES])).alias("x")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["_p"]))
    x = np.array([list(r["x"]) for r in rows], float).reshape(len(rows), len(FEATURES))
    p = np.array([r["_p"] == 1 for r in rows], bool)
    rng = np.random.default_rng(3)  # doc ids may be ordered by what they hold; halves must not
    return fit(x[p][rng.permutation(int(p.sum()))], x[~p][rng.permutation(int((~p).sum()))])


def score(documents: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every document."""
    stats = text_statistics(documents.select("doc_id", "text"), keep=["doc_id"]).select("doc_id", *[f"f_{f}" for f in FEATURES])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"].array, "score": net.score(x[[f"f_{f}" for f in FEATURES]].to_numpy(float))})

    return stats.mapInPandas(run, "doc_id long, score double")
