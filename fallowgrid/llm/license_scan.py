"""License scans: an exact set-similarity join of text blocks with license templates.

Words are folded runs of ASCII letters, digits and non-ASCII characters.  A window is SPAN times a template's number of words, at any place of
a text; it meets the template where it holds at least `threshold` of the template's distinct words (containment).  All windows
that meet are found; those that follow each other word by word make one block, reported with its places and highest containment.

The distinct words of all templates have one order, by how many documents of the whole corpus have them, rarest first.  With n words of
a template and m = ceil(threshold * n) needed:
- Prefix filter: a window that meets holds one of the template's first n - m + 1 words, so only the stretches within a window's reach of such a word
  are looked at.
- Length filter: a stretch with fewer than m distinct words of the vocabulary holds no meeting window.
- Positional filter: where the first shared word is number i of the template and j of the stretch's y vocabulary words in that order, at most
  min(n - i, y - j) words can be shared; each further shared prefix word tightens it to those shared so far plus the rest.
In what remains, the distinct words of every window are counted by differences: a word counts for the windows that end between it and its next
place (a window's reach at the most).  That is linear in the text, however many notices it is made of.

`phrases` counts given consecutive words anywhere in the text, an exact scan beside the join.

Defined cases: null or empty texts have no words, labels, places or blocks and score 0; repeated rows and rows without an id are scanned
alike; ties of labels are all reported; an empty table gives an empty result; other columns are ignored; very long texts are scanned whole, in time
and memory proportional to their words.  Templates are part of the code or of a given folder (`from_folder`, bounded), so what is sent to tasks has a fixed size.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

THRESHOLD, SPAN = 0.8, 1.5

#: Phrases that label a text by themselves.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def label(template: str) -> str:
    return template.split("/")[0].removesuffix("-notice")


def from_folder(path: str, most_bytes: int = 4_000_000) -> dict[str, str]:
    """Templates from the text files of a folder, each under its file's name; over `most_bytes` in all are an error."""
    found = {n: open(os.path.join(path, n), encoding="utf-8", errors="replace").read() for n in sorted(os.listdir(path)) if os.path.isfile(os.path.join(path, n))}
    if sum(map(len, found.values())) > most_bytes:
        raise ValueError(f"templates over {most_bytes} bytes")
    return {n: t for n, t in found.items() if words(t.encode())}


class Templates:
    """Templates over one vocabulary, whose words are numbered by document frequency, rarest first."""

    def __init__(self, frequency: dict[bytes, int], templates: dict[str, str], threshold: float):
        own = {name: words(text.encode()) for name, text in templates.items()}
        order = sorted({w for ws in own.values() for w in ws}, key=lambda w: (frequency.get(w, 0), w))
        self.number = {w: i for i, w in enumerate(order)}
        self.names, self.entries, self.prefix_of = list(own), [], {}
        for k, ws in enumerate(own.values()):
            ids = np.array(sorted({self.number[w] for w in ws}))
            need = max(1, math.ceil(threshold * len(ids) - 1e-9))
            self.entries.append((ids, need, math.ceil(SPAN * len(ws))))
            for w in ids[: len(ids) - need + 1].tolist():
                self.prefix_of.setdefault(w, []).append(k)
        self.prefix_words = {order[w] for w in self.prefix_of}

    def possible(self, k: int, stretch: np.ndarray) -> bool:
        """Whether the sorted distinct vocabulary words of a stretch pass the length and positional filters of template k."""
        ids, need, _ = self.entries[k]
        if len(stretch) < need:
            return False
        shared = 0
        for i, w in enumerate(ids[: len(ids) - need + 1].tolist()):
            j = int(np.searchsorted(stretch, w))
            if j < len(stretch) and stretch[j] == w:
                if shared + min(len(ids) - i, len(stretch) - j) < need:
                    return False
                shared += 1
        return shared > 0

    def blocks(self, own: list[bytes], distinct: set[bytes]) -> list[tuple[str, int, int, float]]:
        """(template, first word, word after the last, containment) of the blocks of a text, by template and place."""
        if distinct.isdisjoint(self.prefix_words):
            return []
        number = self.number
        ids = np.fromiter((number.get(w, -1) for w in own), np.int64, len(own))
        at = np.flatnonzero(ids >= 0)
        ids = ids[at]
        here = np.unique(ids)
        out = []
        for k in sorted({k for w in here.tolist() for k in self.prefix_of.get(w, ())}):
            target, need, span = self.entries[k]
            if not self.possible(k, here):
                continue
            rare = at[np.isin(ids, target[: len(target) - need + 1])]
            # stretches: places within a window's reach of a prefix word
            cut = np.flatnonzero(np.diff(rare) > 2 * span)
            for a, b in zip(rare[np.concatenate([[0], cut + 1])], rare[np.concatenate([cut, [len(rare) - 1]])], strict=True):
                lo, hi = np.searchsorted(at, [a - span + 1, b + span])
                w, p = ids[lo:hi], at[lo:hi]
                if not self.possible(k, np.unique(w)):
                    continue
                mine = np.isin(w, target)
                out += [(self.names[k], s, e, n / len(target)) for s, e, n in _windows(w[mine], p[mine], span, need)]
        return out


def _windows(word: np.ndarray, place: np.ndarray, span: int, need: int) -> list[tuple[int, int, int]]:
    """(first word, word after the last, most distinct words) of the runs of windows of `span` places that hold `need` distinct words."""
    order = np.argsort(word, kind="stable")
    follow = np.full(len(word), np.iinfo(np.int64).max)
    same = word[order][1:] == word[order][:-1]
    follow[order[:-1][same]] = place[order[1:][same]]
    # a word counts for the windows that end from its place up to its next place or its leaving
    ends = np.minimum(place + span, follow)
    base = int(place[0])
    change = np.bincount(place - base, minlength=int(ends.max()) - base + 1)
    change -= np.bincount(ends - base, minlength=len(change))
    n = np.cumsum(change)
    good = n >= need
    edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        # windows ending at base + a .. base + b - 1: the block runs from the first window's first word to the last one's last
        first = place[np.searchsorted(place, base + a - span + 1)]
        last = place[np.searchsorted(place, base + b - 1, "right") - 1]
        out.append((int(first), int(last) + 1, int(n[a:b].max())))
    return out


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase stands, in one pass: blanks are counted from the place before."""
    found, at, n, last = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        n += joined.count(b" ", last, at)
        found.append(n)
        last = at
        at = joined.find(b" " + phrase + b" ", at + 1)
    return found


def document_frequency(documents: DataFrame, templates: dict[str, str] = TEMPLATES) -> dict[bytes, int]:
    """Documents of the whole corpus that have each word of the templates: partial counts per task, summed by Spark."""
    vocabulary = {w for t in templates.values() for w in words(t.encode())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for t in pc.fill_null(batch.column(0), "").cast(pa.binary()).to_pylist():
                count.update(vocabulary.intersection(words(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    rows = documents.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<template: string, first: long, end: long, containment: double>>"
NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
BLOCK = pa.struct([("template", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: words, places of the phrases, labels of phrases and templates, the best containment, all blocks."""
    frequency = document_frequency(documents, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(frequency, templates, threshold)
        keys = [(p.encode(), name) for p, name in phrases.items()]
        last = [p.split()[-1] for p, _ in keys]
        for batch in batches:
            rows = []
            for t in pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist():
                own = words(t)
                distinct = set(own)
                places, base = [], set()
                if any(w in distinct for w in last):
                    joined = b" " + b" ".join(own) + b" "
                    for phrase, name in keys:
                        if got := _places(joined, phrase):
                            places += got
                            base.add(name)
                met = known.blocks(own, distinct)
                labels = base | {label(name) for name, *_ in met}
                best = 1.0 if base else max((c for *_, c in met), default=0.0)
                rows.append((len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best, [dict(zip(("template", "first", "end", "containment"), m, strict=True)) for m in met]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(BLOCK))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=NAMES)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
