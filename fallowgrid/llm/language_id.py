"""Language identification by bit-sliced Bloom filters of character n-grams.

Words are runs of letters of the lower-cased text between single blanks; n-grams of SIZES characters hold a blank only at their ends.

Learning counts every n-gram per language over all rows to learn from (partial counts per task, summed by Spark).  An n-gram belongs
to a language if it makes up at least `rate` of the language's n-grams of its size, and at least `share` of the highest such rate
in any language: words quoted in another language's texts don't count as its own.  At most 1 / rate n-grams
can reach that rate per size and language, whatever the corpus holds, so the model is of bounded size.

The filter has one slot array; a slot holds a bit per language.  An n-gram sets its languages' bits in its HASHES slots; a lookup
ands these slots and gives the mask of all languages that have it.  A language's bits fill a known share of the slots, so a foreign n-gram
passes with that share to the power HASHES: of n n-grams with k hits, (k - f n) / (1 - f) are expected to be true.  Divided by the share
of its own n-grams that a language has in the filter (its coverage in learning), the largest decides; ties go to the language with more
learned rows, then to the smaller name.  The score is the winner's part of all languages' positive values.

Defined cases: null texts and texts without a letter are `und` with score 0; letters but no hit: the language with most learned rows, score 0;
rows with a null language or text are not learned from, repeated rows count each, rows without an id are not held out; without anything to learn from
every text is `und`; an empty table gives an empty result; other columns are ignored; very long texts are worked on in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, drop_stored, mix, stored

SIZES, RATE, SHARE, HASHES, SLOTS_PER_KEY = (3, 4), 2e-5, 0.3, 2, 16
#: Characters worked on at once; distinct n-grams that a task holds before it ships them.
PIECE, HELD = 1 << 17, 1 << 20
_BLANK = 32


def held_out(id: str = "doc_id") -> Column:
    """Rows that are never learned from (a null id counts as empty text: not held out)."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def letters() -> np.ndarray:
    """Whether each code point is a letter (planes beyond 3 hold none)."""
    return np.concatenate([np.fromiter(map(str.isalpha, map(chr, range(0x40000))), bool, 0x40000), np.zeros(0xD0000, bool)])


def _pieces(col: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, code points, text number of each) of texts that are lower-cased and followed by a blank; a longer text comes in several pieces.

    Pieces of one text overlap by the longest n-gram less one, and `own` marks where an n-gram may start.
    """
    size = pc.fill_null(pc.utf8_length(col), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size + 2)
    at = 0
    while at < len(col):
        end = min(max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))), at + 4096)
        texts = pc.utf8_lower(pc.fill_null(col.slice(at, end - at), "")).to_pylist()
        codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), np.uint32)
        number = np.repeat(np.arange(at, end), [len(t) + 2 for t in texts])
        for a in range(0, len(codes), limit):
            yield a, min(a + limit, len(codes)), codes[a : a + limit + max(SIZES) - 1], number[a : a + limit + max(SIZES) - 1]
        at = end


def grams(codes: np.ndarray, number: np.ndarray, starts: int, is_letter: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, hashes, text of each) of the n-grams that start in the first `starts` places."""
    word = is_letter[codes]
    x = np.where(word, codes, _BLANK).astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(29)
    letters_before = np.concatenate([[0], np.cumsum(word, dtype=np.int32)])
    h = np.zeros(len(x), U64)
    done = 0
    for n in sorted(SIZES):
        if len(x) < n:
            break
        while done < n:  # h[i] covers the characters i .. i + done - 1
            h = h[: len(x) - done] * U64(0x9FB21C651E98DF25) + x[done:]
            done += 1
        m = len(h)
        inner = letters_before[n - 1 : n - 1 + m] - letters_before[1 : 1 + m]
        fine = (inner == n - 2) & (letters_before[n : n + m] > letters_before[:m]) & (number[:m] == number[n - 1 : n - 1 + m])
        fine[starts:] = False
        yield n, mix(h[fine] + U64(n)), number[:m][fine]


def counts(documents: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, size, gram, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, held, pending = letters(), {}, 0

        def ship() -> Iterator[pa.RecordBatch]:
            for (name, size), parts in held.items():
                codes, keys = pd.factorize(np.concatenate([h for h, _ in parts]))
                n = np.bincount(codes, np.concatenate([w for _, w in parts]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(np.full(len(keys), size, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "size", "gram", "n"])

        for batch in batches:
            names = pc.dictionary_encode(batch.column(0))
            # texts of one language side by side
            order = np.argsort(names.indices.to_numpy(), kind="stable")
            which = names.indices.to_numpy()[order]
            for k, name in enumerate(names.dictionary.to_pylist()):
                for a, b, codes, number in _pieces(batch.column(1).take(pa.array(order[which == k]))):
                    for size, h, _ in grams(codes, number, b - a, is_letter):
                        found, keys = pd.factorize(h)
                        held.setdefault((name, size), []).append((keys, np.bincount(found, minlength=len(keys))))
                        pending += len(keys)
                if pending > HELD:
                    # sum what is held, and ship it if that leaves too much
                    merged = {key: [(pd.factorize(np.concatenate([h for h, _ in parts])), np.concatenate([w for _, w in parts]))] for key, parts in held.items()}
                    held = {key: [(keys, np.bincount(f, w, len(keys)).astype(np.int64))] for key, [((f, keys), w)] in merged.items()}
                    pending = sum(len(keys) for parts in held.values() for keys, _ in parts)
                    if pending > HELD // 2:
                        yield from ship()
                        held, pending = {}, 0
        yield from ship()

    clean = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), F.make_valid_utf8(F.col(text)))
    return clean.mapInArrow(run, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filter:
    """Languages, the slots' masks (one byte per eight languages), false-positive shares and coverages by language, rows learned from."""

    languages: list[str]
    slots: np.ndarray
    false: np.ndarray
    coverage: np.ndarray
    rows: np.ndarray

    @staticmethod
    def build(languages: list[str], keys: np.ndarray, member: np.ndarray, coverage: np.ndarray, rows: np.ndarray) -> Filter:
        """`member[i, l]`: whether n-gram i belongs to language l."""
        n = 1 << max(10, int(SLOTS_PER_KEY * max(len(keys), 1) - 1).bit_length())
        slots = np.zeros((n, -(-len(languages) // 8)), np.uint8)
        packed = np.packbits(member, axis=1, bitorder="little")
        for at in _slots(keys, n):
            np.bitwise_or.at(slots, at, packed)
        filled = np.array([(slots[:, k // 8] >> (k % 8) & 1).mean() for k in range(len(languages))])
        return Filter(languages, slots, filled**HASHES, coverage, rows)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """Bytes of the languages that have each n-gram."""
        first, *others = _slots(h, len(self.slots))
        out = self.slots[first]
        for at in others:
            out &= self.slots[at]
        return out


def _slots(h: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """HASHES slots of each n-gram, by double hashing with the halves of the hash."""
    step = (h >> U64(32)) | U64(1)
    for i in range(HASHES):
        yield ((h + U64(i) * step) & U64(n - 1)).view(np.int64)


def learn(documents: DataFrame, *, lang: str = "lang", text: str = "text", rate: float = RATE, share: float = SHARE) -> Filter:
    """The filter of all languages of the given rows; every n-gram of every row is counted."""
    rows = {r[0]: r[1] for r in documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(lang).cast("string").alias("l")).count().collect()}
    names = sorted(rows)
    c = stored(counts(documents, lang, text), "grams")
    totals = c.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    often = c.join(F.broadcast(totals), ["lang", "size"]).select("lang", "size", "gram", "n", (F.col("n") / F.col("total")).alias("r"))
    # one row per n-gram that reaches the rate somewhere: at most 1 / rate per size and language
    per = often.groupBy("size", "gram").agg(F.max("r").alias("top"), F.collect_list(F.struct("lang", "n", "r")).alias("x")).where(F.col("top") >= rate)
    found = per.select("size", "gram", F.filter("x", lambda x: (x["r"] >= rate) & (x["r"] >= share * F.col("top"))).alias("x")).collect()
    sums = {name: 0 for name in names}
    for r in totals.groupBy("lang").agg(F.sum("total").alias("t")).collect():
        sums[r.lang] = r.t
    drop_stored(c)
    keys, member = np.array([r.gram for r in found], np.int64).view(U64), np.zeros((len(found), len(names)), bool)
    held, number = np.zeros(len(names)), {name: i for i, name in enumerate(names)}
    for i, r in enumerate(found):
        for x in r.x:
            member[i, number[x.lang]] = True
            held[number[x.lang]] += x.n
    return Filter.build(names, keys, member, held / np.maximum([sums[name] for name in names], 1), np.array([rows[name] for name in names]))


def predict(documents: DataFrame, model: Filter, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` columns, lang_pred and score of every row."""
    languages, default = model.languages, int(np.argmax(model.rows)) if len(model.languages) else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = letters()
        per_bit = np.arange(256)[:, None] >> np.arange(8)[None] & 1
        rank = np.lexsort((np.arange(len(languages)), -model.rows))
        for batch in batches:
            n = batch.num_rows
            hits, total, any_letter = np.zeros((n, len(languages))), np.zeros(n), np.zeros(n, bool)
            for a, b, codes, number in _pieces(batch.column(batch.num_columns - 1)):
                any_letter[number[is_letter[codes]]] = True
                for _, h, of in grams(codes, number, b - a, is_letter):
                    if not len(h):
                        continue
                    low, high = int(of[0]), int(of[-1]) + 1
                    mask = model.masks(h)
                    for part in range(mask.shape[1]):
                        # how often each mask comes in each text, then the bits of the masks
                        tally = np.bincount((of - low) << 8 | mask[:, part], minlength=(high - low) << 8).reshape(-1, 256)
                        hits[low:high, 8 * part : 8 * part + 8] += tally @ per_bit[:, : len(languages) - 8 * part]
                        if not part:
                            total[low:high] += tally.sum(1)
            value = np.maximum((hits - model.false * total[:, None]) / np.maximum(1 - model.false, 1e-9), 0) / np.maximum(model.coverage, 1e-9)
            every = value.sum(1)
            if len(languages):
                best = rank[value[:, rank].argmax(1)]
                best = np.where(every > 0, best, default)
                score = np.where(every > 0, value[np.arange(n), best] / np.maximum(every, 1e-300), 0.0)
                names = np.array(languages, object)[best]
            else:
                names, score = np.full(n, "und", object), np.zeros(n)
            names = np.where(any_letter, names, "und")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(any_letter, score, 0.0))], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, F.make_valid_utf8(F.col(text)).alias(text)).mapInArrow(run, f"{kinds}, lang_pred string, score double")
