"""SentencePiece encoding and decoding in numpy batches, from a model file's pieces, by batched Viterbi.

Texts fall into segments (a run of blanks and the characters up to the next blank); no piece crosses one.
The distinct segments of a block advance together, one character a step (so those of equal length end
together).  The hashes of all their substrings probe the sorted hashes of the pieces once, which gives the
lattice; at each step the pieces that end there compete, and the winner's start is stored as backpointer:

* a unigram model takes the highest sum of scores (the longest piece of equals);
* a BPE model's scores order merges, so a sum of them means nothing.  There the winner is the one piece that
  may follow the last piece of the best path to its start: merging the two by themselves gives the two again.
  Merges between pieces that survive never happen, so a row of pieces is the encoding of its text exactly if
  each adjacent two are; hence exactly one piece wins at every place, and results equal the library's.
  Whether two pieces may be neighbours is read off the edges of their merge trees, for all pairs at once.

BPE segments over LONG characters are cut into windows that overlap, and joined at a piece that both windows
have at the same place (by the same theorem, the result is exact).

Equal segments are found by hash and compared character by character, so colliding ones stay apart.

Defined cases: null and empty texts have no ids and decode to ""; unknown characters become byte pieces,
or the unknown id where a model has none; U+2581 in a text is a blank, as in the library; repeated rows and
null ids need no care; empty tables give empty results; columns other than the kept ones are ignored, whatever
their names.  Refused: a model with a compiled character map, or that removes blanks, or has user-defined
pieces, pieces with a blank after other characters, or (BPE) pieces that are formed before their own parts.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, blocks, list_array, mix, ranges

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Windows of a longer segment, and how far they reach into each other.
LONG, OVERLAP = 256, 64
NEVER = 1 << 30
PROBE_BITS = 20
SLICE = 1 << 18
U64, I64 = np.uint64, np.int64


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    unigram: bool
    prefix: bool
    unknown: int = 0
    byte_ids: list[int] = field(default_factory=list)

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, scores, kinds, unigram, prefix = [], [], [], True, True
        for k, v in _fields(data):
            if k == 1:
                piece = dict(_fields(v))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, 1))
            elif k == 2:
                unigram = dict(_fields(v)).get(3, 1) == 1
            elif k == 3:
                norm = dict(_fields(v))
                prefix = bool(norm.get(3, 1))
                if norm.get(2) or norm.get(4, 1):
                    raise ValueError("a model that changes characters or removes blanks is not supported")
        kinds = np.array(kinds, np.int8)
        by_byte = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 6}
        byte_ids = [by_byte[f"<0x{b:02X}>"] for b in range(256)] if len(by_byte) == 256 else []
        unknown = int(np.flatnonzero(kinds == 2)[0]) if (kinds == 2).any() else 0
        return cls(pieces, np.array(scores, np.float64), kinds, unigram, prefix, unknown, byte_ids)

    def __post_init__(self) -> None:
        usable = np.flatnonzero(self.kinds == 1)
        if (self.kinds == 4).any():
            raise ValueError("user-defined pieces are not supported")
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable):
            raise ValueError("a piece with a blank after other characters is not supported")
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        self.floor = float(self.scores[usable].min()) - 10.0 if len(usable) else 0.0
        self.keys = Probe(self._hash([self.pieces[i] for i in usable]), usable)
        out, off = [], [0]
        for i, p in enumerate(self.pieces):
            b = bytes([self.byte_ids.index(i)]) if self.kinds[i] == 6 and self.byte_ids else p.replace(SPACE, " ").encode() if self.kinds[i] == 1 else b" \xe2\x81\x87 " if self.kinds[i] == 2 else b""
            out.append(b)
            off.append(off[-1] + len(b))
        self.bytes, self.byte_off = np.frombuffer(b"".join(out), np.uint8), np.array(off, I64)
        if not self.unigram:
            self._merge_trees(usable)

    @staticmethod
    def _hash(texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), U64)
        for i, t in enumerate(texts):
            h = 0
            for c in t:
                h = (h * int(_STEP) + ord(c) + 1) & (2**64 - 1)
            out[i] = h
        return out

    # --- BPE: which pieces may be neighbours ---------------------------------------------------

    def _merge_trees(self, usable: np.ndarray) -> None:
        """For each piece its rank (single characters -1, else by score) and the two parts that it is merged from last."""
        n = len(self.pieces) + 1  # the last is any unknown character: it merges with nothing
        at = {self.pieces[i]: int(i) for i in usable}
        if any(c not in at for p in at for c in p):
            raise ValueError("a character of a piece that is not a piece itself")
        self.rank = np.full(n, -1, I64)
        _, dense = np.unique(-self.scores[usable], return_inverse=True)
        long = np.array([len(self.pieces[i]) > 1 for i in usable], bool)
        self.rank[usable[long]] = dense[long]
        self.left, self.right = np.full(n, -1, I64), np.full(n, -1, I64)
        a, b, whole = [], [], []
        for p, i in at.items():
            for k in range(1, len(p)):
                if (x := at.get(p[:k])) is not None and (y := at.get(p[k:])) is not None:
                    a.append(x)
                    b.append(y)
                    whole.append(i)
        a, b, whole = (np.array(x, I64) for x in (a, b, whole))
        self.joint = Probe((a * n + b).view(U64), self.rank[whole])
        # shorter pieces first: the parts of a piece must have theirs
        size = np.array([len(self.pieces[i]) for i in whole], I64)
        for length in np.unique(size):
            some = np.flatnonzero(size == length)
            some = some[self.neighbours(a[some], b[some], top=False)]
            self.left[whole[some]], self.right[whole[some]] = a[some], b[some]
        long_ids = usable[long]
        formed = (self.left[long_ids] >= 0) & (self.rank[self.left[long_ids]] <= self.rank[long_ids]) & (self.rank[self.right[long_ids]] <= self.rank[long_ids])
        if not formed.all():
            raise ValueError("a piece that merges don't form in the order of scores")

    def _joint_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that a and b merge to, or NEVER."""
        out = np.full(len(a), NEVER, I64)
        at, rank = self.joint.find((a * len(self.rank) + b).view(U64))
        out[at] = rank
        return out

    def neighbours(self, a: np.ndarray, b: np.ndarray, top: bool = True) -> np.ndarray:
        """Whether merging the texts of pieces a and b together gives a and b again (without `top`, up to the merge of a with b).

        Goes back in time: u and v are the symbols on both sides of the border, taken apart in turns, the one that
        was formed later first.  If they merge before the next merge of either, a and b never come to be.
        """
        ok = np.ones(len(a), bool)
        live, u, v = np.arange(len(a)), a, b
        next_u, next_v = np.full(len(a), NEVER, I64), np.full(len(a), NEVER, I64)
        while len(live):
            if top:
                c = self._joint_rank(u, v)
                # of equals the leftmost merges first: a's next merge before the border's, that before b's
                cross = np.where(next_u <= next_v, c < next_u, c <= next_v)
                ok[live[cross]] = False
            else:
                cross, top = np.zeros(len(live), bool), True
            ru, rv = self.rank[u], self.rank[v]
            go = np.flatnonzero(~cross & ((ru >= 0) | (rv >= 0)))
            live, u, v, next_u, next_v, ru, rv = (x[go] for x in (live, u, v, next_u, next_v, ru, rv))
            back = ru > rv
            u, next_u = np.where(back, self.right[u], u), np.where(back, ru, next_u)
            v, next_v = np.where(back, v, self.left[v]), np.where(back, next_v, rv)
        return ok

    # --- the lattice ---------------------------------------------------------------------------

    def lattice(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of every piece in the segments that end at `ends`; unknown characters have the id len(pieces)."""
        known = np.zeros(len(chars), bool)
        found = []
        room = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(len(chars))
        wide = chars.astype(U64) + U64(1)
        at, h = np.arange(len(chars)), np.zeros(len(chars), U64)
        for n in range(1, self.longest + 1):
            some = np.flatnonzero(room[at] >= n)
            if not len(some):
                break
            at = at[some]
            h = h[some] * _STEP + wide[at + n - 1]
            hit, ids = self.keys.find(h)
            found.append((at[hit], np.full(len(hit), n, I64), ids))
            if n == 1:
                known[at[hit]] = True
        lost = np.flatnonzero(~known)
        found.append((lost, np.ones(len(lost), I64), np.full(len(lost), len(self.pieces), I64)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def viterbi(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of all segments that stand in a row in `chars`: (segment, start, id), by segment and start."""
        size = np.diff(np.concatenate([[0], ends]))
        heads = ends - size
        start, n, piece = self.lattice(chars, ends)
        # places between characters: one more than characters a segment
        segment = np.repeat(np.arange(len(ends)), size)[start]
        place = start + segment
        step = start - heads[segment] + n
        order = np.lexsort((-n, place, step)) if self.unigram else np.argsort(step.astype(np.uint16) if len(step) and step.max() < 1 << 16 else step, kind="stable")
        place, n, piece, step = place[order], n[order], piece[order], step[order]
        last, back = np.full(len(chars) + len(ends), -1, I64), np.zeros(len(chars) + len(ends), I64)
        best = np.full(len(chars) + len(ends), -np.inf) if self.unigram else None
        if self.unigram:
            best[heads + np.arange(len(ends))] = 0.0
            worth = np.append(self.scores, self.floor)[piece]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1, [len(step)]]) if len(step) else [0]
        for lo, hi in zip(cut, cut[1:], strict=False):
            p, k, i = place[lo:hi], n[lo:hi], piece[lo:hi]
            if self.unigram:
                to, total = p + k, best[p] + worth[lo:hi]
                rank = np.lexsort((-k, -total, to))
                win = rank[np.concatenate([[True], np.diff(to[rank]) != 0])]
                best[to[win]] = total[win]
            else:
                before = last[p]
                ok = before < 0
                rest = np.flatnonzero(~ok)
                ok[rest] = self.neighbours(before[rest], i[rest])
                win = np.flatnonzero(ok)
            to = p[win] + k[win]
            last[to], back[to] = i[win], p[win]
        out = []
        own = np.flatnonzero(size > 0)
        at = (ends + np.arange(len(ends)))[own]
        zero = heads + np.arange(len(ends))
        while len(own):
            out.append((own, back[at], last[at]))
            at = back[at]
            go = at > zero[own]
            own, at = own[go], at[go]
        segment, place, piece = (np.concatenate(x) for x in zip(*out[::-1], strict=True)) if out else (np.empty(0, I64),) * 3
        order = np.argsort(segment, kind="stable")
        segment, place, piece = segment[order], place[order], piece[order]
        return segment, place - segment, piece

    def segment(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments (which stand in a row in `chars`) and how many each has; about SLICE characters at a time."""
        cuts = np.unique(np.searchsorted(ends, np.arange(SLICE, len(chars) + SLICE, SLICE)).clip(max=len(ends)))
        if len(cuts) > 1 or (len(cuts) and cuts[0] < len(ends)):
            cuts = np.unique(np.concatenate([[0], cuts, [len(ends)]])).tolist()
            upto = np.concatenate([[0], ends])
            parts = [self.segment_slice(chars[upto[a] : upto[b]], ends[a:b] - upto[a]) for a, b in zip(cuts, cuts[1:], strict=False)]
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        return self.segment_slice(chars, ends)

    def segment_slice(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(np.concatenate([[0], ends]))
        if self.unigram or size.max(initial=0) <= LONG:
            segment, start, piece = self.viterbi(chars, ends)
        else:
            segment, start, piece = self._windows(chars, ends, size, LONG, OVERLAP)
        n = np.ones(len(piece), I64)
        lost = np.flatnonzero(piece == len(self.pieces))
        if len(lost) and self.byte_ids:
            code = chars[start[lost]].astype(I64)
            n[lost] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        ids = np.repeat(piece, n)
        if len(lost):
            if self.byte_ids:
                ids[ranges((np.cumsum(n) - n)[lost], n[lost])] = np.array(self.byte_ids, I64)[np.frombuffer(chars[start[lost]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)]
            else:
                ids[lost] = self.unknown
        return ids, np.bincount(np.repeat(segment, n), minlength=len(ends))

    def _windows(self, chars: np.ndarray, ends: np.ndarray, size: np.ndarray, length: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same by overlapping windows of long segments; where two don't agree on a piece, with larger ones."""
        heads = ends - size
        count = np.maximum(1, -(-(size - overlap) // (length - overlap)))
        owner = np.repeat(np.arange(len(ends)), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        lo = heads[owner] + number * (length - overlap)
        hi = np.where(number + 1 == count[owner], ends[owner], lo + length)
        window, place, piece = self.viterbi(chars[ranges(lo, hi - lo)], np.cumsum(hi - lo))
        place = place - (np.cumsum(hi - lo) - (hi - lo))[window] + lo[window]
        # a piece that two windows in a row both have ends the first one's part
        key = place * (len(self.pieces) + 1) + piece
        shift = np.int64(len(chars) + 1) * (len(self.pieces) + 1)
        if len(owner) and shift < (1 << 62) // len(owner):
            twin = np.isin(key + (window + 1) * shift, key + window * shift)
        else:
            twin = np.zeros(len(key), bool)
            edge = np.searchsorted(window, np.arange(len(owner) + 1))
            for w in np.flatnonzero(owner[1:] == owner[:-1]):
                twin[edge[w] : edge[w + 1]] = np.isin(key[edge[w] : edge[w + 1]], key[edge[w + 1] : edge[w + 2]])
        join = np.full(len(owner), -1, I64)  # the last place at which a window agrees with the next
        np.maximum.at(join, window[twin], place[twin])
        inner = np.concatenate([owner[1:] == owner[:-1], [False]])
        failed = np.unique(owner[inner & (join < 0)])
        begin, stop = heads[owner].copy(), ends[owner].copy()
        stop[inner] = join[inner]
        begin[1:][inner[:-1]] = join[:-1][inner[:-1]]
        keep = (place >= begin[window]) & (place < stop[window]) & ~np.isin(owner[window], failed)
        segment, place, piece = owner[window[keep]], place[keep], piece[keep]
        if len(failed):
            more = 4 * length
            again = self._windows(chars[ranges(heads[failed], size[failed])], np.cumsum(size[failed]), size[failed], more, more // 4)
            segment, piece = np.concatenate([segment, failed[again[0]]]), np.concatenate([piece, again[2]])
            place = np.concatenate([place, again[1] - (np.cumsum(size[failed]) - size[failed])[again[0]] + heads[failed[again[0]]]])
            order = np.lexsort((place, segment))
            segment, place, piece = segment[order], place[order], piece[order]
        return segment, place, piece


_STEP, _ODD, _SHIFT = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(64 - PROBE_BITS)


class Probe:
    """Values by 64-bit key: scrambled keys in order, and for each beginning of a key where it first stands."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        scrambled = keys * _ODD
        order = np.argsort(scrambled, kind="stable")
        self.keys, self.values = scrambled[order], values[order].astype(I64)
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two entries of one key")
        slot = (self.keys >> _SHIFT).astype(I64)
        self.first = np.full(1 << PROBE_BITS, -1, np.int32)
        self.first[slot[::-1]] = np.arange(len(slot) - 1, -1, -1)
        self.most = int(np.bincount(slot).max()) if len(slot) else 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of `keys` are there, their values)."""
        scrambled = keys * _ODD
        at = self.first[scrambled >> _SHIFT]
        some = np.flatnonzero(at >= 0)
        at, scrambled = at[some], scrambled[some]
        where = np.full(len(some), -1, I64)
        for k in range(self.most):
            j = np.minimum(at + k, len(self.keys) - 1)
            where = np.where(self.keys[j] == scrambled, j, where)
        real = np.flatnonzero(where >= 0)
        return some[real], self.values[where[real]]


class Codec:
    """Encodes and decodes blocks of texts."""

    def __init__(self, model: Model):
        self.model = model

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text."""
        texts = len(off) - 1
        if not len(buf):
            return np.empty(0, np.int32), np.zeros(texts + 1, I64)
        chars = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
        if len(chars) < len(buf):
            off = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
        chars[chars == 32] = ord(SPACE)
        some = np.flatnonzero(np.diff(off) > 0)
        if self.model.prefix:
            chars = np.insert(chars, off[some], ord(SPACE))
            off = off + np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
        blank = chars == ord(SPACE)
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[off[:-1][some]] = True
        starts = np.flatnonzero(start)
        size = np.diff(np.append(starts, len(chars)))
        h = mix(Rolling(chars).of(starts, starts + size)) + size.astype(U64)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        # segments of one hash that differ from its first stay by themselves
        twin = first[inverse]
        other = np.flatnonzero(size != size[twin])
        if not len(other):
            unlike = chars != chars[ranges(starts[twin], size)]
            other = np.unique(np.searchsorted(starts, np.flatnonzero(unlike), side="right") - 1)
        if len(other):
            inverse[other] = len(first) + np.arange(len(other))
            first = np.concatenate([first, other])
        own, n_own = self.model.segment(chars[ranges(starts[first], size[first])], np.cumsum(size[first]))
        n = n_own[inverse]
        ids = own[ranges((np.cumsum(n_own) - n_own)[inverse], n)].astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(n)])
        return ids, upto[np.searchsorted(starts, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and their offsets; the prefix blank goes."""
        m = self.model
        n = (m.byte_off[1:] - m.byte_off[:-1])[ids]
        out = m.bytes[ranges(m.byte_off[ids], n)]
        upto = np.concatenate([[0], np.cumsum(n)])[off]
        if m.prefix and len(out):
            heads = upto[:-1][np.diff(upto) > 0]
            drop = heads[out[heads] == 32]
            keep = np.ones(len(out), bool)
            keep[drop] = False
            upto = upto - np.searchsorted(drop, upto)
            out = out[keep]
        return out, upto


def _load(spark: SparkSession, path: str):
    """The model for the executors: one file of fixed size, read and prepared once on the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Model.parse(f.read()))


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """`keep` columns, then ids array<int>, n_tokens, n_bytes and round_trip (decoding gives the text again)."""
    data = _load(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data.value)
        for batch, buf, off in blocks(batches, text):
            ids, at = codec.encode(buf, off)
            back, back_off = codec.decode(ids, at)
            same = np.diff(back_off) == np.diff(off)
            if same.all() and np.array_equal(back, buf):
                equal = same
            else:
                equal = np.array([bool(same[i]) and np.array_equal(back[back_off[i] : back_off[i + 1]], buf[off[i] : off[i + 1]]) for i in range(len(same))])
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, list_array(ids, at, pa.int32()), pa.array(np.diff(at)), pa.array(np.diff(off)), pa.array(equal)], names=[*keep, "ids", "n_tokens", "n_bytes", "round_trip"])

    narrow = df.select(*keep, *([text] if text not in keep else []))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.select(*keep).schema)
    return narrow.mapInArrow(run, f"{kept}, ids array<int>, n_tokens long, n_bytes long, round_trip boolean")


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """`keep` columns and text; null ids decode to ""."""
    data = _load(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            out, off = codec.decode(flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            texts = pa.array([out[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off, off[1:], strict=False)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], texts], names=[*keep, "text"])

    narrow = df.select(*keep, ids)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.select(*keep).schema)
    return narrow.mapInArrow(run, f"{kept}, text string")


def id_digest(encoded: DataFrame) -> DataFrame:
    """SHA-256 of each row's ids as little-endian 32-bit integers, beside the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, off = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            off = off - off[0]
            hexes = [hashlib.sha256(flat[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(off, off[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in (2, 3, 4)), pa.array(hexes)], names=["doc_id", "n_tokens", "n_bytes", "round_trip", "ids_sha256"])

    return encoded.select("doc_id", "ids", "n_tokens", "n_bytes", "round_trip").mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, round_trip boolean, ids_sha256 string")
