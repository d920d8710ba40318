"""Chat formatting: columnar byte assembly of conversations with a loss mask.

Template, per turn:  <|im_start|>ROLE \\n TEXT <|im_end|> \\n

Inside texts and roles every literal "<|" is written "<||", which no marker contains, and a newline
inside a role "<|n", so marks never appear inside a text and unescaping ("<||" to "<|", once from the left) restores the text exactly: after
escaping, each "<|" is followed by an inserted "|", whatever came next before.

Within an Arrow batch of conversations segment lengths are computed first, their cumulative sums give the
destination of every segment, and headers and contents are copied into one preallocated buffer.

Defined cases: null text is empty, null role is the empty role, turns are ordered by (turn, role, text)
with nulls first, so ties and repeated rows have a fixed order and all are kept; null conv_id forms one
conversation; an empty table gives no rows; other columns are ignored, whatever their names.  A conversation is one row of the
output, hence bounded by the longest conversation, not by the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, ranges, text_bytes

START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
PART_BYTES = 1 << 28
OUT = "conv_id long, n_turns long, formatted binary, turn_starts array<long>, loss_starts array<long>, loss_ends array<long>"


def escape(text: str) -> str:
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def unescape_role(role: str) -> str:
    return unescape(role.replace("<|n", "\n"))


def _assemble(header: np.ndarray, header_off: np.ndarray, body: np.ndarray, body_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """START role MIDDLE text END for every turn, in one buffer; and the starts of all five segments."""
    n = len(header_off) - 1
    sizes = np.empty((n, 5), np.int64)
    sizes[:, 0], sizes[:, 2], sizes[:, 4] = len(START), len(MIDDLE), len(END)
    sizes[:, 1], sizes[:, 3] = np.diff(header_off), np.diff(body_off)
    at = np.concatenate([[0], np.cumsum(sizes.ravel())])
    out = np.empty(at[-1], np.uint8)
    starts = at[:-1].reshape(n, 5)
    for k, mark in ((0, START), (2, MIDDLE), (4, END)):
        mark_bytes = np.frombuffer(mark, np.uint8)
        for i, b in enumerate(mark_bytes):
            out[starts[:, k] + i] = b
    out[ranges(starts[:, 1], sizes[:, 1])] = header
    out[ranges(starts[:, 3], sizes[:, 3])] = body
    return out, np.column_stack([starts, at[5::5]])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most PART_BYTES, or of one conversation: a binary column ends at 2 GB."""
    for batch in batches:
        if batch.num_rows > 1 and batch.nbytes > PART_BYTES:
            half = batch.num_rows // 2
            yield from _parts([batch.slice(0, half), batch.slice(half)])
        else:
            yield batch


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        if not batch.num_rows:
            continue
        turns = batch.column(1)
        first = np.asarray(turns.offsets.to_numpy(), np.int64)
        first = first - first[0]
        flat = turns.flatten()
        role, text, by_assistant = flat.flatten()
        (head, head_off), (body, body_off) = text_bytes(role), text_bytes(text)
        out, starts = _assemble(head, head_off, body, body_off)
        conv_off = np.concatenate([starts[:, 0], starts[-1:, 5] if len(starts) else [0]])[first] if len(starts) else np.zeros(len(first), np.int64)
        said = np.asarray(by_assistant.to_numpy(zero_copy_only=False), bool)
        conv = np.repeat(np.arange(batch.num_rows), np.diff(first))
        base = conv_off[:-1]
        loss_off = np.concatenate([[0], np.cumsum(np.bincount(conv[said], minlength=batch.num_rows))])
        rel = starts - base[conv][:, None] if len(starts) else np.empty((0, 6), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.diff(first)),
                pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(conv_off.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary()),
                list_array(rel[:, 0], first, pa.int64()),
                list_array(rel[said, 3], loss_off, pa.int64()),
                list_array(rel[said, 4], loss_off, pa.int64()),
            ],
            names=["conv_id", "n_turns", "formatted", "turn_starts", "loss_starts", "loss_ends"],
        )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: the formatted bytes, turn starts, and the byte spans under the loss mask (assistant texts)."""
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("x"),
    )
    packed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    packed = packed.select("conv_id", F.transform("x", lambda x: F.struct(F.replace(F.replace(x["role"], F.lit("<|"), F.lit("<||")), F.lit("\n"), F.lit("<|n")).alias("r"), F.replace(x["text"], F.lit("<|"), F.lit("<||")).alias("t"), (x["role"] == "assistant").alias("a"))).alias("x"))
    return packed.mapInArrow(_format, OUT)


def read_back(formatted: bytes, turn_starts: list[int]) -> list[tuple[str, str]]:
    """Roles and texts, from the output alone (the starts only say where turns begin)."""
    found = []
    for a, b in zip(turn_starts, [*turn_starts[1:], len(formatted)], strict=True):
        turn = formatted[a:b]
        if not (turn.startswith(START) and turn.endswith(END)):
            raise ValueError("a turn without its marks")
        role, _, text = turn[len(START) : -len(END)].partition(MIDDLE)
        found.append((unescape_role(role.decode()), unescape(text.decode())))
    return found


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """The same without the starts: marks can't occur inside escaped texts."""
    found = []
    for turn in formatted.split(START)[1:]:
        role, _, text = turn[: -len(END)].partition(MIDDLE)
        found.append((unescape_role(role.decode()), unescape(text.decode())))
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for conv_id, n, data, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)), strict=True):
            turns = parse(data)
            loss = [unescape(data[x:y].decode()) for x, y in zip(a, b, strict=True)]
            whole, under = hashlib.sha256(), hashlib.sha256()
            for role, text in turns:
                whole.update(f"{role}\n{text}\n".encode())
            for x in loss:
                under.update(x.encode())
            if len(turns) != n:
                raise ValueError("turns were lost")
            rows.append((conv_id, len(turns), whole.hexdigest(), sum(map(len, loss)), under.hexdigest(), len(data.decode())))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def digests(formatted: DataFrame) -> DataFrame:
    """Figures that are read back from the formatted bytes."""
    return formatted.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
