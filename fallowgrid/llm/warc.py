"""WARC archives as seekable Zstandard bundles.

A bundle is a byte string: independent Zstandard frames, each holding whole WARC records, then a
skippable frame (magic 0x184D2A5E) with the seek table: per frame its compressed and decompressed size,
then the number of frames, a descriptor byte 0 and the magic number 0x8F92EAB1, all little-endian.
Records are found by (bundle, frame, offset within the decompressed frame, length): a reader fetches one
frame, not the bundle.

`write_bundles` stores bundles and their record index as Parquet tables in the shared folder.  Spark's
committer makes a lost executor's half-written files invisible, and the same code works on any store.
`decode_bundles` yields all records; `fetch` reads chosen records through the index.

Revisits: of records with equal payloads of at least `least` bytes the largest id is the response; others
are `revisit` records without a payload that refer to it.

Defined cases: a null payload is empty; a null url is written as an empty target; equal ids are kept as
separate records; an empty table gives empty bundles and index; other columns are ignored, whatever their
names.  Null ids are written as `none` and read back as null; as ids of responses they lose against any other.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 23, 3
CRLF = b"\r\n"
#: The date of records whose table doesn't say when a page was fetched, and the name of pages without an id.
DATE, NO_ID = "1970-01-01T00:00:00Z", "none"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of every frame, from the end of the bundle."""
    n, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != FOOTER or descriptor:
        raise ValueError("no seek table")
    at, start, out = len(bundle) - 9 - 8 * n, 0, []
    for i in range(n):
        packed, size = struct.unpack_from("<II", bundle, at + 8 * i)
        out.append((start, packed, size))
        start += packed
    return out


def _record(page_id, url, payload: bytes, digest: str, size: int, refers, date: str = DATE) -> bytes:
    name = NO_ID if page_id is None else str(page_id)
    lines = [
        b"WARC/1.1",
        f"WARC-Date: {date}".encode(),
        b"WARC-Type: " + (b"response" if refers is None else b"revisit"),
        f"WARC-Record-ID: <urn:page:{name}>".encode(),
        b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode(),
        f"WARC-Payload-Digest: sha1:{digest}".encode(),
        f"X-Payload-Length: {size}".encode(),
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines += [b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}".encode()]
    return CRLF.join(lines) + CRLF + CRLF + payload + CRLF + CRLF


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of every record of a decompressed frame."""
    at = 0
    while at < len(data):
        head_end = data.index(CRLF + CRLF, at)
        head = data[at:head_end].decode().split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in head[1:])
        start = head_end + 4
        size = int(fields["Content-Length"])
        if data[start + size : start + size + 4] != CRLF + CRLF:
            raise ValueError("a record of another length than its header says")
        yield at, start + size + 4 - at, fields, data[start : start + size]
        at = start + size + 4


class _Bundle:
    def __init__(self) -> None:
        self.name, self.frames, self.parts, self.index = uuid.uuid4().hex, [], [], []
        self.open, self.open_bytes, self.bytes = [], 0, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, page_id, record: bytes) -> None:
        self.index.append((page_id, len(self.frames), self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.frames.append((len(packed), self.open_bytes))
            self.parts.append(packed)
            self.bytes += len(packed)
            self.open, self.open_bytes = [], 0

    def row(self) -> tuple:
        self.close_frame()
        return self.name, b"".join(self.parts) + seek_table(self.frames), self.index


_INDEX = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
BUNDLES = "bundle string, data binary, records array<struct<page_id:long,frame:int,offset:long,length:long>>"


def _pack(batches: Iterator[pa.RecordBatch], date: str = DATE) -> Iterator[pa.RecordBatch]:
    def out(b: _Bundle) -> pa.RecordBatch:
        name, data, index = b.row()
        rows = [{"page_id": p, "frame": f, "offset": o, "length": n} for p, f, o, n in index]
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), pa.array([rows], _INDEX)], names=["bundle", "data", "records"])

    now = _Bundle()
    for batch in batches:
        ids, urls, htmls, digests, sizes, refs = (batch.column(i) for i in range(6))
        for i in range(batch.num_rows):
            html = htmls[i].as_py()
            now.add(ids[i].as_py(), _record(ids[i].as_py(), urls[i].as_py(), (html or "").encode(), digests[i].as_py(), sizes[i].as_py(), refs[i].as_py(), date))
            if now.bytes >= BUNDLE_BYTES:
                yield out(now)
                now = _Bundle()
    if now.index:
        yield out(now)


def revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html (null for revisits), digest, size, refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # the digest of every row, and of each digest that occurs more than once the largest id: partial maxima
    # combine before the shuffle, and the join's hot digests can be split by adaptive execution
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    best = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    best = best.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").select("digest", "best")
    rows = rows.join(best, "digest", "left")
    refers = F.when(F.col("best").isNotNull() & ((F.col("page_id") != F.col("best")) | F.col("page_id").isNull()), F.col("best"))
    return rows.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "digest", "size", refers.alias("refers"))


def write_bundles(pages: DataFrame, path: str | None = None, least: int = 1000, date: str = DATE) -> str:
    """Write every page's record into bundles; returns the folder of the Parquet table of bundles with their indexes."""
    path = path or f"{shared_dir(pages.sparkSession)}/fallowgrid/warc-{uuid.uuid4().hex}"
    revisits(pages, least).mapInArrow(lambda batches: _pack(batches, date), BUNDLES).write.option("compression", "none").option("parquet.block.size", str(1 << 25)).parquet(path)
    return path


RECORDS = "page_id long, url string, payload binary, digest string, size long, record_type string, refers_to long, bundle string, frame int, offset long, length long"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in RECORDS.split(", ")]
    cols = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _id(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name and name != NO_ID else None


def _entry(bundle: str, frame: int, record: tuple) -> tuple:
    at, size, head, payload = record
    kind = head["WARC-Type"]
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload that its digest doesn't fit")
    return (_id(head["WARC-Record-ID"]), head.get("WARC-Target-URI", ""), payload if kind == "response" else None, digest, int(head["X-Payload-Length"]), kind, _id(head.get("WARC-Refers-To")), bundle, frame, at, size)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        for name, data in zip(batch.column(0), batch.column(1), strict=True):
            data = data.as_buffer()
            view = memoryview(data)
            for k, (start, packed, size) in enumerate(read_seek_table(bytes(view[-9 - 8 * struct.unpack("<I", view[-9:-5])[0] :]))):
                frame = unpacker.decompress(view[start : start + packed], max_output_size=size)
                yield _rows([_entry(name.as_py(), k, r) for r in parse_records(frame)])


def decode_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles under `path`, in one row; payloads are checked against their digests."""
    return spark.read.schema(BUNDLES).parquet(path).select("bundle", "data").mapInArrow(_unpack, RECORDS)


def fetch(spark: SparkSession, path: str, page_ids: DataFrame) -> DataFrame:
    """The records of `page_ids` (one column page_id) by way of the index: only their frames are decompressed."""
    bundles = spark.read.schema(BUNDLES).parquet(path)
    found = bundles.select("bundle", F.explode("records").alias("r")).select("bundle", "r.*").join(page_ids.select("page_id").distinct(), "page_id")
    wanted = found.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("wanted"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, data, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                table, out = read_seek_table(data), []
                for k in sorted({x["frame"] for x in places}):
                    start, packed, size = table[k]
                    frame = unpacker.decompress(data[start : start + packed], max_output_size=size)
                    for x in (x for x in places if x["frame"] == k):
                        _, n, head, payload = next(parse_records(frame[x["offset"] : x["offset"] + x["length"]]))
                        out.append(_entry(name, k, (x["offset"], n, head, payload)))
                yield _rows(out)

    return bundles.select("bundle", "data").join(wanted, "bundle").select("bundle", "data", "wanted").mapInArrow(read, RECORDS)
