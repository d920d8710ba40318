"""Archives of map tiles as a Spark data source, written in two phases.

An archive is a folder: parts of tiles in the order of their numbers, each with a directory at its end, and `_current`, which names the parts of
the last committed write with their ranges of numbers.  Tasks write their parts under the job's own name; the commit writes a new `_current` in one
move, so readers see the old archive or the new one, and the parts of failed or repeated attempts and of the replaced archive go.  A reader plans
one partition per part whose range the pushed bounds on `id` meet, and reads only the tiles within them.

    register(spark)
    tiles.repartitionByRange(8, "id").sortWithinPartitions("id").write.format("tile_archive").mode("overwrite").save(path)
    spark.read.format("tile_archive").load(path).where("id >= 21 AND id < 85")

Paths are those of a shared file system that pyarrow opens (a mounted folder, or a scheme it knows).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

MAGIC = b"TILES001"
_COLUMNS = ("id", "z", "x", "y")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    name: str
    low: int
    high: int
    tiles: int


@dataclass
class Range(InputPartition):
    name: str
    low: int | None
    high: int | None


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        where, root = _opened(self.path)
        context = TaskContext.get()
        name = f"{self.job}-{context.partitionId():05}-{context.taskAttemptId()}.part"
        where.create_dir(root, recursive=True)
        entries: list[tuple[int, int, int, int, int, int]] = []
        at = len(MAGIC)
        with where.open_output_stream(f"{root}/{name}") as out:
            out.write(MAGIC)
            for batch in iterator:
                own = [batch.column(batch.schema.get_field_index(c)) for c in (*_COLUMNS, "data")]
                for i, z, x, y, data in zip(*(c.to_pylist() for c in own), strict=True):
                    if entries and entries[-1][0] >= i:
                        raise ValueError("tiles of a partition must be sorted by their numbers, each once")
                    out.write(data)
                    entries.append((i, z, x, y, at, len(data)))
                    at += len(data)
            out.write(np.array(entries, "<i8").tobytes())
            out.write(np.array([at, len(entries)], "<i8").tobytes() + MAGIC)
        return Part(name, entries[0][0] if entries else 0, entries[-1][0] if entries else -1, len(entries))

    def commit(self, messages: list[Part | None]) -> None:
        where, root = _opened(self.path)
        parts = sorted((m for m in messages if m is not None and m.tiles), key=lambda m: (m.low, m.name))
        if not self.overwrite:
            parts = sorted([*committed(self.path), *parts], key=lambda m: (m.low, m.name))
        if any(a.high >= b.low for a, b in zip(parts, parts[1:], strict=False)):
            self._drop(lambda name: name.startswith(self.job))
            raise ValueError("ranges of tile numbers overlap: deal tiles out by ranges of `id`")
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/_next-{self.job}") as out:
            out.write(json.dumps([[m.name, m.low, m.high, m.tiles] for m in parts]).encode())
        where.move(f"{root}/_next-{self.job}", f"{root}/_current")
        named = {m.name for m in parts}
        self._drop(lambda name: name.endswith(".part") and name not in named)

    def abort(self, messages: list[Part | None]) -> None:
        self._drop(lambda name: self.job in name)

    def _drop(self, which) -> None:
        where, root = _opened(self.path)
        for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if which(f.base_name):
                where.delete_file(f.path)


def committed(path: str) -> list[Part]:
    where, root = _opened(path.rstrip("/"))
    if where.get_file_info(f"{root}/_current").type == fs.FileType.NotFound:
        return []
    with where.open_input_stream(f"{root}/_current") as f:
        return [Part(*row) for row in json.loads(f.read())]


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.low, self.high = path.rstrip("/"), None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("id",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan)
                self.low = low if self.low is None else max(self.low, low)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                high = f.value - isinstance(f, LessThan)
                self.high = high if self.high is None else min(self.high, high)

    def partitions(self) -> list[Range]:
        met = [p for p in committed(self.path) if (self.low is None or p.high >= self.low) and (self.high is None or p.low <= self.high)]
        return [Range(p.name, self.low, self.high) for p in met] or [Range("", None, None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        where, root = _opened(self.path)
        with where.open_input_file(f"{root}/{partition.name}") as f:
            size = f.size()
            at, n = np.frombuffer(f.read_at(16, size - 16 - len(MAGIC)), "<i8").tolist()
            entries = np.frombuffer(f.read_at(48 * n, at), "<i8").reshape(n, 6)
            a = 0 if partition.low is None else int(np.searchsorted(entries[:, 0], partition.low))
            b = n if partition.high is None else int(np.searchsorted(entries[:, 0], partition.high, "right"))
            for some in (entries[i : min(i + 256, b)] for i in range(a, b, 256)):
                data = [f.read_at(int(e[5]), int(e[4])) for e in some]
                yield pa.RecordBatch.from_arrays([pa.array(some[:, 0]), *(pa.array(some[:, k].astype(np.int32)) for k in (1, 2, 3)), pa.array(data, pa.binary())], names=[*_COLUMNS, "data"])


class TileArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tile_archive"

    def schema(self) -> str:
        return "id long, z int, x int, y int, data binary"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, which must let filters reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileArchive)
