"""Shared pieces: reading tables, cutting lineage, numpy text kernels, components.

Nothing here keeps state between queries.  Functions that run in Python workers
take Arrow batches and work on blocks of a few megabytes, whatever the batch is.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 21
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a fresh one where unset on a single machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fallowgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """`df` written to the shared folder and read back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fallowgrid/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete what `stored` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- Arrow text columns as byte buffers ---------------------------------------------------------


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the offsets of each (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES):
    """Yield (batch slice, bytes, offsets) of about `limit` bytes; a longer text is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at), buf[off[at] : off[end]], off[at : end + 1] - off[at]
            at = end


# --- hashes --------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240117)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
BYTE_CODE2 = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
BASE, BASE2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: U64, n: int) -> np.ndarray:
    """The first n powers; those for blocks of the usual size are kept by a worker."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        out = np.full(max(n, 1 << 16), base, U64)
        out[0] = U64(1)
        known = np.multiply.accumulate(out)
        if n <= 1 << 22:
            _POWERS[int(base)] = known
    return known[:n]


class Rolling:
    """Polynomial fingerprints of any substring of a block of bytes (or of character codes), modulo 2^64."""

    def __init__(self, buf: np.ndarray, code: np.ndarray = BYTE_CODE, base: U64 = BASE):
        with np.errstate(over="ignore"):
            n = len(buf)
            self.back = _powers(U64(pow(int(base), -1, 2**64)), n + 1)
            self.sums = np.zeros(n + 1, U64)
            np.cumsum((code[buf] if buf.dtype == np.uint8 else mix(buf.astype(U64) + code[1])) * _powers(base, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def grams(self, k: int) -> np.ndarray:
        """Of every substring of k bytes, by its start."""
        return (self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k]


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


# --- words ---------------------------------------------------------------------------------------

#: Words of the similarity operators: runs of ASCII letters (case-folded), digits and non-ASCII bytes.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a folded block, and for each text the index of its first word."""
    inside = IS_WORD[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, off: np.ndarray):
    """(hash of each word, index of each text's first word, starts, ends)."""
    buf = FOLD[buf]
    starts, ends, at = word_bounds(buf, off)
    return mix(Rolling(buf).of(starts, ends)), at, starts, ends


def shingles(words: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word k-grams text by text and their offsets; a shorter text with words has one, of all its words."""
    n = np.diff(at)
    if len(words) >= k:
        grams = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            grams = grams * U64(0x9FB21C651E98DF25) + words[i : len(words) - k + 1 + i]
        grams = mix(grams)
    else:
        grams = np.empty(0, U64)
    size = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_off = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(out_off[-1], U64)
    long = n >= k
    pick = ranges(at[:-1][long], n[long] - k + 1)
    out[ranges(out_off[:-1][long], n[long] - k + 1)] = grams[pick]
    for i in np.flatnonzero((n > 0) & ~long):
        h = np.array([n[i]], U64)
        for x in words[at[i] : at[i + 1]]:
            h = h * U64(0x9FB21C651E98DF25) + x
        out[out_off[i]] = mix(h)[0]
    return out, out_off


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+size[0]-1, start[1] .. and so on, in one array."""
    total = int(size.sum())
    out = np.ones(total, np.int64)
    keep = size > 0
    start, size = start[keep], size[keep]
    if not len(size):
        return out[:0]
    heads = np.concatenate([[0], np.cumsum(size)[:-1]])
    out[heads[0]] = start[0]
    out[heads[1:]] = start[1:] - (start[:-1] + size[:-1] - 1)
    return np.cumsum(out)


def list_array(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))


# --- connected components --------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(id, root): the smallest id of the component of every id in `edges`, by alternating large and small stars.

    Each round is one aggregation with map-side combining, and joins that adaptive execution can split;
    the edges stay in the shared folder between rounds.  Rounds go on until nothing changes (about the square of
    the logarithm of the largest component); over `rounds` of them are an error.
    """
    e = stored(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct(), "edges")

    def tally(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = tally(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u go to u's smallest
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after_df = stored(small, "edges")
        after = tally(after_df)
        old, e = e, after_df
        drop_stored(old)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("id"), "root").union(stars.select(F.col("root").alias("id"), "root").distinct())


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of a sorted partition, each whole, though it spans batches."""
    held: list[pa.RecordBatch] = []

    def code(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = code(batch)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        if held and (at[0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = at[-1]
    if held:
        yield pa.Table.from_batches(held)
