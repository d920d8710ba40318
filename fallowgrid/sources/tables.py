"""Readers and writers: tables, search paths, cached-or-built products, configuration, CSV and JSON sinks."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def between(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Half-open range of instants; the predicate reaches the Parquet scan."""
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))


def first_csv(spark: SparkSession, folders: Sequence[str], name: str, schema: StructType | str) -> DataFrame:
    """CSV with a header from the first folder that has it."""
    for folder in folders:
        try:
            return spark.read.csv(f"{folder}/{name}", header=True, schema=schema)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"{name} in none of {list(folders)}")


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """The product under `path`, built and written first where it is absent (or `fresh`)."""
    if not fresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@lru_cache
def config(path: str) -> dict:
    """A JSON or (with PyYAML at hand) YAML file."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


_ENTRY = re.compile(r"""( *)((?:"[^"]*"|'[^']*'|[^\s#:'"-][^:#]*)):([ \t]*)("[^"]*"|'[^']*'|[^#\n]*?)([ \t]*(?:#.*)?)\n?""")


def rewritten(text: str, changes: Mapping[tuple[str, ...], object]) -> str:
    """YAML block mappings with the scalars at the given paths replaced; comments, order and layout stay.

    A key that its mapping lacks becomes its first entry; a path without its mapping is an error.
    """
    lines, left, path, seen = text.splitlines(keepends=True), dict(changes), [], {}
    for at, line in enumerate(lines):
        if not (m := _ENTRY.fullmatch(line)):
            continue
        indent = len(m[1])
        while path and path[-1][0] >= indent:
            path.pop()
        path.append((indent, m[2].strip("\"'")))
        key = tuple(k for _, k in path)
        seen[key] = (at, indent)
        if key in left:
            lines[at] = f"{m[1]}{m[2]}:{m[3] or ' '}{json.dumps(left.pop(key), ensure_ascii=False)}{m[5]}\n"
    for key, value in sorted(left.items(), key=lambda x: -seen.get(x[0][:-1], (0, 0))[0]):
        if key[:-1] not in seen:
            raise KeyError(f"no mapping {'.'.join(key[:-1])}")
        at, indent = seen[key[:-1]]
        lines[at] = lines[at].rstrip("\n") + f"\n{' ' * (indent + 2)}{key[-1]}: {json.dumps(value, ensure_ascii=False)}\n"
    return "".join(lines)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file: for report tables of a few rows only."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def latest(df: DataFrame, key: str, priority: str, value: str) -> DataFrame:
    """Mosaic: of the layers of a cell, the valid value with the highest priority."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, priority).alias(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a fresh one where unset on a single machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fallowgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that `stored` wrote in this process and nobody dropped yet.
_OWNED: list[str] = []


def stored(df: DataFrame, tag: str) -> DataFrame:
    """`df` written once to the shared folder and read back: all that is derived from it sees the same rows.

    It stays until `dropped`, or until `release` at the end of the work that derives from it.
    """
    path = f"{shared_dir(df.sparkSession)}/fallowgrid/{tag}-{uuid.uuid4().hex}"
    _OWNED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Delete all that `stored` wrote in this process, once no result that derives from it is wanted any more; how many folders went."""
    n = len(_OWNED)
    while _OWNED:
        _delete(spark, _OWNED.pop())
    return n


def dropped(df: DataFrame) -> None:
    """Delete what `stored` wrote, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _OWNED[:] = [p for p in _OWNED if p.rpartition("/")[2] != folder.rpartition("/")[2]]
        _delete(df.sparkSession, folder)
