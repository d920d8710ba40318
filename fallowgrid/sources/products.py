"""Stored products that know what they were made of.

A product is a table that a function builds from other products and outside tables.  Its fingerprint covers the function's code and constants,
its stated version, and the fingerprints of all it needs (of outside tables: names, sizes and times of their files), so a change
anywhere rebuilds exactly what descends from it, and only when asked for.  A build is written aside, renamed to its
fingerprint, and then named by the product's `_current` file: one that fails leaves what was there.  Versions stay until `prune`, so
`rollback` and a return to earlier inputs cost no build.  `snapshot` records what is current of every product under a tag.

All paths are of Hadoop file systems; the driver handles names and fingerprints only.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Product:
    build: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    version: str = ""


def _code(function: Callable) -> bytes:
    """What a function does: its byte code and constants, and those of functions inside it."""

    def of(code) -> bytes:
        parts = [code.co_code, repr(code.co_names).encode()]
        return b"\0".join([*parts, *(of(c) if hasattr(c, "co_code") else repr(c).encode() for c in code.co_consts)])

    bound = [c.cell_contents for c in function.__closure__ or ()]
    return of(function.__code__) + repr(function.__defaults__).encode() + b"".join(_code(c) if callable(c) and hasattr(c, "__code__") else repr(c).encode() for c in bound)


@dataclass
class Registry:
    spark: SparkSession
    root: str
    outside: Mapping[str, str] = field(default_factory=dict)
    products: dict[str, Product] = field(default_factory=dict)

    def add(self, name: str, needs: Sequence[str] = (), version: str = "") -> Callable:
        """Register a builder: it is called with a DataFrame for each of `needs`, which are products added before or outside tables."""

        def of(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            unknown = [n for n in needs if n not in self.products and n not in self.outside]
            if unknown or name in self.products or name in self.outside:
                raise ValueError(f"{name} needs {unknown}" if unknown else f"{name} is there already")
            self.products[name] = Product(build, tuple(needs), version)
            return build

        return of

    # --- files -----------------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p, jvm

    def _text(self, path: str) -> str | None:
        fs, p, jvm = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        """Write aside and rename over: readers see the old text or the new one."""
        fs, p, jvm = self._fs(path)
        fs.mkdirs(p.getParent())
        aside = jvm.org.apache.hadoop.fs.Path(f"{path}-{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(aside, p)

    def _files(self, path: str) -> list[tuple[str, int, int]]:
        fs, p, _ = self._fs(path)
        out, found = [], fs.listFiles(p, True)
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(out)

    # --- versions ----------------------------------------------------------------------------------

    def fingerprint(self, name: str, known: dict[str, str] | None = None) -> str:
        known = {} if known is None else known
        if name not in known:
            if name in self.outside:
                content = repr(self._files(self.outside[name])).encode()
            else:
                p = self.products[name]
                content = b"\0".join([name.encode(), p.version.encode(), _code(p.build), *(self.fingerprint(n, known).encode() for n in p.needs)])
            known[name] = hashlib.sha256(content).hexdigest()[:32]
        return known[name]

    def current(self, name: str) -> str | None:
        text = self._text(f"{self.root}/{name}/_current")
        return json.loads(text)["version"] if text else None

    def stale(self) -> list[str]:
        """Products whose current version isn't the one that code and inputs call for."""
        known: dict[str, str] = {}
        return [n for n in self.products if self.current(n) != self.fingerprint(n, known)]

    def _has(self, name: str, version: str) -> bool:
        fs, p, jvm = self._fs(f"{self.root}/{name}/{version}/_SUCCESS")
        return fs.exists(p)

    def get(self, name: str, built: list[str] | None = None) -> DataFrame:
        """The product, built first (with what it needs) where inputs or code have changed; `built` collects the names of what was."""
        if name in self.outside:
            return self.spark.read.parquet(self.outside[name])
        version = self.fingerprint(name)
        if not self._has(name, version):
            p = self.products[name]
            aside = f"{self.root}/{name}/_aside-{uuid.uuid4().hex}"
            try:
                p.build(*(self.get(n, built) for n in p.needs)).write.parquet(aside)
            except Exception:
                fs, path, _ = self._fs(aside)
                fs.delete(path, True)
                raise
            fs, path, jvm = self._fs(aside)
            if not fs.rename(path, jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{version}")):
                raise OSError(f"{name} could not be committed")
            if built is not None:
                built.append(name)
        if self.current(name) != version:
            self._put(f"{self.root}/{name}/_current", json.dumps({"version": version}))
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def read(self, name: str) -> DataFrame:
        """The committed version, whatever has changed since."""
        version = self.current(name)
        if version is None:
            raise FileNotFoundError(f"{name} was never built")
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def snapshot(self, tag: str) -> dict[str, str]:
        found = {n: v for n in self.products if (v := self.current(n))}
        self._put(f"{self.root}/_snapshots/{tag}", json.dumps(found))
        return found

    def rollback(self, tag: str) -> dict[str, str]:
        """Make the versions of a snapshot current again; a version that was pruned is an error, and nothing changes then."""
        text = self._text(f"{self.root}/_snapshots/{tag}")
        if text is None:
            raise FileNotFoundError(f"no snapshot {tag}")
        found = json.loads(text)
        gone = [n for n, v in found.items() if not self._has(n, v)]
        if gone:
            raise FileNotFoundError(f"versions of {gone} are gone")
        for n, v in found.items():
            self._put(f"{self.root}/{n}/_current", json.dumps({"version": v}))
        return found

    def prune(self, keep: Sequence[str] = ()) -> list[str]:
        """Delete versions that are neither current nor in one of the named snapshots."""
        kept = {(n, self.current(n)) for n in self.products}
        for tag in keep:
            kept |= set(json.loads(self._text(f"{self.root}/_snapshots/{tag}") or "{}").items())
        out = []
        for n in self.products:
            fs, p, _ = self._fs(f"{self.root}/{n}")
            for f in fs.listStatus(p) if fs.exists(p) else []:
                version = f.getPath().getName()
                if f.isDirectory() and (n, version) not in kept:
                    fs.delete(f.getPath(), True)
                    out.append(f"{n}/{version}")
        return out
