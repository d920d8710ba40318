"""Products: rebuilt exactly where something changed, committed whole, rolled back."""

import pytest
from pyspark.sql import functions as F

from fallowgrid.sources import products


def _registry(spark, tmp_path, factor=2, broken=False):
    r = products.Registry(spark, f"file://{tmp_path}/products", {"cells": f"file://{tmp_path}/cells", "side": f"file://{tmp_path}/side"})

    @r.add("doubled", ["cells"])
    def doubled(cells):
        return cells.select("id", (F.col("v") * factor).alias("v"))

    @r.add("sides", ["side"])
    def sides(side):
        return side.select("id", F.col("v").alias("w"))

    @r.add("joined", ["doubled", "sides"])
    def joined(a, b):
        out = a.join(b, "id")
        return out.withColumn("v", F.raise_error(F.lit("broken")).cast("long")) if broken else out

    return r


def _write(spark, tmp_path, name, add):
    spark.range(5).select("id", (F.col("id") + add).alias("v")).write.mode("overwrite").parquet(f"file://{tmp_path}/{name}")


def test_only_descendants_are_rebuilt(spark, tmp_path):
    for name in ("cells", "side"):
        _write(spark, tmp_path, name, 0)
    r, built = _registry(spark, tmp_path), []
    assert r.stale() == ["doubled", "sides", "joined"] and r.get("joined", built).agg(F.sum("v"), F.sum("w")).first() == (20, 10)
    assert built == ["doubled", "sides", "joined"] and r.stale() == []
    r.get("joined", built)
    assert len(built) == 3
    first = r.snapshot("one")
    _write(spark, tmp_path, "side", 10)
    assert r.stale() == ["sides", "joined"]
    built.clear()
    assert r.get("joined", built).agg(F.sum("w")).first()[0] == 60 and built == ["sides", "joined"]
    # changed code rebuilds its own product and what needs it; the old code finds its versions again
    other, built = _registry(spark, tmp_path, factor=3), []
    assert other.stale() == ["doubled", "joined"] and other.get("joined", built).agg(F.sum("v")).first()[0] == 30 and built == ["doubled", "joined"]
    built.clear()
    assert r.get("joined", built).agg(F.sum("v")).first()[0] == 20 and built == []
    # a failed build leaves the committed version
    bad = _registry(spark, tmp_path, broken=True)
    with pytest.raises(Exception, match="broken"):
        bad.get("joined")
    assert bad.read("joined").agg(F.sum("w")).first()[0] == 60
    assert r.rollback("one") == first and r.read("joined").agg(F.sum("w")).first()[0] == 10
    assert len(r.prune(["one"])) >= 2 and r.read("joined").count() == 5
    with pytest.raises(FileNotFoundError):
        r.rollback("never")


def test_registration_is_checked(spark, tmp_path):
    r = _registry(spark, tmp_path)
    for name, needs in (("x", ["absent"]), ("joined", ["cells"]), ("cells", [])):
        with pytest.raises(ValueError):
            r.add(name, needs)(lambda *a: a[0])
    with pytest.raises(FileNotFoundError):
        r.read("joined")


def test_stored_tables_are_released(spark):
    from fallowgrid.sources import tables

    tables.release(spark)
    a, b = tables.stored(spark.range(3), "a"), tables.stored(spark.range(4), "b")
    assert a.count() + b.count() == 7
    tables.dropped(a)
    assert tables.release(spark) == 1 and tables.release(spark) == 0
    with pytest.raises(Exception, match=r"PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        b.count()
