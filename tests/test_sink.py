"""Upserts that are cut off, repeated and narrow."""

import glob

import pytest
from pyspark.sql import functions as F

from kgloom.sources import sink

SCHEMA = "id string, n long, note string"


def summed(old, new):
    return old.unionByName(new).groupBy("id").agg(F.sum("n").alias("n"), F.max("note").alias("note"))


def files(path):
    return {p.split("bucket=")[1] for p in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_upsert(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put = lambda rows, k: sorted(map(tuple, sink.upsert(path, spark.createDataFrame(rows, SCHEMA), ["id"], summed, k, 8).collect()), key=str)
    assert put([], 0) == []
    first = put([(f"k{i}", 1, "a") for i in range(40)] + [("k0", 1, "b"), (None, 5, None)], 1)
    assert len(first) == 41 and ("k0", 2, "b") in first and (None, 5, None) in first
    before = files(path)
    second = put([("k1", 10, "c")], 2)
    assert ("k1", 11, "c") in second and len(second) == 41
    # one partition was rewritten, the others' files are the same
    assert len(before - files(path)) == 1 and len(files(path) - before) == 1
    assert put([("k1", 10, "c")], 2) == second and put([("k2", 7, "z")], 1) == second

    def crash(*_):
        raise RuntimeError("lost")

    # cut off before it is published: nothing has changed; then it comes again
    batch = [("k1", 100, "d"), ("new", 1, "d")]
    with monkeypatch.context() as m:
        m.setattr(sink, "publish", crash)
        with pytest.raises(RuntimeError):
            put(batch, 3)
    assert sorted(map(tuple, sink.stored(spark, path, spark.createDataFrame([], SCHEMA).schema).select("id", "n", "note").collect()), key=str) == second
    third = put(batch, 3)
    assert ("k1", 111, "d") in third and ("new", 1, "d") in third and put(batch, 3) == third

    # cut off while it is published: some partitions have the batch already
    def half(rows, at):
        real(rows.where(F.col("bucket") == rows.agg(F.min("bucket")).head()[0]), at)
        crash()

    real, batch = sink.publish, [(f"k{i}", 1000, "e") for i in range(8)]
    with monkeypatch.context() as m:
        m.setattr(sink, "publish", half)
        with pytest.raises(RuntimeError):
            put(batch, 4)
    got = dict((r[0], r[1]) for r in put(batch, 4))
    assert [got[f"k{i}"] for i in range(9)] == [1002, 1111, *[1001] * 6, 1]
    # the mark of another batch is no mark of this one
    assert dict((r[0], r[1]) for r in put([("k8", 5, "")], 6))["k8"] == 6
