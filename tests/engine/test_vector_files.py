"""Flat vector files: round trips by ranges, and what is refused."""

from __future__ import annotations

import os
import struct

import numpy as np
import pytest
from loomspark.sources import vector_files as V
from pyspark.sql import functions as F


def vectors(spark, n=250, dim=5):
    x = np.random.default_rng(1).normal(size=(n, dim)).astype(np.float32)
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row long, embedding array<float>")


def test_round_trip_over_several_tasks(spark, tmp_path):
    x, df = vectors(spark)
    path = f"file://{tmp_path}/sub/flat.index"
    head = V.save_flat_index(df.repartition(7, F.rand(3)), path)
    assert head == V.head_of(path) == V.FlatHead(5, 250, "inner_product")
    assert os.listdir(tmp_path / "sub") == ["flat.index"]
    back = V.load_flat_index(spark, path, rows=40)
    assert back.rdd.getNumPartitions() == 7
    rows = back.collect()
    assert [r.row for r in rows] == list(range(250))  # order is kept
    assert np.array_equal(np.array([r.embedding for r in rows], dtype=np.float32), x)


def test_bytes_of_the_layout(spark, tmp_path):
    _, df = vectors(spark, 1, 2)
    V.save_flat_index(df.withColumn("embedding", F.expr("array(float(1), float(-2))")), str(tmp_path / "f"), metric="l2")
    assert (tmp_path / "f").read_bytes() == b"IxF2" + struct.pack("<iqqqBiQff", 2, 1, 1 << 20, 1 << 20, 1, 1, 2, 1.0, -2.0)


def test_an_empty_index(spark, tmp_path):
    _, df = vectors(spark)
    V.save_flat_index(df.where("false"), str(tmp_path / "f"))
    assert V.load_flat_index(spark, str(tmp_path / "f")).collect() == []


def test_an_existing_file_stays(spark, tmp_path):
    _, df = vectors(spark, 3)
    path = str(tmp_path / "f")
    V.save_flat_index(df, path)
    with pytest.raises(Exception, match="exists already"):
        V.save_flat_index(df, path)
    V.save_flat_index(df.where("row < 2"), path, overwrite=True)
    assert V.load_flat_index(spark, path).count() == 2


@pytest.mark.parametrize("change", [lambda b: b[:-1], lambda b: b + b"x", lambda b: b[:20], lambda b: b"JUNK" + b[4:], lambda b: b[:4] + struct.pack("<i", 4) + b[8:]])
def test_other_files_are_refused(spark, tmp_path, change):
    _, df = vectors(spark, 4)
    path = tmp_path / "f"
    V.save_flat_index(df, str(path))
    path.write_bytes(change(path.read_bytes()))
    with pytest.raises(ValueError):
        V.load_flat_index(spark, str(path))


@pytest.mark.parametrize("rows", [[(0, [1.0, 2.0]), (1, [1.0])], [(0, [1.0]), (2, [1.0])], [(0, [1.0]), (1, None)], [(0, [1.0]), (2, [3.0]), (2, [1.0])]])
def test_bad_rows_leave_no_file(spark, tmp_path, rows):
    with pytest.raises(Exception):
        V.save_flat_index(spark.createDataFrame(rows, "row long, embedding array<float>"), str(tmp_path / "f"))
    assert os.listdir(tmp_path) == []


def test_other_stores_are_refused(spark):
    with pytest.raises(ValueError, match="mount"):
        V.head_of("hdfs://somewhere/f")
