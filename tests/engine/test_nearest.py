"""Products in single precision that leave out pairs find what all products in double precision find."""

from __future__ import annotations

import re

import numpy as np
import pytest
from loomspark.operators import vectors as V
from pyspark.sql import functions as F


def plain(q, v, k, without):
    found = []
    for i, s in enumerate(np.round(q @ v.T, 12)):
        if without is not None:
            s[without[i, 0] : without[i, 1]] = -np.inf
        order = [int(j) for j in np.lexsort((np.arange(len(v)), -s)) if s[j] > -np.inf][:k]
        found += [(i, j) for j in order]
    return found


@pytest.mark.parametrize("seed", range(24))
def test_nearest_of_random_equal_and_blank_vectors(monkeypatch, seed):
    monkeypatch.setattr(V, "SLICE", 16)
    monkeypatch.setattr(V, "CHUNK", 50)
    r = np.random.default_rng(seed)
    n, m, d, k = r.integers(1, 60), r.integers(1, 300), r.integers(1, 20), int(r.integers(1, 8))
    make = (lambda *s: r.integers(-2, 3, size=s) * 1.0) if seed % 3 == 0 else (lambda *s: r.normal(size=s))  # whole numbers tie often
    q, v = make(n, d), make(m, d)
    if seed % 4 == 1:
        v[:] = v[0] + 1e-9 * make(m, d)  # closer than single precision tells
    if seed % 5 == 0:
        q[0] = 0
    if seed % 7 == 0:
        v *= 1e160
    at = r.integers(0, m, size=n)
    without = np.stack([at, np.minimum(m, at + r.integers(0, 4, size=n))], axis=1) if seed % 2 else None
    who, whom, _ = V.nearest(q, v, k, without)
    assert list(zip(who.tolist(), whom.tolist())) == plain(q, v, k, without)


def test_rows_are_copied_less_often_than_there_are_blocks_of_the_least_size(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 2)
    monkeypatch.setattr(V, "NUMBERS", 64)
    rows = [(i, [float((i * j) % 7) for j in range(4)]) for i in range(70)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = V.topk_batch(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, 3, exclude_self=True)
    groups = re.findall(r"RepartitionByExpression \[.*\], (\d+)", got._jdf.queryExecution().optimizedPlan().toString())
    assert groups == ["81", "81"]  # nine blocks a side, not 35
    x = np.array([v for _, v in rows])
    at = np.arange(70)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == sorted((i, 1 + n % 3, j) for n, (i, j) in enumerate(plain(x, x, 3, np.stack([at, at + 1], axis=1))))
