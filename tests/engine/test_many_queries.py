"""Batches of queries of any number."""

from __future__ import annotations

import random

import pytest
from loomspark.operators import vectors as V
from pyspark.sql import functions as F


@pytest.mark.parametrize("exclude_self", [False, True])
def test_queries_in_blocks_equal_a_plain_search(spark, monkeypatch, exclude_self):
    monkeypatch.setattr(V, "MAX_QUERIES", 20, raising=False)
    monkeypatch.setattr(V, "BLOCK", 16, raising=False)
    r = random.Random(4)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(4)]) for i in range(70)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = V.topk_batch(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, 5, exclude_self=exclude_self).collect()
    want = set()
    for i, q in rows:
        scored = sorted((-sum(x * y for x, y in zip(q, v)), j) for j, v in rows if not (exclude_self and i == j))[:5]
        want |= {(i, j, -s, rank) for rank, (s, j) in enumerate(scored, 1)}
    assert {(x.query_id, x.vec_id, x.score, x["rank"]) for x in got} == want and len(got) == 350
