"""Pooled indexes of many weight sets from one pass."""

from __future__ import annotations

import numpy as np
import pytest
from loomspark.operators import sweep as W
from loomspark.operators import vectors as V

CONFIGS = {
    "plain": {},
    "weighted": {"weights": {"blurb": 3.0, "middle": 0.5, "card": 0.0}},
    "by_kind": {"weights": {"blurb": 3.0, "middle": 0.5, "card": 0.0}, "kind_mean": True},
    "nothing": {"weights": {"blurb": 0.0, "middle": 0.0, "card": 0.0}},
}


def sections(spark):
    r = np.random.default_rng(2)
    rows = [(int(b), k, [float(x) for x in r.normal(size=6)]) for b in range(20) for k in r.choice(["blurb", "middle", "card"], size=r.integers(1, 7))]
    rows += [(99, "card", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (98, "middle", [0.0] * 6)]
    return spark.createDataFrame(rows, "book int, kind string, embedding array<float>")


def by_book(df):
    return {r.book: np.array(r.embedding) for r in df.collect()}


@pytest.mark.parametrize("name", CONFIGS)
def test_equals_pooling_the_sections(spark, name):
    s, c = sections(spark), CONFIGS[name]
    want = by_book(V.pool_books(s, "book", "kind", **c))
    got = by_book(W.pooled(W.kind_sums(s, "book", "kind"), "book", **c))
    assert got.keys() == want.keys()
    for b in want:
        assert np.allclose(got[b], want[b], atol=1e-9)


def test_sections_are_read_once_and_what_is_built_is_skipped(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    s = sections(spark)
    n = s.count()
    counted = s.mapInArrow(count, s.schema)
    out = str(tmp_path / "o")
    assert W.sweep(counted, out, CONFIGS, "book", "kind", only="plain") == (["plain"], [])
    assert W.sweep(counted, out, CONFIGS, "book", "kind") == (["weighted", "by_kind", "nothing"], ["plain"])
    assert W.sweep(counted, out, CONFIGS, "book", "kind") == ([], list(CONFIGS))
    assert read.value == n
    (tmp_path / "o" / "by_kind" / "_SUCCESS").unlink()  # a build that was broken off
    assert W.sweep(counted, out, CONFIGS, "book", "kind") == (["by_kind"], ["plain", "weighted", "nothing"])
    assert by_book(spark.read.parquet(f"{out}/by_kind")).keys() == by_book(V.pool_books(s, "book", "kind")).keys()
    with pytest.raises(ValueError, match="none of"):
        W.sweep(counted, out, CONFIGS, "book", "kind", only="other")
