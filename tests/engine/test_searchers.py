"""Searchers of a folder, pools, appended vectors, shards."""

from __future__ import annotations

import sys

import numpy as np
import pytest
from loomspark.operators import lexical, lexical_index, models
from loomspark.operators import searchers as S
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


class Letters:
    """Vectors from words, so that results can be told by hand."""

    WORDS = ("red", "sea", "dragon", "king")

    def encode(self, texts):
        return np.array([[t.split().count(w) for w in self.WORDS] for t in texts], dtype=np.float32)


BOOKS = [("a", "red dragon king"), ("b", "sea sea red"), ("c", "king king dragon sea"), ("d", "dragon"), ("e", "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("indexes"))
    books = spark.createDataFrame(BOOKS, "novel_id string, text string")
    sections = books.select("novel_id", F.posexplode(F.split("text", " ")).alias("ordinal", "word"))
    encode = models.encoder_udf(Letters)
    sections.select("novel_id", F.when(F.col("ordinal") == 0, "blurb").otherwise("middle").alias("kind"), "ordinal", encode("word").alias("embedding")).write.parquet(f"{path}/multi")
    books.select("novel_id", encode("text").alias("embedding")).write.parquet(f"{path}/one/single")
    lexical_index.save(books, f"{path}/lexical", "novel_id", "text")
    return path


QUERIES = [("q", "dragon red"), ("r", "sea"), ("s", "  "), ("t", "king unheard")]


def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id string, query string")


def unit(v):
    return v / (np.linalg.norm(v) or 1)


def test_searchers_of_a_folder(spark, folder):
    found = S.load(spark, folder, Letters, label="x")
    assert [s.name for s in found] == ["x/dense_multi", "x/bm25", "x/hybrid_rrf"]
    assert [s.name for s in S.load(spark, f"{folder}/one", Letters)] == ["one/dense_single"]
    with pytest.raises(ValueError, match="encoder"):
        S.load(spark, folder)
    with pytest.raises(FileNotFoundError):
        S.load(spark, f"{folder}/multi")


@pytest.mark.parametrize("k", [1, 2, 10])
def test_dense_equals_brute_force(spark, folder, k):
    enc = Letters()
    multi, single = S.load(spark, folder, Letters)[0], S.load(spark, f"{folder}/one", Letters)[0]
    got = {(r.query_id, r["rank"]): (r.novel_id, round(r.score, 5)) for r in multi.search(queries(spark), k).collect()}
    one = {(r.query_id, r["rank"]): (r.novel_id, round(r.score, 5)) for r in single.search(queries(spark), k).collect()}
    want, want_one = {}, {}
    for q, text in QUERIES:
        if text.strip():
            v = unit(enc.encode([text])[0])
            best = lambda t: max(float(unit(enc.encode([w])[0]) @ v) for w in t.split(" "))
            for out, score in ((want, best), (want_one, lambda t: float(unit(enc.encode([t])[0]) @ v))):
                rows = sorted((-round(score(t), 5), b) for b, t in BOOKS)[:k]
                out |= {(q, i + 1): (b, -s) for i, (s, b) in enumerate(rows)}
    assert got == want and one == want_one


def test_pool_of_all_searchers(spark, folder, tmp_path):
    found = S.load(spark, folder, Letters, label="x")
    rows, took = S.build_pool(found, queries(spark), 3, str(tmp_path / "pool"))
    assert set(took) == {s.name for s in found} and all(v > 0 for v in took.values())
    seen = {c: {(r.query_id, r["rank"], r.novel_id) for r in rows.where(F.col("config") == c).collect()} for c in took}
    books = spark.createDataFrame(BOOKS, "novel_id string, text string")
    direct = lexical.search(queries(spark), books, 100, "query_id", "query", "novel_id", "text")
    assert seen["x/bm25"] == {(r.query_id, r["rank"], r.novel_id) for r in direct.where("rank <= 3").collect()}
    fused = lexical.fuse([found[0].search(queries(spark), 100), direct], ["query_id"], "novel_id").where("rank <= 3")
    assert seen["x/hybrid_rrf"] == {(r.query_id, r["rank"], r.novel_id) for r in fused.collect()}
    assert {r.section_kind for r in rows.where("config = 'x/dense_multi'").collect()} <= {"blurb", "middle"}
    with pytest.raises(ValueError, match="names"):
        S.build_pool(found[:1] * 2, queries(spark), 3, str(tmp_path / "two"))


def test_append_vectors(spark, tmp_path):
    path = str(tmp_path / "v")
    make = lambda rows: spark.createDataFrame(rows, "novel_id string, ordinal int, embedding array<float>")
    make([("a", 0, [1.0, 0.0])]).write.parquet(path)
    assert S.append_vectors(path, make([("a", 1, [0.0, 1.0]), ("b", 0, [1.0, 1.0])]), ["novel_id", "ordinal"]) == 2
    bad = [[("c", 0, [1.0])], [("c", 0, [float("nan"), 0.0])], [("c", 0, None)], [(None, 0, [1.0, 0.0])], [("b", 0, [1.0, 0.0])], [("c", 0, [1.0, 0.0]), ("c", 0, [0.0, 1.0])]]
    for rows in bad:
        with pytest.raises(ValueError):
            S.append_vectors(path, make(rows), ["novel_id", "ordinal"])
    with pytest.raises(ValueError, match="ordinal"):
        S.append_vectors(path, make([]).drop("ordinal"), ["novel_id"])
    assert spark.read.parquet(path).count() == 3 and S.append_vectors(path, make([]), ["novel_id", "ordinal"]) == 0


def test_shards_equal_one_and_restart_whole(spark, tmp_path):
    texts = spark.createDataFrame([(i, None if i == 5 else f"red sea {'king ' * (i % 4)}") for i in range(200)], "novel_id long, text string").repartition(4)
    whole = {r.novel_id: r.embedding for r in S.encode_in_shards(texts, lambda _: Letters(), 1).collect()}
    calls = tmp_path / "calls"
    calls.mkdir()

    def make(shard):
        n = len(list(calls.glob(f"{shard}-*")))
        (calls / f"{shard}-{n}").touch()
        if shard == 1 and n == 0:
            raise RuntimeError("the device is gone")
        return Letters()

    rows = S.encode_in_shards(texts, make, 3).collect()
    assert {r.novel_id: r.embedding for r in rows} == whole and len(rows) == 200
    assert [r.novel_id for r in rows] == list(range(200)) and [r.shard for r in rows] == sorted(r.shard for r in rows)  # contiguous, in order
    assert {r.shard for r in rows} == {0, 1, 2} and len(list(calls.glob("1-*"))) == 2
    with pytest.raises(ValueError):
        S.encode_in_shards(texts, make, 0)
