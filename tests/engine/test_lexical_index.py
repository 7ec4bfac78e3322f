"""A stored lexical index gives the rows of the plain search, and reads what it must."""

from __future__ import annotations

import random
import re

import pytest
from loomspark.operators import lexical, lexical_index
from loomspark.sources import folders


def corpus(n, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(i, " ".join(["the"] * r.randint(0, 4) + r.choices(words, weights, k=r.randint(0, 30)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "the the the")]
    queries = [(q, " ".join(["the"] + r.choices(words, k=r.randint(1, 6)))) for q in range(25)] + [(25, "unknown"), (26, ""), (27, None), (28, "the"), (29, "w0 the")]
    return docs, queries


def rows(df):
    return sorted((r.q, r.id, r.score, r.rank) for r in df.collect())


@pytest.mark.parametrize("k, block, shard_docs", [(1, 4, 40), (5, 8, 1000), (10, 2, 60), (500, 16, 100)])
def test_same_rows_as_the_plain_search(spark, tmp_path, k, block, shard_docs):
    docs, queries = corpus(300)
    d, q = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(queries, "q int, text string")
    index = lexical_index.save(d, str(tmp_path / "i"), "id", "text", buckets=8, block=block, shard_docs=shard_docs)
    assert index == lexical_index.load(spark, str(tmp_path / "i"))
    assert rows(lexical_index.search(index, q, k, "q", "text")) == rows(lexical.search(q, d, k, "q", "text", "id", "text"))


def test_no_documents_and_no_results(spark, tmp_path):
    d = spark.createDataFrame([], "id int, text string")
    q = spark.createDataFrame([(1, "a")], "q int, text string")
    index = lexical_index.save(d, str(tmp_path / "i"), "id", "text")
    assert lexical_index.search(index, q, 3, "q", "text").collect() == []
    assert lexical_index.search(index, q, 0, "q", "text").collect() == []
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        lexical_index.save(d, str(tmp_path / "i"), "id", "text")


def test_layout(spark, tmp_path):
    docs, _ = corpus(400)
    index = lexical_index.save(spark.createDataFrame(docs, "id int, text string"), str(tmp_path / "i"), "id", "text", buckets=8, block=8, shard_docs=50)
    lists = index.table(spark, "postings")
    the = lists.where("token = 'the'")
    assert index.shards == 9
    assert the.select("shard").distinct().count() == 9  # a stop word's list is dealt out
    assert the.agg({"n": "max"}).first()[0] <= 8
    # Blocks of a shard fall in score, and the first has the token's greatest in it.
    for s in range(9):
        tops = [r.top for r in the.where(f"shard = {s}").orderBy("block").collect()]
        assert tops == sorted(tops, reverse=True)


def test_only_the_asked_buckets_are_scanned(spark, tmp_path):
    docs, _ = corpus(60)
    index = lexical_index.save(spark.createDataFrame(docs, "id int, text string"), str(tmp_path / "i"), "id", "text", buckets=32)
    q = spark.createDataFrame([(1, "w1")], "q int, text string")
    asked, places = lexical_index.asked_tokens(index, q, "q", "text")
    assert len(places) == 1
    plan = lexical_index.search(index, q, 3, "q", "text")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x]
    assert scans and all(re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {places[0]}\b", x) for x in scans)
    assert not any("/docs" in x for x in scans)  # documents are not tokenised again


def test_blocks_that_cannot_enter_are_skipped(spark, tmp_path):
    # One document says the rare word, and all say the common one: its list is optional and no block beyond the first is met.
    docs = [(i, "common " * (1 + i % 3) + "filler " * (i % 7)) for i in range(600)] + [(600, "rare common")]
    d = spark.createDataFrame(docs, "id int, text string")
    q = spark.createDataFrame([(1, "rare common")], "q int, text string")
    index = lexical_index.save(d, str(tmp_path / "i"), "id", "text", block=16)
    found = lexical_index.search(index, q, 1, "q", "text")
    assert rows(found) == rows(lexical.search(q, d, 1, "q", "text", "id", "text"))
    assert [r.id for r in found.collect()] == [600]


def test_point_lookup(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, f"text {i}") for i in range(500)] + [(7, "again"), (None, "no key")]
    r.shuffle(rows)
    path = str(tmp_path / "t")
    folders.save_by_key(spark.createDataFrame(rows, "id int, text string"), path, "id", buckets=16)
    one = folders.lookup(spark, path, "id", [7], buckets=16)
    assert sorted(x.text for x in one.collect()) == ["again", "text 7"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+\)", plan) and "EqualTo(id,7)" in plan
    assert folders.lookup(spark, path, "id", [None, 9999], buckets=16).collect() == []
    many = folders.lookup_many(spark, path, spark.createDataFrame([(3,), (None,), (3,), (499,)], "id int"), "id", buckets=16)
    assert sorted(x.text for x in many.collect()) == ["text 3", "text 499"]


def test_blocks_of_postings_move_and_not_postings_of_queries(spark, tmp_path, monkeypatch):
    # Small blocks of queries and of counted tokens, and a key with two rows.
    monkeypatch.setattr(lexical_index, "QUERIES", 7)
    monkeypatch.setattr(lexical_index, "TOKENS", 50)
    docs, queries = corpus(80)
    d, q = spark.createDataFrame([*docs, (5, "w0 w1 the the")], "id int, text string"), spark.createDataFrame(queries, "q int, text string")
    index = lexical_index.save(d, str(tmp_path / "i"), "id", "text", buckets=4, block=4, shard_docs=30)
    found = lexical_index.search(index, q, 3, "q", "text")
    plan = found._jdf.queryExecution().toString()
    assert plan.count("FlatMapCoGroupsInArrow") and "explode(postings" not in plan
    assert rows(found) == rows(lexical.search(q, d, 3, "q", "text", "id", "text"))
