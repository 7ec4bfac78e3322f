"""Lexical search by blocks against sums over plain postings."""

from __future__ import annotations

import math
import re
from collections import Counter

from loomspark.functions import text as X
from loomspark.operators import lexical as B
from pyspark.sql import functions as F


def plain(docs, queries, k, k1, b):
    texts = {}
    for key, text in docs:
        texts.setdefault(key, []).append(text)
    words = {key: [w for t in ts if t is not None for w in re.findall(r"\w+", t.lower())] for key, ts in texts.items()}
    longest = {key: max([len(re.findall(r"\w+", t)) for t in ts if t is not None], default=None) for key, ts in texts.items()}
    lengths = [len(re.findall(r"\w+", t)) for _, t in docs if t is not None]
    mean = sum(lengths) / len(lengths)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, text in queries:
        score = {}
        for w in set(re.findall(r"\w+", text.lower())) & set(df):
            for key, ws in words.items():
                if tf := ws.count(w):
                    score[key] = score.get(key, 0.0) + math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * longest[key] / mean))
        ranked = sorted((-round(s, 6), key) for key, s in score.items())[:k]
        out += [(q, key, -s, i + 1) for i, (s, key) in enumerate(ranked)]
    return sorted(out)


def test_blocks_add_up_to_plain_scores(spark, monkeypatch):
    monkeypatch.setattr(B, "DOCS", 7)
    monkeypatch.setattr(B, "QUERIES", 2)
    docs = [(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 9))) for i in range(60)] + [(60, None), (61, ""), (5, "w1 w1 again"), (62, "w3 w6")]
    queries = [(i, f"w{i} w{i + 1} W{i} none") for i in range(7)] + [(9, "nothing"), (10, "")]
    d, q = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(queries, "q int, text string")
    both = B.search_variants(q, d, 4, "q", "text", "id", "text", [(1.5, 0.75), (2.0, 0.4)]).collect()
    for v, (k1, b) in enumerate([(1.5, 0.75), (2.0, 0.4)]):
        assert sorted((r.q, r.id, r.score, r["rank"]) for r in both if r.variant == v) == plain(docs, queries, 4, k1, b)
    assert B.search(q, d, 0, "q", "text", "id", "text").count() == 0


def test_no_row_for_each_pair_of_query_and_document_is_shuffled(spark):
    docs = spark.range(3).select("id", F.lit("a b").alias("text"))
    plan = B.search(spark.range(2).select(F.col("id").alias("q"), F.lit("a").alias("text")), docs, 1, "q", "text", "id", "text")._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "sum(" not in plan.split("== Physical Plan ==")[1]


def test_frequencies_count_documents_once(spark):
    d = spark.createDataFrame([(1, "a a b"), (2, "b"), (3, None)], "id int, text string")
    df, n, mean = B.frequencies(B.token_lists(d, "id", "text"))
    assert (sorted(map(tuple, df.collect())), n, mean) == ([("a", 1), ("b", 2)], 3, 2.0)
    assert B.frequencies(B.token_lists(d.where("false"), "id", "text"))[1:] == (0, None)
    df, n, mean = B.frequencies(B.token_lists(d.withColumn("id", F.lit(1)), "id", "text"))
    assert (sorted(map(tuple, df.collect())), n, mean) == ([("a", 1), ("b", 1)], 3, 2.0)


def test_words_with_and_without_han_characters(spark):
    rows = spark.createDataFrame([("Ab_1 é-x 中文字b2",), ("ß Ab.c",), ("a😀b中",), ("",), (None,)], "t string").select(X.tokens("t").alias("w")).collect()
    assert [r.w for r in rows] == [["ab_1", "é", "x", "中文", "文字", "b2"], ["ß", "ab", "c"], ["a", "b", "中"], [], None]
