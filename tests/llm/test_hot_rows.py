"""Copies and rows without ids are dealt out like others."""

from __future__ import annotations

import random

from helpers import words
from loomspark.llm import packing, substrings
from loomspark.llm.common import map_rows, saved
from pyspark.sql import functions as F


def sentences(seed):
    r = random.Random(seed)
    return " ".join(f"{' '.join(words(r.randint(21, 25), 100 * seed + k))}." for k in range(6))


def test_hot_runs_of_every_text_are_found(spark):
    texts = [sentences(i) for i in range(6)]
    docs = spark.createDataFrame([(i, texts[i % 6]) for i in range(6 * 600)], "doc_id long, text string").repartition(6)
    rules = substrings.SpanRules(hot=200)
    listed = saved(map_rows(docs, ["text"], lambda c: ([[{"h": h, "g": g, "a": a, "k": k} for h, g, a, k in substrings.runs(t, rules)]] for t in c[0]), "runs array<struct<h:bigint,g:bigint,a:int,k:int>>", keep=["doc_id"]))
    want = {h for t in texts for h, *_ in substrings.runs(t, rules)}
    assert set(substrings.hot_runs(listed, rules)) == want and len(want) > 6
    done = substrings.dedup(docs, rules=rules)
    kept = {r.doc_id: r.text for r in done.where("doc_id < 6").collect()}
    assert kept == {i: texts[i] for i in range(6)}
    assert done.where("doc_id >= 6").agg(F.sum(F.length(F.trim("text")))).first()[0] == 0


def test_pieces_without_ids_are_ranked_in_many_groups(spark):
    rows = spark.range(8_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(700).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    packed = packing.pack(rows)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "ids_crc32" in plan[plan.index("xxhash64") :][:120]
    got = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("d"), F.count("*").alias("c")).collect()
    assert all(r.n <= 2048 and r.d == r.c for r in got) and sum(r.c for r in got) == 8_000 and len(got) == 4_000
    groups = rows.groupBy(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(8))).count().agg(F.max("count")).first()[0]
    assert groups < 1_300


