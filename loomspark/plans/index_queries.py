"""Queries over stored indexes and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical_index as I
from ..operators import searchers as R
from ..operators import segmentation as S
from ..sources import folders
from .base import query, table
from .search_queries import BM


@query("""
WITH RECURSIVE c AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS word FROM part) GROUP BY 1),
t AS (SELECT -ln(sum(n)) AS least FROM c), m AS (SELECT map(list(word), list(ln(n) + least)) AS weights, any_value(least) AS least, max(length(word)) AS longest FROM c, t),
r(p_partkey, s, i, best, ends) AS (
  SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g'), length(regexp_replace(lower(p_name), '[^a-z]', '', 'g')), [0.0::DOUBLE], [0::BIGINT] FROM part
  UNION ALL
  SELECT p_partkey, s, i - 1, list_prepend(b.score, best), list_prepend(b.stop, ends) FROM (
    SELECT r.*, list_sort([x FOR x IN list_transform(range(1, least(longest, length(s) - i + 1) + 1), lambda l: {
      'score': coalesce(weights[substr(s, i, l)], CASE WHEN l = 1 THEN m.least END) + best[l], 'stop': i - 1 + l}) IF x.score IS NOT NULL], 'DESC')[1] AS b FROM r, m WHERE i > 0)),
p(p_partkey, s, ends, pos, words) AS (
  SELECT p_partkey, s, ends, 0::BIGINT, []::VARCHAR[] FROM r WHERE i = 0
  UNION ALL SELECT p_partkey, s, ends, ends[pos + 1], list_append(words, substr(s, (pos + 1)::INTEGER, (ends[pos + 1] - pos)::INTEGER)) FROM p WHERE pos < length(s))
SELECT p_partkey, len(words)::INTEGER AS n_words, array_to_string(words, '|') AS words FROM p WHERE pos = length(s)
""")
def segmented_words(spark, sf):
    """TXT-30: names without their spaces, cut by a dictionary of the words of all names."""
    p = table(spark, sf, "part")
    words = p.select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    cut = S.segmenter(words, run="a-z")
    return p.select("p_partkey", cut(F.regexp_replace(F.lower("p_name"), "[^a-z]", "")).alias("w")).select("p_partkey", F.size("w").alias("n_words"), F.array_join("w", "|").alias("words"))


@query(f"WITH {BM} SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM bm WHERE rank <= 10")
def bm25_index_topk(spark, sf):
    """VEC-20 to VEC-23: all benchmark items against an index of all documents, stored and loaded again."""
    path = folders.work_folder(spark)
    I.save(table(spark, sf, "documents"), path, "doc_id", "text")
    return I.search(I.load(spark, path), table(spark, sf, "benchmark"), 10, "item_id", "text")


@query("SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 20 = 0) GROUP BY 1")
def point_lookup(spark, sf):
    """SRC-14: the orders of some customers, from a table laid out by customer."""
    path = folders.work_folder(spark)
    folders.save_by_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), path, "o_custkey", buckets=16)
    asked = table(spark, sf, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return folders.lookup_many(spark, path, asked, "o_custkey", buckets=16).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))


_SECTION = "CASE vec_id % 3 WHEN 0 THEN 'blurb' WHEN 1 THEN 'card' ELSE 'middle' END"


@query(f"""WITH s AS (SELECT vec_id // 4 AS novel_id, {_SECTION} AS section_kind, vec_id::INTEGER AS ordinal, embedding FROM embeddings),
x AS (SELECT q.vec_id AS query_id, novel_id, section_kind, ordinal, round(list_inner_product(s.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS score FROM s, embeddings q),
b AS (SELECT query_id, novel_id, max(score) AS score, arg_min({{'k': section_kind, 'o': ordinal}}, (-score, section_kind, ordinal)) AS w FROM x GROUP BY 1, 2)
SELECT query_id, novel_id, round(score, 6) AS score, w.k AS section_kind, w.o AS ordinal, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, novel_id)::INTEGER AS rank FROM b) WHERE rank <= 5""")
def best_sections(spark, sf):
    """VEC-06, VEC-07, SRC-44: the books with the best sections for every vector as a query."""
    e = table(spark, sf, "embeddings")
    sections = e.select(F.floor(F.col("vec_id") / 4).alias("novel_id"), F.expr(_SECTION).alias("section_kind"), F.col("vec_id").cast("int").alias("ordinal"), "embedding")
    return R.best_sections(e.select(F.col("vec_id").alias("query_id"), "embedding"), sections, 5).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 4) AS total, (SELECT count(*) FROM embeddings WHERE vec_id % 3 > 0) AS added FROM embeddings")
def appended_vectors(spark, sf):
    """VEC-08: two thirds of the vectors are added to the rest, after a check of keys and dimensions."""
    path = folders.work_folder(spark)
    e = table(spark, sf, "embeddings")
    e.where("vec_id % 3 = 0").write.parquet(path)
    added = R.append_vectors(path, e.where("vec_id % 3 > 0"), ["vec_id"])
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return spark.read.parquet(path).select("vec_id", "label", F.round(total, 4).alias("total"), F.lit(added).cast("long").alias("added"))
