"""BM25 over a token table, and rank fusion."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..sources import folders

#: Documents and queries of a block, about: a task scores one block of queries in one block of documents at a time.
DOCS, QUERIES = 2_048, 1_024


def postings(docs: DataFrame, key: str, text: str, tokenizer: Callable[[str], Column] = X.tokens, wanted: DataFrame | None = None) -> DataFrame:
    """VEC-18, UDF-15: ``(token, key, tf, length)``. The length travels with the rows, so no join looks it up.

    With ``wanted``, a table of distinct tokens, other tokens are left out before anything is counted.
    """
    rows = docs.select(key, tokenizer(text).alias("__t")).select(key, F.size("__t").alias("length"), F.explode("__t").alias("token"))
    if wanted is not None:
        rows = rows.join(wanted, "token", "left_semi")
    return rows.groupBy("token", key).agg(F.count("*").alias("tf"), F.max("length").alias("length"))


def corpus_stats(docs: DataFrame, text: str, tokenizer: Callable[[str], Column] = X.tokens) -> DataFrame:
    """VEC-18: one row with the number of documents and their mean length."""
    return docs.select(F.size(tokenizer(text)).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("mean_length"))


def idf(n_docs: Column, df: Column) -> Column:
    """VEC-19."""
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def search(queries: DataFrame, docs: DataFrame, k: int, query_id: str, query: str, key: str, text: str, k1: float = 1.5, b: float = 0.75, tokenizer: Callable[[str], Column] = X.tokens, digits: int = 6) -> DataFrame:
    """VEC-20, VEC-23: Okapi scores over the distinct tokens of each query; documents that share none are absent.

    Scores are rounded before they are ranked, since sums depend
    on order; ties go by key. ``k`` under one gives nothing.
    """
    return search_variants(queries, docs, k, query_id, query, key, text, [(k1, b)], tokenizer, digits).drop("variant")


def token_lists(docs: DataFrame, key: str, text: str, tokenizer: Callable[[str], Column] = X.tokens) -> DataFrame:
    """``(key, tokens, length)``, one row a key: rows that share one are taken together, and the length is the longest one's.
    Where none do, nothing but keys is shuffled."""
    rows = docs.select(key, tokenizer(text).alias("tokens")).withColumn("length", F.size("tokens"))
    if docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy(key).agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.max("length").alias("length"), F.count("*").alias("rows"), F.sum("length").alias("total"), F.count("length").alias("lengths"))


def frequencies(lists: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, int, float | None]:
    """VEC-18: ``(token, df)`` of ``token_lists``, the number of documents and their mean length, from one reading of the texts.

    A document counts for each of its distinct tokens, so only counts by token are shuffled. Every document also has a row
    without a token, which brings its length; the counts are stored, as both are read from them.
    """
    spark, one = lists.sparkSession, "rows" not in lists.columns
    facts = [F.lit(1).alias("rows"), F.col("length").alias("total"), F.when(F.col("length").isNotNull(), 1).alias("lengths")] if one else ["rows", "total", "lengths"]
    each = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct("tokens"), F.array().cast("array<string>")))
    rows = lists.select(*facts, F.explode(each).alias("token"))
    if wanted is not None:
        known = wanted.select(F.col("token").alias("w")).unionByName(spark.range(1).select(F.lit(None).cast("string").alias("w")))
        rows = rows.join(known, F.col("token").eqNullSafe(F.col("w")), "left_semi")
    path = folders.work_folder(spark)
    rows.groupBy("token").agg(F.count("*").alias("df"), *[F.sum(c).alias(c) for c in ("rows", "total", "lengths")]).write.parquet(path)
    stored = spark.read.parquet(path)
    told = stored.where("token is null").first()
    return stored.where("token is not null").select("token", "df"), told["rows"] if told else 0, told["total"] / told["lengths"] if told and told["lengths"] else None


def search_variants(queries: DataFrame, docs: DataFrame, k: int, query_id: str, query: str, key: str, text: str, variants: list[tuple[float, float]], tokenizer: Callable[[str], Column] = X.tokens, digits: int = 6) -> DataFrame:
    """``search`` for several ``(k1, b)`` at once, numbered in ``variant``: one set of postings, scored once for each.

    Documents are dealt into blocks, and each meets each block of queries in one group. There postings are counted and
    added up by query, and only the best ``k`` documents per query leave it, so what is shuffled are the documents' tokens
    and ``k`` rows per query and block, and not a row for each pair that shares a token.
    """
    asked = queries.select(query_id, F.explode(F.array_distinct(tokenizer(query))).alias("token")).distinct()
    id_type, key_type = queries.schema[query_id].dataType, docs.schema[key].dataType
    lists = token_lists(docs, key, text, tokenizer)
    df, n_docs, mean = frequencies(lists, asked.select("token").distinct())
    n_queries = queries.select(query_id).distinct().count()
    q_blocks, d_blocks = max(1, -(-n_queries // QUERIES)), max(1, -(-n_docs // DOCS))
    weighted = asked.join(df, "token").select(query_id, "token", idf(F.lit(n_docs), F.col("df")).alias("idf"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = weighted.select(F.col(query_id).alias("q"), "token", "idf", dealt(query_id, q_blocks).alias("a")).select("*", every(d_blocks).alias("b"))
    right = lists.select(F.col(key).alias("d"), "length", "tokens", dealt(key, d_blocks).alias("b")).select("*", every(q_blocks).alias("a"))
    out = T.StructType([T.StructField("q", id_type), T.StructField("d", key_type), T.StructField("variant", T.IntegerType()), T.StructField("score", T.DoubleType())])
    schema = pa.schema([("q", to_arrow_type(id_type)), ("d", to_arrow_type(key_type)), ("variant", pa.int32()), ("score", pa.float64())])

    def best(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not ours.num_rows or not theirs.num_rows or k < 1:
            return schema.empty_table()
        names, words = ours.column("q").combine_chunks().dictionary_encode(), ours.column("token").combine_chunks().dictionary_encode()
        theirs = theirs.take(pc.sort_indices(theirs, sort_keys=[("d", "ascending")], null_placement="at_start"))  # ties go by key
        lists, n = theirs.column("tokens").combine_chunks(), theirs.num_rows
        known = pc.index_in(lists.flatten(), value_set=words.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
        place = np.repeat(np.arange(n), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        met, tf = np.unique(known[known >= 0].astype(np.int64) * n + place[known >= 0], return_counts=True)
        token, doc = met // n, met % n
        starts = np.searchsorted(token, np.arange(len(words.dictionary) + 1))
        shares = theirs.column("length").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)[doc] / (mean or 1.0)
        who, what, weight = names.indices.to_numpy(), words.indices.to_numpy(), ours.column("idf").to_numpy()
        order = np.argsort(who, kind="stable")
        edges = np.searchsorted(who[order], np.arange(len(names.dictionary) + 1))
        found = ([], [], [], [])
        for v, (k1, b) in enumerate(variants):
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * shares))
            for q in range(len(names.dictionary)):
                total = np.zeros(n)
                for i in order[edges[q] : edges[q + 1]]:
                    s = slice(starts[what[i]], starts[what[i] + 1])
                    total[doc[s]] += weight[i] * part[s]
                held = np.flatnonzero(total)
                if len(held):
                    score = np.round(total[held], digits)
                    m = min(k, len(held))
                    pick = np.flatnonzero(score >= np.partition(score, -m)[-m])
                    pick = pick[np.argsort(-score[pick], kind="stable")][:m]
                    for column, values in zip(found, (np.full(m, q), held[pick], np.full(m, v, np.int32), score[pick])):
                        column.append(values)
        if not found[0]:
            return schema.empty_table()
        q, d, v, score = map(np.concatenate, found)
        return pa.Table.from_arrays([names.dictionary.take(pa.array(q)), theirs.column("d").combine_chunks().take(pa.array(d)), pa.array(v), pa.array(score)], schema=schema)

    groups = q_blocks * d_blocks
    spread = (lambda t: t.repartition(groups, "a", "b")) if groups > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else (lambda t: t)
    near = spread(left).groupBy("a", "b").cogroup(spread(right).groupBy("a", "b")).applyInArrow(best, out)
    rows = near.select(F.col("q").alias(query_id), F.col("d").alias(key), "variant", "score")
    w = Window.partitionBy(query_id, "variant").orderBy(F.desc("score"), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], keys: list[str], item: str, k: int = 60, weights: list[float] | None = None, digits: int = 9) -> DataFrame:
    """WIN-04, VEC-24: reciprocal-rank fusion of rankings with a ``rank`` column, ranked anew, ties by item."""
    weights = weights or [1.0] * len(rankings)
    if len(weights) != len(rankings):
        raise ValueError("one weight for each ranking")
    rows = None
    for i, (r, w) in enumerate(zip(rankings, weights)):
        part = r.select(*keys, item, (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("part"), F.lit(i).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    return _fused(rows, keys, item, digits)


def fuse_variants(ranking: DataFrame, keys: list[str], item: str, weights: list[float], k: int = 60, digits: int = 9) -> DataFrame:
    """``fuse`` for rankings in one table, told apart by ``variant``; one weight for each."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("variant") + 1)
    return _fused(ranking.select(*keys, item, (w / (F.lit(k) + F.col("rank"))).alias("part"), F.col("variant").alias("source")), keys, item, digits)


def _fused(rows: DataFrame, keys: list[str], item: str, digits: int) -> DataFrame:
    total = rows.groupBy(*keys, item).agg(F.round(F.sum("part"), digits).alias("score"), F.array_join(F.array_sort(F.collect_set(F.col("source").cast("string"))), "+").alias("sources"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), item) if keys else Window.orderBy(F.desc("score"), item)
    return total.withColumn("rank", F.row_number().over(w))
