"""A stored BM25 index: posting lists in blocks with each block's greatest score, and an exact top-k that skips blocks.

Three tables and a row of facts lie under a folder. ``docs`` holds each document's length and tokens, so nothing is tokenised
twice. ``postings`` holds blocks ``(bucket, token, shard, block, top, postings)``: tokens are dealt to buckets, documents to
shards, and inside a shard a token's postings are sorted by score and cut into blocks, so a stop word's list is built, stored
and read by as many tasks as there are shards. ``tokens`` has each token's document frequency and greatest score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from .lexical import QUERIES, idf

#: Tokens of queries up to this number are broadcast, so that posting lists stay where they are read.
BROADCAST_ROWS = 200_000
#: Tokens that are counted at one time, about.
TOKENS = 2_000_000


def _bucket(token: str, buckets: int) -> Column:
    return F.pmod(F.hash(token), F.lit(buckets))


@dataclass(frozen=True)
class LexicalIndex:
    """VEC-22: a stored index as it was built: where it lies, its parameters, and the facts that scores need."""

    path: str
    key: str
    k1: float
    b: float
    n_docs: int
    mean_length: float
    buckets: int
    shards: int
    kind: str = "string"

    def table(self, spark: SparkSession, name: str, buckets: list[int] | None = None) -> DataFrame:
        schema = {
            "docs": f"key {self.kind}, length int, tokens array<string>",
            "postings": f"token string, shard int, block int, top double, n int, postings array<struct<key:{self.kind},tf:bigint,length:int>>, bucket int",
            "tokens": "token string, df bigint, top double, bucket int",
        }
        t = spark.read.schema(schema[name]).parquet(f"{self.path}/{name}")
        return t if buckets is None else t.where(F.col("bucket").isin(buckets))


def score(tf: Column, length: Column, k1: float, b: float, mean: float) -> Column:
    """A posting's share of a score, without its token's weight."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean or 1.0)))


def _counted(lists: DataFrame) -> DataFrame:
    """``(token, key, tf, length)`` of ``(key, length, tokens)``, counted where a row lies: only postings leave the task."""
    key_type = lists.schema["key"].dataType
    out = T.StructType([T.StructField("token", T.StringType()), T.StructField("key", key_type), T.StructField("tf", T.LongType()), T.StructField("length", T.IntegerType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(pc.list_value_length(whole.column(2)).fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, side="right")))
                b, at = whole.slice(at, to - at), to
                n = b.num_rows
                words = b.column(2).flatten().dictionary_encode()
                rows = np.repeat(np.arange(n), pc.list_value_length(b.column(2)).fill_null(0).to_numpy(zero_copy_only=False))
                met, tf = np.unique(words.indices.to_numpy().astype(np.int64) * n + rows, return_counts=True)
                row = pa.array(met % n)
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(met // n)), b.column(0).take(row), pa.array(tf, pa.int64()), b.column(1).take(row)], names=["token", "key", "tf", "length"])

    rows = lists.select("key", "length", "tokens").mapInArrow(count, out)
    if lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy("token", "key").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))  # rows that share a key are one document


def save(docs: DataFrame, path: str, key: str, text: str, tokenizer: Callable[[str], Column] = X.tokens, k1: float = 1.5, b: float = 0.75, buckets: int = 64, block: int = 128, shard_docs: int = 50_000, overwrite: bool = False) -> LexicalIndex:
    """VEC-21: build and store an index. Keys name documents and are not null; a null text
    has no tokens and no length, so it counts as a document and not for the mean, as in ``lexical.search``.

    A group of the one grouping that collects, a token in a shard, has at most about ``shard_docs`` postings. The row of
    facts is written last, so a build that fails leaves nothing that loads.
    """
    spark, mode = docs.sparkSession, "overwrite" if overwrite else "errorifexists"
    lists = docs.select(F.col(key).alias("key"), tokenizer(text).alias("tokens"))
    lists.select("key", F.size("tokens").alias("length"), "tokens").write.mode(mode).parquet(f"{path}/docs")
    kind = lists.schema["key"].dataType.simpleString()
    draft = LexicalIndex(path, key, float(k1), float(b), 0, 0.0, buckets, 0, kind)
    stored = draft.table(spark, "docs")
    facts = stored.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    n_docs, mean = facts["n"], facts["mean"] or 0.0
    shards = max(1, -(-n_docs // shard_docs))
    p = F.struct((-score(F.col("tf"), F.col("length"), k1, b, mean)).alias("minus"), "key", "tf", "length").alias("p")
    scored = _counted(stored).select("token", _bucket("token", buckets).alias("bucket"), F.pmod(F.hash("key"), F.lit(shards)).alias("shard"), "key", "tf", "length")
    # Postings move once, to the task that writes their bucket and shard; there they are put together and sorted.
    sorted_lists = scored.repartition("bucket", "shard").groupBy("bucket", "shard", "token").agg(F.array_sort(F.collect_list(p)).alias("ps"))
    blocks = sorted_lists.select("token", "bucket", "shard", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("ps") - 1) / block)), lambda i: F.slice("ps", (i * block + 1).cast("int"), F.lit(block)))).alias("block", "ps"))
    ready = blocks.select(
        "token", "shard", "block", (-F.col("ps")[0]["minus"]).alias("top"), F.size("ps").alias("n"),
        F.transform("ps", lambda p: F.struct(p["key"].alias("key"), p["tf"].alias("tf"), p["length"].alias("length"))).alias("postings"), "bucket",
    )
    # A bucket is one file for each range of shards, sorted so that a token's blocks lie together.
    ready.sortWithinPartitions("bucket", "token", "block").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    heads = draft.table(spark, "postings").select("bucket", "token", "n", "top").repartition("bucket").groupBy("bucket", "token").agg(F.sum("n").alias("df"), F.max("top").alias("top"))
    heads.select("token", "df", "top", "bucket").sortWithinPartitions("bucket", "token").write.mode(mode).partitionBy("bucket").parquet(f"{path}/tokens")
    row = [(key, float(k1), float(b), n_docs, float(mean), buckets, shards, kind)]
    spark.createDataFrame(row, "key string, k1 double, b double, n_docs long, mean_length double, buckets int, shards int, kind string").write.mode(mode).parquet(f"{path}/facts")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> LexicalIndex:
    """VEC-22: what :func:`save` left; a folder without its row of facts is no index."""
    return LexicalIndex(path, **spark.read.parquet(f"{path}/facts").first().asDict())


def _top(rows: DataFrame, query_id: str, order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order))).where(F.col("rank") <= k)


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def _asked(index: LexicalIndex, queries: DataFrame, query_id: str, query: str, tokenizer: Callable[[str], Column]) -> tuple[DataFrame, list[int], int]:
    spark = queries.sparkSession
    asked = queries.select(query_id, F.explode(F.array_distinct(tokenizer(query))).alias("token")).withColumn("bucket", _bucket("token", index.buckets))
    counts = {r.bucket: r.n for r in asked.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # at most index.buckets
    places, n = sorted(counts), sum(counts.values())
    known = index.table(spark, "tokens", places).join(_small(asked, n), ["bucket", "token"])
    weight = idf(F.lit(index.n_docs), F.col("df"))
    return known.select(query_id, "bucket", "token", weight.alias("idf"), (weight * F.col("top")).alias("most")), places, n


def asked_tokens(index: LexicalIndex, queries: DataFrame, query_id: str, query: str, tokenizer: Callable[[str], Column] = X.tokens) -> tuple[DataFrame, list[int]]:
    """``(query_id, token, idf, most)`` for the distinct tokens of queries that the index knows, where ``most`` is what the
    token can add to a score at most; and the buckets that hold them."""
    return _asked(index, queries, query_id, query, tokenizer)[:2]


def _best(index: LexicalIndex, asked: DataFrame, lists: DataFrame, k: int, query_id: str, q_blocks: int, digits: int) -> DataFrame:
    """The best ``k`` documents per query and shard, ``(query_id, key, score)``, of ``(query_id, token, idf, optional, rest, bound)``
    and of blocks of postings. A document lies in one shard, so a block meets each block of queries once and not each query."""
    id_type, key_type = asked.schema[query_id].dataType, lists.schema["postings"].dataType.elementType["key"].dataType
    out = T.StructType([T.StructField("q", id_type), T.StructField("d", key_type), T.StructField("score", T.DoubleType())])
    schema = pa.schema([("q", to_arrow_type(id_type)), ("d", to_arrow_type(key_type)), ("score", pa.float64())])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.col(query_id).alias("q"), "token", "idf", "optional", "rest", "bound", F.pmod(F.xxhash64(query_id), F.lit(q_blocks)).cast("int").alias("a")).select("*", every(index.shards).alias("b"))
    right = lists.select("token", F.col("postings.key").alias("keys"), F.col("postings.tf").cast("array<int>").alias("tf"), F.col("postings.length").alias("length"), F.col("shard").alias("b")).select("*", every(q_blocks).alias("a"))
    k1, b, mean = index.k1, index.b, index.mean_length or 1.0

    def best(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        words = ours.column("token").combine_chunks().dictionary_encode()
        code = pc.index_in(theirs.column("token"), value_set=words.dictionary).fill_null(-1).to_numpy()
        order = np.argsort(code, kind="stable")
        order = order[np.searchsorted(code[order], 0) :]
        if not ours.num_rows or not len(order):
            return schema.empty_table()
        theirs = theirs.select(["keys", "tf", "length"]).take(pa.array(order)).combine_chunks()
        flat = lambda c: theirs.column(c).combine_chunks().flatten()
        sizes = pc.list_value_length(theirs.column("keys")).to_numpy()
        edges = np.concatenate([[0], np.cumsum(np.bincount(code[order], weights=sizes, minlength=len(words.dictionary)).astype(np.int64))])
        keys = flat("keys").dictionary_encode()
        ascending = pc.sort_indices(keys.dictionary)  # ties go by key
        n = len(ascending)
        place = np.empty(n, np.int64)
        place[ascending.to_numpy()] = np.arange(n)
        doc = place[keys.indices.to_numpy()]
        tf = flat("tf").to_numpy().astype(np.float64)
        share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * flat("length").to_numpy() / mean))
        names = ours.column("q").combine_chunks().dictionary_encode(null_encoding="encode")
        who, what, weight = names.indices.to_numpy(), words.indices.to_numpy(), ours.column("idf").to_numpy()
        optional, rest, bound = (ours.column(c).to_numpy() for c in ("optional", "rest", "bound"))
        by_query = np.argsort(who, kind="stable")
        ends = np.searchsorted(who[by_query], np.arange(len(names.dictionary) + 1))
        found = ([], [], [])
        for q in range(len(names.dictionary)):
            mine = by_query[ends[q] : ends[q + 1]]
            total = np.zeros(n)
            for i in mine[~optional[mine].astype(bool)]:
                s = slice(edges[what[i]], edges[what[i] + 1])
                total[doc[s]] += weight[i] * share[s]
            least = bound[mine[0]]
            held = np.flatnonzero(total if np.isnan(least) else (total > 0) & (total + rest[mine[0]] >= least))
            if not len(held):
                continue
            for i in mine[optional[mine].astype(bool)]:
                s = slice(edges[what[i]], edges[what[i] + 1])
                total[doc[s]] += weight[i] * share[s]
            score = np.round(total[held], digits)
            m = min(k, len(held))
            pick = np.flatnonzero(score >= np.partition(score, -m)[-m])
            pick = pick[np.argsort(-score[pick], kind="stable")][:m]
            for column, values in zip(found, (np.full(m, q), held[pick], score[pick])):
                column.append(values)
        if not found[0]:
            return schema.empty_table()
        q, d, much = map(np.concatenate, found)
        return pa.Table.from_arrays([names.dictionary.take(pa.array(q)), keys.dictionary.take(ascending.take(pa.array(d))), pa.array(much)], schema=schema)

    groups = q_blocks * index.shards
    spread = (lambda t: t.repartition(groups, "a", "b")) if groups > int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")) else (lambda t: t)
    near = spread(left).groupBy("a", "b").cogroup(spread(right).groupBy("a", "b")).applyInArrow(best, out)
    return near.select(F.col("q").alias(query_id), F.col("d").alias("key"), "score")


def search(index: LexicalIndex, queries: DataFrame, k: int, query_id: str, query: str, tokenizer: Callable[[str], Column] = X.tokens, digits: int = 6) -> DataFrame:
    """VEC-20, VEC-22, VEC-23: the rows of ``lexical.search``, from a stored index, with the key under its own name.

    First only the best block of each token and shard is read; the k-th best sum of a query is a score that k documents
    reach. Tokens whose greatest scores do not add up to it, least first, can bring no document in on their own. Of the
    other tokens a block is read only if for one query its greatest score and those of all other tokens together reach the
    bound, and the documents found there that may still reach it are looked up in the lists of the former. So a stop word's
    list meets the candidates of a query and not the query. Blocks move as they are stored, once for each block of queries.
    """
    spark = queries.sparkSession
    if k < 1:
        return queries.where("false").select(query_id, F.lit(None).cast(index.kind).alias(index.key), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    asked, places, n = _asked(index, queries, query_id, query, tokenizer)
    lists = index.table(spark, "postings", places)
    q_blocks = max(1, -(-queries.count() // QUERIES))

    heads = lists.where("block = 0").join(_small(asked.select("bucket", "token").distinct(), n), ["bucket", "token"])
    unbound = asked.select(query_id, "token", "idf", F.lit(False).alias("optional"), F.lit(0.0).alias("rest"), F.lit(None).cast("double").alias("bound"))
    first = _best(index, unbound, heads, k, query_id, q_blocks, digits)
    bound = _top(first, query_id, [F.desc("score")], k).where(F.col("rank") == k).select(query_id, (F.col("score") - 10.0**-digits).alias("bound"))

    # Tokens from the least upwards, while their sum stays below the bound, are optional. A query has few tokens.
    w = Window.partitionBy(query_id).orderBy("most", "token")
    graded = asked.join(bound, query_id, "left").withColumn("sum", F.sum("most").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("most").over(Window.partitionBy(query_id)))
    graded = graded.withColumn("optional", F.coalesce(F.col("sum") < F.col("bound"), F.lit(False)))
    graded = graded.withColumn("rest", F.coalesce(F.sum(F.when(F.col("optional"), F.col("most"))).over(Window.partitionBy(query_id)), F.lit(0.0)))

    # What a block's greatest score must be for one query at least; a little less, as sums and quotients are rounded.
    least = F.when(F.col("optional") | F.col("bound").isNull(), F.lit(0.0)).otherwise((F.col("bound") - F.col("all") + F.col("most")) / F.col("idf") - 1e-9)
    wanted = graded.groupBy("bucket", "token").agg(F.min(least).alias("least"))
    met = lists.join(_small(wanted, n), ["bucket", "token"]).where(F.col("top") >= F.col("least"))
    total = _best(index, graded, met, k, query_id, q_blocks, digits)
    return _top(total, query_id, [F.desc("score"), "key"], k).select(query_id, F.col("key").alias(index.key), "score", "rank")
