"""Exact vector search and pooling over tables of embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Queries in a block, at least: a task scores one block of queries against one block of vectors at a time. Where there are
#: many, blocks grow up to so many numbers, so that rows are copied less often.
BLOCK, NUMBERS = 8_192, 2_097_152
#: Queries and vectors of one matrix product.
SLICE, CHUNK = 256, 4_096


def dot(a: str | Column, b: str | Column) -> Column:
    """VEC-01: inner product, accumulated in double."""
    d = lambda c: F.col(c) if isinstance(c, str) else c
    return F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def valid(c: str | Column, dim: int | None = None) -> Column:
    """VEC-17: not empty, of the right size, all numbers finite."""
    v = F.col(c) if isinstance(c, str) else c
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == dim if dim else F.size(v) > 0) & ok, F.lit(False))


def restricted(vectors: DataFrame, key: str, allowed: DataFrame | None = None, avoid: DataFrame | None = None) -> DataFrame:
    """VEC-05, FLT-09, SET-02: the hard filters, applied before anything is scored."""
    if allowed is not None:
        vectors = vectors.join(allowed.select(key).distinct(), key, "left_semi")
    if avoid is not None:
        vectors = vectors.join(avoid.select(key).distinct(), key, "left_anti")
    return vectors


def topk(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", allowed: DataFrame | None = None, avoid: DataFrame | None = None) -> DataFrame:
    """VEC-02, VEC-03: the ``k`` nearest by inner product, ties by id. Each task keeps ``k`` rows, which are merged.

    A blank query gives nothing; ``k`` must be positive.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if not query:
        return vectors.limit(0).select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    q = F.array(*[F.lit(float(x)) for x in query])
    best = restricted(vectors, key, allowed, avoid).select(key, dot(vector, q).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return best.select(key, "score", F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"))


def nearest(q: np.ndarray, v: np.ndarray, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, vector, score)`` of the ``k`` greatest inner products per row of ``q``, to twelve digits, equal ones by
    their place in ``v``. ``without`` has for each query the range of places that it may not find.

    Products in single precision tell which pairs can be among them: a pair whose product lies below the k-th score by more
    than both roundings can't. Those that may be are scored in double precision.
    """
    longest = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x))
    with np.errstate(over="ignore", invalid="ignore"):
        scale, by = longest(q), longest(v).max(initial=0.0)
    usual = bool(1e-150 < by < 1e150 and ((scale == 0) | ((scale > 1e-150) & (scale < 1e150))).all())  # else all are scored
    scale = np.where(scale > 0, scale, 1.0) * by if usual else np.ones(len(q))
    kind = np.float32 if usual else np.float64
    margin = (q.shape[1] + 8) * float(np.finfo(kind).eps)
    narrow = (v / by if usual else v).astype(kind)
    found = ([], [], [])
    for start in range(0, len(q), SLICE):
        rows = q[start : start + SLICE]
        n, much = len(rows), scale[start : start + SLICE]
        ours = (rows / (much / by)[:, None] if usual else rows).astype(kind)
        who, what, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        kth = np.full(n, -np.inf)
        if without is not None:
            sizes = without[start : start + SLICE, 1] - without[start : start + SLICE, 0]
            self_row = np.repeat(np.arange(n), sizes)
            self_at = np.repeat(without[start : start + SLICE, 1] - np.cumsum(sizes), sizes) + np.arange(len(self_row))
        for at in range(0, len(v), CHUNK):
            s = ours @ narrow[at : at + CHUNK].T
            if without is not None:
                here = (self_at >= at) & (self_at < at + CHUNK)
                s[self_row[here], self_at[here] - at] = -np.inf
            least = (kth - 1e-12) / much - margin if usual else np.full(n, -np.inf)
            if usual and not at and s.shape[1] > k:
                least = np.partition(s, -k, axis=1)[:, -k].astype(np.float64) - 2 * margin - 1e-12 / much
            # One below in single precision, as the bound is rounded too.
            hit = np.flatnonzero((s >= np.nextafter(least.astype(kind), kind(-np.inf))[:, None]) & (s > -np.inf))
            if not len(hit):
                continue
            r, c = np.divmod(hit, s.shape[1])
            if len(hit) * 8 > s.size:
                exact = (rows @ v[at : at + CHUNK].T).ravel()[hit]
            else:
                exact = np.concatenate([np.einsum("ij,ij->i", rows[r[i : i + 65_536]], v[at + c[i : i + 65_536]]) for i in range(0, len(hit), 65_536)])
            exact = np.round(exact, 12)
            better = exact > kth[r]  # equal ones stand behind those that were found before
            who, what, score = np.concatenate([who, r[better]]), np.concatenate([what, at + c[better]]), np.concatenate([score, exact[better]])
            order = np.lexsort((what, -score, who))
            who, what, score = who[order], what[order], score[order]
            first = np.searchsorted(who, np.arange(n))
            place = np.arange(len(who)) - first[who]
            kth[who[place == k - 1]] = score[place == k - 1]
            who, what, score = who[place < k], what[place < k], score[place < k]
        for column, values in zip(found, (start + who, what, score)):
            column.append(values)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in found)


def topk_batch(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", key: str = "vec_id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """VEC-04, VEC-28: the ``k`` nearest for each of many queries.

    Queries and vectors are both dealt into blocks by a hash, and each pair of blocks is one group whose scores are matrix
    products of slices (``nearest``); only its best ``k`` rows per query leave it. The merge then sees ``k`` rows per query and block of
    vectors. No side is collected or broadcast, so any number of queries is answered.
    """
    id_type, key_type = queries.schema[query_id].dataType, vectors.schema[key].dataType
    out = T.StructType([T.StructField("q", id_type), T.StructField("v", key_type), T.StructField("score", T.DoubleType())])
    n_queries, told = queries.count(), vectors.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dim")).first()
    most = max(BLOCK, NUMBERS // max(1, told["dim"] or 1))
    blocks = lambda n: max(1, -(-n // min(most, max(BLOCK, n // 8))))
    q_blocks, v_blocks = blocks(n_queries), blocks(told["n"])
    # Rows are dealt by row number in their partition, so that equal ids or vectors don't meet in one block.
    dealt = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col(query_id).alias("id"), F.col(vector).alias("x"), dealt(q_blocks).alias("a")).select("id", "x", "a", every(v_blocks).alias("b"))
    right = vectors.select(F.col(key).alias("id"), F.col(vector).alias("x"), dealt(v_blocks).alias("b")).select("id", "x", every(q_blocks).alias("a"), "b")

    def matrix(table):
        flat = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(table.num_rows, -1)

    schema = pa.schema([("q", to_arrow_type(id_type)), ("v", to_arrow_type(key_type)), ("score", pa.float64())])

    def search(ours, theirs):
        if not ours.num_rows or not theirs.num_rows or k < 1:
            return schema.empty_table()
        theirs = theirs.take(pc.sort_indices(theirs, sort_keys=[("id", "ascending")], null_placement="at_start"))  # ties go by id
        names, keys = ours.column("id").combine_chunks(), theirs.column("id").combine_chunks()
        without = None
        if exclude_self:
            known = keys.dictionary_encode()
            code = known.indices.fill_null(-2).to_numpy(zero_copy_only=False)  # in order of ids, nulls before
            own = pc.index_in(names.cast(keys.type), value_set=known.dictionary, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
            without = np.stack([np.searchsorted(code, own, "left"), np.searchsorted(code, own, "right")], axis=1)
        who, whom, score = nearest(matrix(ours), matrix(theirs), k, without)
        return pa.Table.from_arrays([names.take(pa.array(who)), keys.take(pa.array(whom)), pa.array(score, pa.float64())], schema=schema)

    groups = q_blocks * v_blocks
    spread = (lambda t: t.repartition(groups, "a", "b")) if groups > int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) else (lambda t: t)
    near = spread(left).groupBy("a", "b").cogroup(spread(right).groupBy("a", "b")).applyInArrow(search, out).select(F.col("q").alias(query_id), F.col("v").alias(key), "score")
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), key)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def maxpool(sections: DataFrame, query: list[float], k: int, book: str, kind: str, ordinal: str, vector: str = "embedding", oversample: int | None = None) -> DataFrame:
    """VEC-06, VEC-07: a book scores as its best section.

    With ``oversample`` only the best ``k * oversample`` sections are looked at, so fewer than ``k`` books may come back.
    """
    scored = sections.select(book, kind, ordinal, dot(vector, F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    if oversample:
        scored = scored.orderBy(F.desc("score"), book, kind, ordinal).limit(k * oversample)
    best = scored.groupBy(book).agg(F.max("score").alias("score"), F.min_by(F.struct(kind, ordinal), F.struct((-F.col("score")).alias("s"), kind, ordinal)).alias("b"))
    return best.select(book, "score", f"b.{kind}", f"b.{ordinal}").orderBy(F.desc("score"), book).limit(k)


def pool_books(sections: DataFrame, book: str, kind: str, vector: str = "embedding", weights: dict[str, float] | None = None, kind_mean: bool = False) -> DataFrame:
    """VEC-13: the weighted mean of a book's section vectors, at unit length.

    A kind that ``weights`` does not name weighs one; a book whose kinds all weigh nothing falls back to the plain mean.
    ``kind_mean`` divides a weight by the number of the book's sections of its kind. One aggregation, combined before
    its shuffle; counts by kind come from another, joined on the book.
    """
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    w = F.coalesce(F.element_at(table, F.col(kind)), F.lit(1.0)) if weights else F.lit(1.0)
    rows = sections.withColumn("__w", w)
    if kind_mean:
        counts = sections.groupBy(book, kind).agg(F.count("*").alias("__n"))
        rows = rows.join(counts, [book, kind]).withColumn("__w", F.col("__w") / F.col("__n"))
    v = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    mean = lambda d, *w: d.groupBy(book).agg(vector_to_array(Summarizer.metrics("mean").summary(F.col("__v"), *w)["mean"]).alias("m"))
    rows = rows.withColumn("__v", v)
    weighted = mean(rows.where(F.col("__w") > 0), F.col("__w"))
    # Only books whose sections all weigh nothing are averaged plainly.
    pooled = weighted.unionByName(mean(rows.join(weighted.select(book), book, "left_anti"))) if weights else weighted
    pooled = pooled.withColumn("norm", F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x)))
    return pooled.select(book, F.transform("m", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x)).alias(vector))


def all_or_nothing(keys: DataFrame, vectors: DataFrame, book: str, on: list[str]) -> DataFrame:
    """JON-12: books all of whose keys have a vector."""
    found = keys.join(vectors.select(*on, F.lit(True).alias("__has")).distinct(), on, "left")
    return found.groupBy(book).agg(F.bool_and(F.col("__has").isNotNull()).alias("complete"))
