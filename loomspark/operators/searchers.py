"""Searchers over the indexes of a folder, pools of what they find, and indexes made in shards."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lexical, lexical_index, models
from . import vectors as V


@dataclass(frozen=True)
class Searcher:
    """A name and a function of queries ``(query_id, query)`` and a depth to ``(query_id, novel_id, score, rank)``."""

    name: str
    search: Callable[[DataFrame, int], DataFrame]


def best_sections(queries: DataFrame, sections: DataFrame, k: int, oversample: int | None = None) -> DataFrame:
    """VEC-06, VEC-07 for many queries: the ``k`` books with the best sections, with the section's kind and ordinal.

    ``sections`` has ``novel_id, section_kind, ordinal, embedding``. So many sections are taken that they hold ``k`` books
    whatever they are: ``k`` times the most that a book has; with ``oversample``, ``k`` times that, and then fewer books
    may come back. Without it, one book with very many sections makes every query carry that many rows, so such a table
    should be searched with it, or its long books cut.
    """
    named = sections.withColumn("section", F.struct("novel_id", "section_kind", "ordinal"))
    most = oversample or sections.groupBy("novel_id").count().agg(F.max("count")).first()[0] or 1
    # Sections are numbered by their own names, which are compared as text where scores tie.
    keyed = named.select(F.to_json("section").alias("vec_id"), "embedding")
    near = V.topk_batch(queries, keyed, k * most).select("query_id", F.from_json("vec_id", sections.select(F.struct("novel_id", "section_kind", "ordinal").alias("s")).schema["s"].dataType).alias("s"), "score")
    best = near.groupBy("query_id", "s.novel_id").agg(F.max("score").alias("score"), F.min_by("s", F.struct((-F.col("score")).alias("m"), F.col("s.section_kind"), F.col("s.ordinal"))).alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "novel_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "novel_id", "score", "rank", F.col("s.section_kind").alias("section_kind"), F.col("s.ordinal").alias("ordinal"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load(spark: SparkSession, folder: str, make: Callable[[], models.Encoder] | None = None, label: str | None = None, depth: int = 100, oversample: int | None = None) -> list[Searcher]:
    """SRC-44: every searcher that a folder supports, told by its tables.

    ``multi`` holds vectors of sections, ``single`` of books, of which the first counts if both are there; ``lexical`` is a
    stored index of words. With vectors and words there is a third, the fusion of both to ``depth``. Vectors need an
    encoder for the queries, and a folder without any index is an error.
    """
    label = label or folder.rstrip("/").rsplit("/", 1)[-1]
    found: list[Searcher] = []
    kind = next((x for x in ("multi", "single") if _exists(spark, f"{folder}/{x}")), None)
    if kind:
        if make is None:
            raise ValueError(f"{folder} holds vectors: an encoder is needed for the queries")
        encode = models.encoder_udf(make, role="query")
        table = spark.read.parquet(f"{folder}/{kind}")

        def dense(queries: DataFrame, k: int) -> DataFrame:
            asked = queries.where(F.trim("query") != "").select("query_id", encode("query").alias("embedding"))
            if kind == "multi":
                return best_sections(asked, table.withColumnRenamed("kind", "section_kind"), k, oversample)
            return V.topk_batch(asked, table.withColumnRenamed("novel_id", "vec_id"), k).withColumnRenamed("vec_id", "novel_id")

        found.append(Searcher(f"{label}/dense_{kind}", dense))
    if _exists(spark, f"{folder}/lexical"):
        index = lexical_index.load(spark, f"{folder}/lexical")
        found.append(Searcher(f"{label}/bm25", lambda queries, k: lexical_index.search(index, queries, k, "query_id", "query")))
    if not found:
        raise FileNotFoundError(f"no index in {folder}")
    if len(found) == 2:
        parts = tuple(found)

        def hybrid(queries: DataFrame, k: int) -> DataFrame:
            return lexical.fuse([s.search(queries, max(depth, k)) for s in parts], ["query_id"], "novel_id").where(F.col("rank") <= k)

        found.append(Searcher(f"{label}/hybrid_rrf", hybrid))
    return found


def build_pool(searchers: list[Searcher], queries: DataFrame, depth: int, path: str) -> tuple[DataFrame, dict[str, float]]:
    """SVC-11, VEC-28: the first ``depth`` books of every searcher for every query, ``config`` being its name, and the
    milliseconds a query took it, on the average.

    Each searcher answers all queries in one job, whose rows are written under ``path`` as it goes; so a pool that stopped
    has whole searchers, and nothing is searched again when it is read. Queries go to each searcher word for word.
    """
    spark = queries.sparkSession
    n = max(queries.count(), 1)
    took, rows = {}, None
    if len({s.name for s in searchers}) < len(searchers):
        raise ValueError("searchers need names of their own")
    for i, s in enumerate(searchers):
        began = time.perf_counter()
        part = s.search(queries, depth)
        kind = F.col("section_kind") if "section_kind" in part.columns else F.lit("")
        part.select("query_id", F.lit(s.name).alias("config"), F.col("rank").cast("int").alias("rank"), "novel_id", F.col("score").cast("double").alias("score"), kind.alias("section_kind")).write.mode("errorifexists").parquet(f"{path}/{i:03d}")
        took[s.name] = (time.perf_counter() - began) * 1000 / n
        done = spark.read.parquet(f"{path}/{i:03d}")
        rows = done if rows is None else rows.unionByName(done)
    if rows is None:
        raise ValueError("no searchers")
    return rows, took


def append_vectors(path: str, new: DataFrame, keys: list[str], vector: str = "embedding") -> int:
    """VEC-08: vectors are added to a stored table; how many. Nothing is written if columns are missing, if a vector is
    not valid or has another dimension than those stored, if a key is null, repeated or stored already."""
    spark = new.sparkSession
    stored = spark.read.parquet(path)
    if missing := [c for c in stored.columns if c not in new.columns]:
        raise ValueError(f"missing columns: {missing}")
    rows = new.select(stored.columns)
    dim = stored.select(F.size(vector).alias("n")).first()
    seen = rows.agg(F.count("*").alias("rows"), F.count_if(~V.valid(vector, dim.n if dim else None)).alias("bad"), F.count_distinct(F.size(vector)).alias("dims"), F.count_if(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))).alias("blank")).first()
    if seen.bad or seen.dims > 1:
        raise ValueError(f"{seen.bad} vectors are not valid or not of {dim.n if dim else 'one'} dimensions")
    if seen.blank:
        raise ValueError(f"{seen.blank} rows lack a key")
    both = rows.select(*keys, F.lit(1).alias("n")).unionByName(stored.join(rows.select(*keys).distinct(), keys, "left_semi").select(*keys, F.lit(1).alias("n")))
    twice = both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 1").limit(3).collect()  # three to tell
    if twice:
        raise ValueError(f"keys repeat: {[tuple(r)[:-1] for r in twice]}")
    rows.write.mode("append").parquet(path)
    return seen.rows


def encode_in_shards(texts: DataFrame, make: Callable[[int], models.Encoder], shards: int, key: str = "novel_id", text: str = "text", batch: int = 32, normalise: bool = True) -> DataFrame:
    """UDF-05: ``(key, embedding, shard)``: contiguous ranges of keys, one task for each device, all running at one time.

    ``make`` gets the shard's number, which is its device's. No shard encodes before all have their model, and if one
    fails all start anew, so a result never mixes runs; Spark runs them as one barrier stage, which needs as many free
    slots. Rows are in order of the key within a shard, and shards in order of their numbers; a null text is an empty one.
    """
    if shards <= 0:
        raise ValueError("there must be a shard")
    ranged = texts.select(key, F.coalesce(text, F.lit("")).alias("__text")).repartitionByRange(shards, key).sortWithinPartitions(key)
    kind = texts.select(key).schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = BarrierTaskContext.get()
        shard = task.partitionId()
        model = make(shard)
        task.barrier()
        for part in parts:
            vectors = models.encode_texts(model, part.column(1).to_pylist(), batch, normalise, role="document")
            rows = pa.array(list(np.asarray(vectors, dtype=np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column(0), rows, pa.array([shard] * part.num_rows, pa.int32())], names=[key, "embedding", "shard"])

    rows = ranged.mapInArrow(run, f"`{key}` {kind}, embedding array<float>, shard int", barrier=True)
    # Spark starts a barrier stage anew only if nothing of its results was handed on, so they are shuffled first, each
    # shard to the partition of its number.
    return rows.repartitionById(shards, "shard").sortWithinPartitions(key)
