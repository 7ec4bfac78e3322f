"""Many pooled indexes from one pass over the sections.

The sum and the number of a book's section vectors by kind say all that a weighted mean by kind needs. They are computed and
stored once; each set of weights is then a small aggregation over them, and a configuration whose index is there is skipped.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kind_sums(sections: DataFrame, book: str, kind: str, vector: str = "embedding") -> DataFrame:
    """``(book, kind, n, total)``: one aggregation that combines before its shuffle. Sections without a vector do not count."""
    v = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    rows = sections.where(F.col(vector).isNotNull()).select(book, F.col(kind).alias("kind"), v.alias("__v"))
    return rows.groupBy(book, "kind").agg(F.count("*").alias("n"), vector_to_array(Summarizer.metrics("sum").summary(F.col("__v"))["sum"]).alias("total"))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def pooled(sums: DataFrame, book: str, weights: dict[str, float] | None = None, kind_mean: bool = False, vector: str = "embedding") -> DataFrame:
    """SVC-16, VEC-13: the vectors of ``vectors.pool_books`` for one set of weights, from stored sums.

    A kind that ``weights`` does not name weighs one; a book whose kinds all weigh nothing falls back to the plain mean. A
    book has few kinds, so its sums are one small list.
    """
    table = F.create_map(*[F.lit(x) for kv in (weights or {}).items() for x in kv]) if weights else None
    w = F.coalesce(F.element_at(table, F.col("kind")), F.lit(1.0)).cast("double") if weights else F.lit(1.0)
    rows = sums.withColumn("w", F.when(w > 0, w / F.col("n") if kind_mean else w).otherwise(0.0))
    lists = rows.groupBy(book).agg(F.sort_array(F.collect_list(F.struct("kind", "n", "total", "w"))).alias("ks"))
    some = F.exists("ks", lambda k: k["w"] > 0)
    share = lambda k: F.when(some, k["w"]).otherwise(1.0)
    zero = F.transform(F.get("ks", F.lit(0))["total"], lambda x: F.lit(0.0))
    total = F.aggregate("ks", zero, lambda s, k: _plus(s, F.transform(k["total"], lambda x: x * share(k))))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    weight = F.aggregate("ks", F.lit(0.0), lambda s, k: s + share(k) * k["n"])
    mean = lists.select(book, total.alias("t"), weight.alias("weight")).select(book, F.transform("t", lambda x: x / F.col("weight")).alias("m")).withColumn("norm", norm)
    return mean.select(book, F.transform("m", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x)).alias(vector))


def _there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def sweep(sections: DataFrame, out: str, configs: dict[str, dict], book: str, kind: str, only: str | None = None) -> tuple[list[str], list[str]]:
    """SVC-10, SVC-16: build the index of every configuration ``name -> {"weights": ..., "kind_mean": ...}`` under a folder.

    The sums are written first and used again by later sweeps into the same folder; sections are read only to make them. A
    configuration whose index was finished is skipped, and one that was broken off is built again. Returns the names built
    and the names skipped. A name that ``only`` gives and no configuration has is an error.
    """
    spark = sections.sparkSession
    if only is not None and only not in configs:
        raise ValueError(f"{only!r} is none of {sorted(configs)}")
    chosen = {n: c for n, c in configs.items() if only in (None, n)}
    skipped = [n for n in chosen if _there(spark, f"{out}/{n}")]
    todo = [n for n in chosen if n not in skipped]
    if todo and not _there(spark, f"{out}/_sums"):
        kind_sums(sections, book, kind).write.mode("overwrite").parquet(f"{out}/_sums")
    for name in todo:
        sums = spark.read.parquet(f"{out}/_sums")
        pooled(sums, book, chosen[name].get("weights"), chosen[name].get("kind_mean", False)).write.mode("overwrite").parquet(f"{out}/{name}")
    return todo, skipped
