"""Folders that all machines share, and point lookups in a table laid out for them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OURS: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """A new folder for tables that a query makes on its way, in the one that ``spark.checkpoint.dir`` names; it goes when
    the process ends. A cluster must name one, and on a single machine a temporary folder serves."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.gettempdir()
    path = f"{named.rstrip('/')}/loomspark-{uuid.uuid4().hex}"
    _OURS.append(path)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _delete_ours() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in _OURS:
            try:
                delete_folder(spark, path)
            except Exception:  # the session may be gone already
                return


def save_by_key(rows: DataFrame, path: str, key: str, buckets: int = 256, overwrite: bool = False) -> None:
    """SRC-14: a table laid out so that one key lies in one of ``buckets`` folders, sorted by key inside it.

    Rows without a key are left out, as nothing can ask for them. A bucket whose rows are many is written by several tasks,
    by ranges of its keys, so a key that repeats often is no burden to one of them.
    """
    placed = rows.where(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))
    ready = placed.repartitionByRange("bucket", key, F.rand(7)).sortWithinPartitions("bucket", key)
    ready.write.partitionBy("bucket").mode("overwrite" if overwrite else "errorifexists").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, values: list, buckets: int = 256) -> DataFrame:
    """SRC-14: the rows of a few keys. Their buckets are worked out first, so that no other folder is listed, and inside a
    bucket the sorted files are skipped by their least and greatest key. Unknown keys have no rows, and null is none."""
    known = [v for v in values if v is not None]
    table = spark.read.parquet(path)
    if not known:
        return table.where("false").drop("bucket")
    kind = table.schema[key].dataType
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(v).cast(kind) for v in known])).alias("k")).select(F.pmod(F.hash("k"), F.lit(buckets)).alias("b")).distinct()
    places = [r.b for r in asked.collect()]
    return table.where(F.col("bucket").isin(places) & F.col(key).isin([F.lit(v).cast(kind) for v in known])).drop("bucket")


def lookup_many(spark: SparkSession, path: str, keys: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """SRC-14 for a table of keys: only the buckets that hold one of them are read."""
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    places = [r.b for r in wanted.select(F.pmod(F.hash(key), F.lit(buckets)).alias("b")).distinct().collect()]  # at most `buckets`
    return spark.read.parquet(path).where(F.col("bucket").isin(places)).drop("bucket").join(wanted, key, "left_semi")
