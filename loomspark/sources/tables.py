"""Typed readers over tables: required columns, restrictions, versions, id maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """SRC-17, SRC-30, SRC-35: missing columns are named in the error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def load_profiles(df: DataFrame, key: str, text: str, least: int = 50, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """SRC-15, SRC-17, SRC-34: rows with an id and enough text, of the given ids only."""
    rows = require(df, [key, text]).where(F.col(key).isNotNull() & (F.char_length(text) >= least))
    if ids is not None:
        rows = rows.join(ids.select(key).distinct(), key, "left_semi")
    return rows.orderBy(key).limit(limit) if limit else rows


def single_version(column: str) -> Column:
    """SRC-43, TOOL-10: the one version that all rows share, or null."""
    return F.when(F.count_distinct(column) == 1, F.max(column))


def id_map(df: DataFrame, key: str, title: str, text: str, preview: int = 300) -> DataFrame:
    """VEC-26, VEC-27: dense row numbers in key order.

    Rows are numbered within sorted ranges, and each range starts where those before it end, so no task sees all. Ranges
    are told from a sample, which each plan draws anew, so they are stored once and both counted and numbered from there.
    """
    from pyspark.sql import Window

    from .folders import work_folder

    rows = df.select(key, F.col(title).alias("title"), F.substring(text, 1, preview).alias("preview"))
    spark, path, order = df.sparkSession, work_folder(df.sparkSession), F.col(key).asc_nulls_last()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, order).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    parted = spark.read.parquet(path)
    sizes = parted.groupBy("__p").count()
    starts = sizes.select("__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__s"))  # a row per partition
    numbered = parted.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1).join(F.broadcast(starts), "__p")
    return numbered.withColumn("row", F.col("__n") + F.col("__s")).drop("__p", "__n", "__s")


def density_map(wide: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """SRC-16: a wide density table as maps; null counts as nothing."""
    return wide.select(key, F.create_map(*[x for t in terms for x in (F.lit(t), F.coalesce(F.col(t), F.lit(0.0)))]).alias("densities"))


def index_metadata(spark: SparkSession, model: str, dim: int, n_vectors: int, normalised: bool, source: str, version: str | None) -> DataFrame:
    """SRC-42: one row about an index, kept beside it."""
    row = [(model, dim, n_vectors, normalised, source, version)]
    return spark.createDataFrame(row, "model string, dim int, n_vectors long, normalised boolean, source string, digest_version string").withColumn("created_at", F.current_timestamp())


def save_index(vectors: DataFrame, path: str, overwrite: bool = False) -> None:
    """SRC-37, SRC-39, SRC-41, VEC-11, VEC-21: an index is a table; an existing one is kept unless told otherwise."""
    vectors.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC-38, SRC-40, VEC-12, VEC-22."""
    return spark.read.parquet(path)
