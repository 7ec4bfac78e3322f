"""Incremental refresh of a table that is derived from raw answers.

The derived table is partitioned by a bucket of its key and says of each row which raw answer, by checksum, and which version
of the parser it came from. A refresh parses only what is new or stale, and rewrites only the partitions that hold such rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def derived(spark: SparkSession, path: str, key: str, kind: str, card: str) -> DataFrame:
    """The derived table: ``(key, raw_hash, version, card, bucket)``; an empty one where nothing was derived yet."""
    schema = f"{key} {kind}, raw_hash string, version string, card {card}, bucket int"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def reparse(raw: DataFrame, path: str, key: str, answer: str, parse: Callable[[DataFrame], Column], version: str, buckets: int = 64) -> tuple[int, list[int]]:
    """STR-11: parse the raw answers whose derived row is missing, or came from another answer or another version.

    ``parse`` makes a struct of the rows of ``raw`` (it may use other columns, as the text that an answer is checked against),
    null where an answer does not parse: such a key keeps the row it has. Keys without a raw answer, or without one that is
    not null, are left alone, and so are all their partitions. Of rows that share a key that of the greatest answer counts; null keys
    are left out. Returns how many keys were parsed and which partitions were rewritten, at most ``buckets`` numbers.
    """
    spark = raw.sparkSession
    kind = raw.schema[key].dataType.simpleString()
    rest = [c for c in raw.columns if c != key]
    one = raw.where(F.col(key).isNotNull() & F.col(answer).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), answer).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
    placed = one.withColumn("raw_hash", F.sha2(answer, 256)).withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))
    card = placed.select(parse(placed).alias("card")).schema["card"].dataType.simpleString()
    current = derived(spark, path, key, kind, card)
    fresh = current.where(F.col("version") == version).select(key, "raw_hash", "bucket")
    stale = placed.join(fresh, [key, "raw_hash", "bucket"], "left_anti")
    parsed = stale.select(key, "raw_hash", F.lit(version).alias("version"), parse(stale).alias("card"), "bucket").where("card is not null")
    touched = {r["bucket"]: r["n"] for r in parsed.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    if touched:
        # Rows of the same partitions that are not parsed anew go along; no other partition is read or written.
        kept = current.where(F.col("bucket").isin(list(touched))).join(parsed.select(key, "bucket"), [key, "bucket"], "left_anti")
        rows = parsed.unionByName(kept.select(parsed.columns)).repartition("bucket", key).sortWithinPartitions("bucket", key)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return sum(touched.values()), sorted(touched)
