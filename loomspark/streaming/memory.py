"""A streaming fold over append-only logs: the batch functions of ``operators.state`` run on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import merge_latest


def latest_stream(spark: SparkSession, source: str, schema: str, state: str, checkpoint: str, keys: list[str], order: list[str], files_per_trigger: int = 1) -> StreamingQuery:
    """STR-01, STR-12 over a folder of JSON lines: the state after all records is a table of the last one of each key.

    Each batch writes a new version of the state under its own number, read from that of the batch before, so a batch
    that is run again after a failure gives the same version.
    """
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(source)

    def fold(batch: DataFrame, number: int) -> None:
        last = number - 1
        current = spark.read.parquet(f"{state}/v={last}") if last >= 0 else None
        merge_latest(current, batch, keys, order).write.mode("overwrite").parquet(f"{state}/v={number}")

    return lines.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_state(spark: SparkSession, state: str, last_batch: int) -> DataFrame:
    return spark.read.parquet(f"{state}/v={last_batch}")
