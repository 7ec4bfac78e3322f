"""Small aggregates over sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def section_stats(sections: DataFrame, book: str) -> DataFrame:
    """AGG-15."""
    per = sections.groupBy(book).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("books"), F.sum("n").alias("sections"), F.round(F.avg("n"), 4).alias("mean_sections"), F.round(F.avg((F.col("n") == 1).cast("int")), 4).alias("single_share"))
