"""Files that people and other programs read: pools as two JSON sinks, results as CSV and JSON, sheets with their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .tables import require

#: What spreadsheets look for at the start of a CSV file in UTF-8.
BYTE_ORDER_MARK = "\ufeff"


def write_csv(rows: DataFrame, path: str) -> None:
    """SRC-29, SRC-36: CSV files with a byte order mark, each with a header. The mark is the beginning of the header, so
    writers need nothing but their own rows. Quotes are doubled, as other readers expect; a null is an empty cell."""
    first, *rest = rows.columns
    rows.withColumnRenamed(first, BYTE_ORDER_MARK + first).write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of a folder, such as :func:`write_csv` makes, as text: cells may hold line ends, and the mark is no part of a name."""
    rows = spark.read.option("header", "true").option("recursiveFileLookup", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return rows.toDF(*[c.lstrip(BYTE_ORDER_MARK) for c in rows.columns])


def write_pool(rows: DataFrame, queries: DataFrame, folder: str) -> None:
    """SRC-25: the rows and the queries of a pool, in two folders of JSON lines that take the place of older ones."""
    require(rows, ["query_id", "config", "rank", "novel_id"])
    require(queries, ["query_id"])
    queries.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/queries.jsonl")
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/pool.jsonl")


def write_results(rows: DataFrame, folder: str) -> tuple[str, str]:
    """SRC-29: results as CSV and as JSON lines; the two paths. Nested fields stand in the CSV as JSON text."""
    table, lines = f"{folder}/eval_results.csv", f"{folder}/eval_results.jsonl"
    nested = [c for c, t in rows.dtypes if t.startswith(("array", "map", "struct"))]
    write_csv(rows.withColumns({c: F.to_json(c) for c in nested}), table)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(lines)
    return table, lines


LABELS = ("relevance_label", "constraint_violation", "notes")


def write_filled_sheet(sheet: DataFrame, labels: DataFrame, path: str) -> int:
    """SRC-36: the sheet with the labels of its pairs, written as CSV; how many rows have a label.

    Rows without one have empty cells, whatever stood in them before. ``labels`` holds one row for each pair, as
    ``state.latest`` leaves them. The count is taken while the rows are written.
    """
    given = labels.select("query_id", "novel_id", *[F.col(c).cast("string").alias(c) for c in LABELS])
    rows = sheet.drop(*LABELS).join(given, ["query_id", "novel_id"], "left").fillna("", list(LABELS))
    rows = rows.select([c for c in sheet.columns if c not in LABELS] + list(LABELS))
    seen = Observation()
    write_csv(rows.observe(seen, F.count_if(F.col("relevance_label") != "").alias("filled")), path)
    return int(seen.get["filled"] or 0)
