"""Registration of queries with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: So many rows of its largest table a task sorts, joins or groups, about.
TASK_ROWS = 200_000


def parts_of(df: DataFrame) -> int:
    """Into how many parts a table is dealt, so that what a task holds does not grow with it."""
    return -(-df.count() // TASK_ROWS)


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (session, folder) under its name, with the equivalent SQL if there is one."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLE_SQL[key] = sql.strip()
        return fn

    return add
