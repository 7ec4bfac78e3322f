"""Documents that are hard on every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, rank int, keys string"


def documents(spark: SparkSession, texts: list[tuple[int | None, str | None]]) -> DataFrame:
    """Documents with extra columns whose names clash with those the operators use; nulls in all of them."""
    rows = [(i, t, "en" if k % 3 else None, None, len(t) if t else None, None, None, None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def words(n: int, seed: int = 0) -> list[str]:
    import random

    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(n)]


ODD = [(None, "no id here"), (7, None), (8, ""), (9, " \n\t "), (10, "word"), (10, "word"), (11, "é🙂 ▁ \x00 ß"), (12, "long " * 30_000)]
