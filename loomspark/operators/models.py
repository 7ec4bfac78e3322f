"""The surface for models: embedders and judges as Arrow functions, caches by anti-join, budgets between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    """UDF-01: texts to vectors; the roles fall back to the plain function."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


def resolve(model: Encoder, role: str) -> Callable[[list[str]], np.ndarray]:
    """UDF-03."""
    return getattr(model, {"query": "encode_query", "document": "encode_document"}.get(role, "encode"), model.encode)


class CharHash:
    """UDF-01: a deterministic stand-in that counts characters by class."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, t in zip(out, texts):
            for c in t:
                row[ord(c) % self.dim] += 1
        return out


def encode_texts(model: Encoder, texts: list[str], batch: int = 32, normalise: bool = True, role: str = "plain", least: int = 1) -> np.ndarray:
    """UDF-02, UDF-04: vectors of texts in batches; a batch that does not fit in memory is halved. No texts: shape (0, 0)."""
    if batch <= 0:
        raise ValueError("the batch must be positive")
    if not texts:
        return np.zeros((0, 0), dtype=np.float32)
    fn, out, at = resolve(model, role), [], 0
    while at < len(texts):
        try:
            out.append(np.asarray(fn(texts[at : at + batch]), dtype=np.float32))
            at += batch
        except MemoryError:
            if batch <= least:
                raise
            batch = max(least, batch // 2)
    v = np.concatenate(out)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1) if normalise else v


def encoder_udf(make: Callable[[], Encoder], role: str = "document", batch: int = 32):
    """UDF-02: an iterator function that loads its model once for a task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            yield pd.Series(list(encode_texts(model, s.fillna("").tolist(), batch, role=role)), index=s.index)

    return run


def judge(tasks: DataFrame, cache: DataFrame | None, key: str, ask: Callable[[dict], str | None], schema: str = "raw string") -> DataFrame:
    """UDF-06, UDF-08, UDF-09, UDF-13: model answers for tasks that the cache lacks, united with what it has.

    A failed call gives no row, and so is asked again next time.
    """
    todo = tasks if cache is None else tasks.join(cache.select(key), key, "left_anti")
    kind = tasks.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for r in p.to_dict("records"):
                try:
                    answer = ask(r)
                except Exception:  # a foreign service; the failure is the absence of a row
                    answer = None
                if answer is not None:
                    rows.append((r[key], answer))
            yield pd.DataFrame(rows, columns=[key, "raw"])

    fresh = todo.mapInPandas(run, f"{key} {kind}, {schema}")
    return fresh if cache is None else cache.select(key, "raw").unionByName(fresh)


def within_budget(tasks: DataFrame, order: str, cost: Column, cap: float) -> DataFrame:
    """MTH-03, UDF-08: the first tasks, in order, whose running cost stays within the cap; micro-batches are cut so."""
    from pyspark.sql import Window

    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = tasks.withColumn("__c", cost).repartitionByRange(n, order).withColumn("__p", F.spark_partition_id())
    starts = parted.groupBy("__p").agg(F.sum("__c").alias("s"))
    starts = starts.select("__p", (F.sum("s").over(Window.orderBy("__p")) - F.col("s")).alias("__s"))  # a row per partition
    own = F.sum("__c").over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return parted.join(F.broadcast(starts), "__p").withColumn("spent", F.col("__s") + own).where(F.col("spent") <= cap).drop("__p", "__s", "__c")


def card_prompt(profile: str, vocabulary_text: str, limit: int = 60_000) -> str:
    """UDF-07, TXT-44."""
    return f"{vocabulary_text}\n\n{profile[:limit]}"


def vocabulary_text(genres: dict[str, tuple[str, ...]], elements: tuple[str, ...], styles: dict[str, tuple[str, ...]]) -> str:
    """TXT-44: the vocabulary as text."""
    lines = [f"{g}: {', '.join(s)}" for g, s in genres.items()] + [f"elements: {', '.join(elements)}"]
    return "\n".join(lines + [f"{d}: {' / '.join(o)}" for d, o in styles.items()])


def parse_weights(items: list[str]) -> dict[str, float]:
    """VEC-15."""
    out = {}
    for item in items:
        kind, sign, number = item.partition("=")
        try:
            out[kind.strip()] = float(number)
        except ValueError:
            sign = ""
        if not sign or not kind.strip():
            raise ValueError(f"expected kind=number, got {item!r}")
    return out
