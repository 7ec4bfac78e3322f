"""Asking a model about many rows: concurrent calls in order, a cache of answers, and a cap on what may be spent.

A run goes through its open rows in micro-batches. Before each batch the money that is left is dealt out to its tasks, and a
task begins a call only while its share covers the worst price of every call under way; so no schedule of calls can pass the
cap. What a batch found is written before the next begins. A run that stops, or is stopped, goes on from what is written.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What came of a row: an answer, an answer that doesn't parse, a call that failed, or no call for lack of money.
JUDGED, UNPARSED, FAILED, SKIPPED = "judged", "unparsed", "failed", "skipped"

_LOG = "status string, raw string, error string, cost double, run int, batch int"


@dataclass(frozen=True)
class Answer:
    """What a call returns: its text and its price."""

    text: str
    cost: float = 0.0


@dataclass(frozen=True)
class RunSummary:
    """UDF-08: what a run did, and whether the cap stopped it."""

    requested: int
    cache_hits: int
    judged: int
    failed: int
    unparsed: int
    skipped_over_budget: int
    spent: float

    @property
    def stopped_early(self) -> bool:
        return self.skipped_over_budget > 0


def in_order(fn: Callable, items: Iterable, workers: int) -> Iterator:
    """UDF-06: results of concurrent calls in the order of their items. No more than twice as many items as there are
    workers are taken ahead of the result that is waited for."""
    if workers <= 1:
        yield from map(fn, items)
        return
    with ThreadPoolExecutor(workers) as pool:
        window: deque = deque()
        for item in items:
            window.append(pool.submit(fn, item))
            if len(window) >= 2 * workers:
                yield window.popleft().result()
        while window:
            yield window.popleft().result()


class _Share:
    """A task's money. A call takes its worst price beforehand and gives back what it did not cost."""

    def __init__(self, money: float):
        import threading

        self.left, self.lock = money, threading.Lock()

    def take(self, worst: float) -> bool:
        with self.lock:
            if worst > self.left + 1e-12:
                return False
            self.left -= worst
            return True

    def give_back(self, money: float) -> None:
        with self.lock:
            self.left += money


def _asker(ask: Callable[[str], Answer], parses: Callable[[str], bool], share: _Share) -> Callable[[tuple[str, float]], tuple]:
    def one(item: tuple[str, float]) -> tuple:
        prompt, worst = item
        if not share.take(worst):
            return SKIPPED, None, None, 0.0
        try:
            answer = ask(prompt)
        except Exception as e:  # a foreign service: one dead request must not end the run
            share.give_back(worst)
            return FAILED, None, f"{type(e).__name__}: {e}"[:200], 0.0
        share.give_back(worst - answer.cost)
        try:
            good = parses(answer.text)
        except (ValueError, TypeError, KeyError) as e:
            return UNPARSED, answer.text, f"{type(e).__name__}: {e}"[:200], answer.cost
        return (JUDGED if good else UNPARSED), answer.text, None, answer.cost

    return one


def _asked(rows: DataFrame, key: str, prompt: str, worst: str, ask: Callable[[str], Answer], parses: Callable[[str], bool], share: float, workers: int) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = _asker(ask, parses, _Share(share))
        for p in parts:
            done = list(in_order(one, zip(p[prompt], p[worst]), workers))
            yield pd.DataFrame({key: p[key].to_numpy(), **{c: [d[i] for d in done] for i, c in enumerate(("status", "raw", "error", "cost"))}})

    return rows.select(key, prompt, worst).mapInPandas(run, f"{key} {kind}, status string, raw string, error string, cost double")


def log_of(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """All calls that were written under a folder; none if there is no such folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = f"{key} {kind}, {_LOG}"
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def answers(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """The cache: one parsed answer for each key, the first that was given. Failures are never answers."""
    rows = log_of(spark, path, key, kind).where(F.col("status") == JUDGED)
    return rows.groupBy(key).agg(F.min_by("raw", F.struct("run", "batch")).alias("raw"))


def judge_within(
    tasks: DataFrame, path: str, key: str, prompt: str, ask: Callable[[str], Answer], worst: Column, cap: float, parses: Callable[[str], bool] = bool,
    workers: int = 4, parts: int = 8, batch_rows: int = 10_000, affordable: bool = False,
) -> RunSummary:
    """UDF-06, UDF-08, UDF-09: ask about every row whose key has no answer yet, without ever spending more than ``cap``.

    ``worst`` is the most that a row's call can cost; no call is begun that the money left could not pay for at that price.
    ``cap`` holds for this run; answers of earlier runs cost nothing. With ``affordable``, a run whose worst prices add up to
    more than the cap is refused before the first call. Rows that share a key are asked once; null keys are left out. A row
    whose call failed, or whose answer does not parse, is written as such and asked again by the next run, not by this one.
    """
    spark, kind = tasks.sparkSession, tasks.schema[key].dataType.simpleString()
    named = tasks.where(F.col(key).isNotNull()).select(key, F.col(prompt).cast("string").alias("__prompt"), worst.cast("double").alias("__worst"))
    unique = named.groupBy(key).agg(F.min(F.struct("__prompt", "__worst")).alias("x")).select(key, "x.*")
    requested = unique.count()
    todo = unique.join(answers(spark, path, key, kind).select(key), key, "left_anti")
    size = todo.agg(F.count("*").alias("n"), F.coalesce(F.sum("__worst"), F.lit(0.0)).alias("worst")).first()
    if affordable and size["worst"] > cap:
        raise ValueError(f"{size['n']} calls may cost {size['worst']:.4f}, and the cap is {cap:.4f}")
    number = log_of(spark, path, key, kind).agg(F.coalesce(F.max("run"), F.lit(-1))).first()[0] + 1
    n_batches = max(1, -(-size["n"] // batch_rows))
    totals = {JUDGED: 0, FAILED: 0, UNPARSED: 0, SKIPPED: 0}
    spent = 0.0

    def batch(rows: DataFrame, at: int, tasks_of_batch: int) -> None:
        nonlocal spent
        done = _asked(rows.repartition(tasks_of_batch, key), key, "__prompt", "__worst", ask, parses, (cap - spent) / tasks_of_batch, workers)
        out = f"{path}/run={number}/batch={at}"
        done.write.mode("overwrite").parquet(out)
        for r in spark.read.parquet(out).groupBy("status").agg(F.count("*").alias("n"), F.sum("cost").alias("cost")).collect():
            totals[r["status"]] += r["n"]
            spent += r["cost"]

    if size["n"]:
        # What earlier batches write must not change which rows a later one takes, so the open rows are those of the start.
        started = log_of(spark, path, key, kind).where((F.col("status") == JUDGED) & (F.col("run") < number)).select(key).distinct()
        opened = unique.join(started, key, "left_anti").withColumn("__batch", F.pmod(F.xxhash64(key), F.lit(n_batches)))
        for at in range(n_batches):
            batch(opened.where(F.col("__batch") == at), at, parts)
        # Rows that only their own task's share could not pay for: one task gets all that is left.
        short = log_of(spark, path, key, kind).where((F.col("run") == number) & (F.col("status") == SKIPPED)).select(key)
        least = opened.join(short, key, "left_semi").agg(F.min("__worst")).first()[0]
        if least is not None and least <= cap - spent:
            again = opened.join(short, key, "left_semi")
            totals[SKIPPED] = 0
            batch(again, n_batches, 1)
    return RunSummary(requested, requested - size["n"], totals[JUDGED], totals[FAILED], totals[UNPARSED], totals[SKIPPED], spent)
