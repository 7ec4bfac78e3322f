"""Whole jobs over tables: profiles, index builds, bench, pool, calibration sheet and run scores."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import calibration_sample
from ..functions.lexicon import Lexicon
from ..sources import tables as ST
from . import digest as D
from . import lexical as B
from . import scoring as SC
from . import supply as P
from . import trajectories as R
from . import vectors as V


def excerpts(text: str, lex: Lexicon, samples: int = 10, size: int = 600) -> list[str]:
    """ARR-13: an excerpt with its title of each sampled chapter; of windows where chapters are too few or give none."""
    chapters = D.split_chapters(text, lex)
    usable = D.substantive(chapters)
    picked = [chapters[usable[i]] for i in D.profile_indices(len(usable), samples)] if len(usable) >= 3 else []
    bodies = [(title.strip(), D.trim(body, size, lex.sentence_ends)) for _, title, body in picked]
    return [f"{t}\n{b}" if t else b for t, b in bodies if b] or D.window_excerpts(text, D.fractions(samples), size, lex.sentence_ends)


def build_profiles(inventory: DataFrame, texts: DataFrame, lex: Lexicon, limit: int = 8000) -> DataFrame:
    """SRC-20, SRC-21, SRC-29: profiles of readable books that are no duplicates, from their cleaned texts, with synopsis."""
    rows = inventory.where("read_status = 'ok' and not is_duplicate").select("novel_id", "title_guess", F.coalesce("author_guess", F.lit("")).alias("author"), "char_count")
    cleaned = rows.join(texts.select("novel_id", X.clean_text("text", lex)["text"].alias("text")), "novel_id")

    def fn(k, t):
        if t.strip():
            yield (D.make_profile(k[1], k[2], len(t), len(D.split_chapters(t, lex)), D.blurb_of(t, 800, lex), excerpts(t, lex), limit, lex.sentence_ends),)

    return D.over_texts(cleaned, ["novel_id", "title_guess", "author", "char_count"], "text", fn, "profile_text string").drop("author")


def build_index(sections: DataFrame, path: str, overwrite: bool = False, most_single: float = 0.5) -> DataFrame:
    """SVC-08, SVC-09: section vectors as a table; refused if more books than allowed have a single section."""
    stats = SC.section_stats(sections, "novel_id").first()
    if stats.single_share is not None and stats.single_share > most_single:
        raise ValueError(f"{stats.single_share:.0%} of the books have one section only")
    ST.save_index(sections, path, overwrite)
    return ST.load_index(sections.sparkSession, path)


def derive_single_index(spark: SparkSession, source: str, target: str, weights: dict[str, float] | None = None, kind_mean: bool = False, overwrite: bool = False) -> DataFrame:
    """VEC-14: one pooled vector per book from a stored index of sections."""
    ST.save_index(V.pool_books(ST.load_index(spark, source), "novel_id", "kind", weights=weights, kind_mean=kind_mean), target, overwrite)
    return ST.load_index(spark, target)


def vectors_in_order(vectors: DataFrame, order: str) -> DataFrame:
    """VEC-16: an index's vectors in row order; an empty one is an error."""
    if vectors.isEmpty():
        raise ValueError("the index is empty")
    return vectors.orderBy(order)


def searchers(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that a folder holds, by what they serve; none is an error. See `searchers.load` for what searches them."""
    found = {}
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in ("single", "multi", "documents"):
        if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")):
            found[name] = spark.read.parquet(f"{folder}/{name}")
    if not found:
        raise ValueError(f"no searcher in {folder}")
    return found


def run_bench(rankings: dict[str, DataFrame], anchors: DataFrame, ks: list[int], depth: int) -> DataFrame:
    """SVC-10: anchor metrics of several rankings ``(query_id, rank, novel_id, title)``."""
    rows = None
    for name, r in rankings.items():
        r = r.withColumn("config", F.lit(name))
        rows = r if rows is None else rows.unionByName(r)
    return P.anchor_metrics(P.anchor_ranks(rows, anchors), ks, depth)


def build_pool(queries: DataFrame, docs: DataFrame, depth: int) -> DataFrame:
    """SVC-11: lexical candidates of every query, as one configuration of a pool. See `searchers.build_pool` for all."""
    return B.search(queries, docs, depth, "query_id", "query", "novel_id", "text").withColumn("config", F.lit("lexical"))


def judging_estimate(pairs: DataFrame, evidence: str, query: str, per_million: tuple[float, float], answer: int = 60) -> DataFrame:
    """SVC-12: what judging would take, before any call."""
    t = P.prompt_tokens(evidence, query)
    return pairs.agg(F.count("*").alias("pairs"), F.sum(t).alias("prompt_tokens"), F.round(F.sum(P.cost(t, F.lit(answer), *per_million)), 6).alias("cost"))


def calibration_sheet(verdicts: DataFrame, pool: DataFrame, n: int, seed: str = "7") -> DataFrame:
    """SVC-13: pairs to be labelled by hand, evenly over verdicts, with their titles."""
    picked = calibration_sample(verdicts, ["positive", "violated"], ["query_id", "novel_id"], n, seed)
    return picked.select("query_id", "novel_id").join(pool.groupBy("query_id", "novel_id").agg(F.min("title").alias("title")), ["query_id", "novel_id"], "left").withColumns({"label": F.lit(None).cast("int"), "notes": F.lit("")})


def score_sheet(sheet: DataFrame, verdicts: DataFrame) -> DataFrame:
    """SVC-14."""
    j = sheet.where(F.col("label").isNotNull()).join(verdicts, ["query_id", "novel_id"])
    return P.kappa(j, "label", "positive", weighted=True, categories=[0, 1, 2], degenerate="null")


def score_run(trajectories: DataFrame, violations: DataFrame, tasks: DataFrame, least: int = 1) -> DataFrame:
    """SVC-15, EVL-14: passes of a run, overall and by kind and variant."""
    scores = R.score_tasks(R.score_sessions(trajectories, violations, least=least))
    steps = trajectories.groupBy("task_id").agg(F.sum(F.size("steps")).alias("steps"))
    return P.task_summary(scores.join(steps, "task_id").join(tasks.select("task_id", "kind", "variant"), "task_id"))


def check_trope(cards: DataFrame, rules: dict[str, dict], cache: DataFrame, tropes: list[str]) -> DataFrame:
    """By book and trope, the card's word, else the cached verdict, else null, which is left to a model."""
    from .cards import card_verdict

    out = None
    for t in tropes:
        v = card_verdict(t, rules)
        part = cards.select("novel_id", F.lit(t).alias("trope"), v["verdict"].alias("by_card"))
        out = part if out is None else out.unionByName(part)
    return out.join(cache.withColumnRenamed("verdict", "cached"), ["novel_id", "trope"], "left").select("novel_id", "trope", F.coalesce("by_card", "cached").alias("verdict"), F.when(F.col("by_card").isNotNull(), "card").when(F.col("cached").isNotNull(), "cache").alias("source"))


def worker_count(asked: int | None = None) -> int:
    """SVC-17: for work on the driver only."""
    return max(1, min(asked or os.cpu_count() or 1, 32))


def now() -> str:
    """MTH-05."""
    return dt.datetime.now(dt.UTC).isoformat(timespec="seconds")

