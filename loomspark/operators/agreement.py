"""Labels of people and of judges side by side, and the sections that hits come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons as J
from . import supply as S

PAIR = ("query_id", "novel_id")


def one_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, then by all that is left, so that ties have one winner on any number of
    machines. An aggregation of minima, which combines before its shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def label_pairs(human: DataFrame, judged: DataFrame, order: list[str]) -> DataFrame:
    """JON-01: a row for each row of ``human`` with a label whose pair a judge labelled too.

    ``human`` has ``query_id, novel_id, relevance_label, constraint_violation`` as text, as sheets have; a blank label is
    an open row. ``judged`` has the pair, ``judge_relevance_label`` and ``judge_constraint_violation``, once for each
    system that found it: the first by ``order`` counts, and it is chosen before pairs without its label go.
    """
    filled = human.where(F.trim("relevance_label") != "").withColumns({"relevance_label": J.clamp_label("relevance_label"), "constraint_violation": J.coerce_bool("constraint_violation")})
    one = one_per(judged.select(*PAIR, "judge_relevance_label", "judge_constraint_violation", *[c for c in order if c not in PAIR]), list(PAIR), order)
    one = one.where("judge_relevance_label is not null").select(*PAIR, "judge_relevance_label", J.coerce_bool(F.col("judge_constraint_violation").cast("string")).alias("judge_constraint_violation"))
    return filled.join(one, list(PAIR))


def agreement_report(pairs: DataFrame) -> DataFrame:
    """JON-01, AGG-22: one row: pairs, weighted kappa of labels and kappa of violations with their bands, and shares."""
    label = S.kappa(pairs, "relevance_label", "judge_relevance_label", weighted=True, categories=[0, 1, 2])
    broken = S.kappa(pairs.select(*[F.col(c).cast("int").alias(c) for c in ("constraint_violation", "judge_constraint_violation")]), "constraint_violation", "judge_constraint_violation")
    left = label.select(F.col("n").alias("paired_items"), F.col("exact").alias("relevance_exact_agreement"), F.col("kappa").alias("relevance_weighted_kappa"), F.col("band").alias("relevance_kappa_band"))
    right = broken.select(F.col("kappa").alias("constraint_violation_kappa"), F.col("band").alias("constraint_violation_kappa_band"))
    return left.crossJoin(right)  # a row by a row


def checkable_verdicts(results: DataFrame, queries: DataFrame, order: list[str]) -> DataFrame:
    """JON-13: one row ``(query_id, novel_id, judge)`` for each pair with a verdict, of queries that can be checked: those
    with ``constraint_checkable`` and something ``unwanted``. A book that several systems found counts once."""
    wanted = queries.where(F.col("constraint_checkable") & (F.size("unwanted") > 0)).select("query_id").distinct()
    told = results.where("judge_constraint_violation is not null").join(wanted, "query_id", "left_semi")
    one = one_per(told.select(*PAIR, "judge_constraint_violation", *[c for c in order if c not in PAIR]), list(PAIR), order)
    return one.select(*PAIR, J.coerce_bool(F.col("judge_constraint_violation").cast("string")).alias("judge"))


def single_negative_labels(results: DataFrame, queries: DataFrame, meta: list[str], order: list[str]) -> DataFrame:
    """JON-14: one row ``(trope, novel_id, violates)`` from verdicts on queries whose only unwanted term is one of
    ``meta``. Of several verdicts on a trope and book the last by ``order`` counts; a blank verdict is none."""
    only = queries.where((F.size("unwanted") == 1) & F.get("unwanted", F.lit(0)).isin(*meta)).select("query_id", F.get("unwanted", F.lit(0)).alias("trope"))
    told = results.where(F.coalesce(F.col("judge_constraint_violation").cast("string"), F.lit("")) != "").join(only, "query_id")
    says = J.coerce_bool(F.col("judge_constraint_violation").cast("string"))
    return told.groupBy("trope", "novel_id").agg(F.max_by(says, F.struct(*order, says.alias("__says"))).alias("violates"))


def kind_report(rows: DataFrame, anchors: DataFrame, strong: DataFrame, k: int, depth: int, hit: Column) -> DataFrame:
    """AGG-06: ``(config, counter, kind, n)``: the kinds of section that found the anchors, the strong books among the first
    ``k`` rows, and all of the first ``k`` rows.

    ``rows`` has ``config, query_id, novel_id, rank, section_kind``; ``anchors`` joins on ``query_id``, and ``hit`` tells
    whether a row is its anchor's: the first such row within ``depth`` counts. Rows without a kind are left out.
    """
    first = rows.where(F.col("rank") <= depth).join(anchors, "query_id").where(hit).groupBy("config", "query_id", "anchor").agg(F.min_by("section_kind", F.struct("rank", "novel_id")).alias("kind"))
    found = first.where(F.coalesce("kind", F.lit("")) != "").groupBy("config", "kind").agg(F.count("*").alias("n")).withColumn("counter", F.lit("anchor_hits_by_kind"))
    top = S.top_k(rows, k).where(F.coalesce("section_kind", F.lit("")) != "").select("config", *PAIR, F.col("section_kind").alias("kind"))
    good = top.join(strong.select(*PAIR).distinct(), list(PAIR), "left_semi").groupBy("config", "kind").agg(F.count("*").alias("n")).withColumn("counter", F.lit("strong_hits_by_kind"))
    shown = top.groupBy("config", "kind").agg(F.count("*").alias("n")).withColumn("counter", F.lit(f"top{k}_rows_by_kind"))
    cols = ["config", "counter", "kind", "n"]
    return found.select(cols).unionByName(good.select(cols)).unionByName(shown.select(cols))
