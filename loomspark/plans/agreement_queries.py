"""Labels of people beside those of judges, over pools made of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as G
from ..operators import supply as S
from .base import query, table
from .supply_queries import P, _A, _N, anchors, rows, verdicts

#: Sheets hold text; one row in three is still open. Judges found a pair once for each configuration.
_LABELS = """hs AS (SELECT query_id, novel_id, CASE (query_id + novel_id) % 3 WHEN 0 THEN '' ELSE ((query_id + 2 * novel_id) % 4)::VARCHAR END AS label, CASE query_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'TRUE' ELSE 'no' END AS broken FROM (SELECT DISTINCT query_id, novel_id FROM pool)),
js AS (SELECT query_id, novel_id, config, rank, CASE WHEN (novel_id + rank) % 5 > 0 THEN ((novel_id + rank) % 3)::INTEGER END AS label, CASE (novel_id + rank) % 4 WHEN 0 THEN 'True' WHEN 1 THEN NULL ELSE 'False' END AS broken FROM pool),
j1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, novel_id ORDER BY config, rank) AS n FROM js) WHERE n = 1),
qs AS (SELECT o_orderkey AS query_id, o_custkey % 3 > 0 AS checkable, CASE o_orderkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['dark'] WHEN 2 THEN ['harem'] ELSE ['harem', 'dark'] END AS unwanted FROM orders)"""


def sheet(spark, sf):
    q, n = F.col("query_id"), F.col("novel_id")
    label = F.when((q + n) % 3 == 0, "").otherwise(((q + 2 * n) % 4).cast("string"))
    pairs = rows(spark, sf).select("query_id", "novel_id").distinct()
    return pairs.select("query_id", "novel_id", label.alias("relevance_label"), F.when(q % 4 == 0, "yes").when(q % 4 == 1, "TRUE").otherwise("no").alias("constraint_violation"))


def judged(spark, sf):
    m = F.col("novel_id") + F.col("rank")
    return rows(spark, sf).select(
        "query_id", "novel_id", "config", "rank", F.when(m % 5 > 0, (m % 3).cast("int")).alias("judge_relevance_label"),
        F.when(m % 4 == 0, "True").when(m % 4 == 1, F.lit(None)).otherwise("False").alias("judge_constraint_violation"),
    )


def asked(spark, sf):
    k = F.col("o_orderkey") % 4
    unwanted = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("dark"))).when(k == 2, F.array(F.lit("harem"))).otherwise(F.array(F.lit("harem"), F.lit("dark")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 3 > 0).alias("constraint_checkable"), unwanted.alias("unwanted"))


_PAIRS = """hp AS (SELECT query_id, novel_id, least(2, hs.label::INTEGER) AS relevance_label, hs.broken IN ('yes', 'TRUE') AS constraint_violation, j1.label AS judge_relevance_label, coalesce(j1.broken, '') = 'True' AS judge_constraint_violation FROM hs JOIN j1 USING (query_id, novel_id) WHERE hs.label <> '' AND j1.label IS NOT NULL)"""


@query(f"WITH {P}, {_LABELS}, {_PAIRS} SELECT * FROM hp")
def label_pairs(spark, sf):
    """JON-01."""
    return G.label_pairs(sheet(spark, sf), judged(spark, sf), ["config", "rank"])


def _kappa(a: str, b: str, w: str) -> str:
    """SQL for one row ``(n, same, kappa)``."""
    return f"""(WITH c AS (SELECT {a}::INTEGER AS a, {b}::INTEGER AS b, count(*) AS n FROM hp GROUP BY 1, 2), pa AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), pb AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS t FROM c)
SELECT max(t)::BIGINT AS n, round(sum(CASE WHEN a = b THEN coalesce(n, 0) END) / max(t), 4) AS same, round(1 - sum({w} * coalesce(n, 0) / t) / sum({w} * na * nb / (t * t)), 4) AS kappa FROM pa CROSS JOIN pb LEFT JOIN c USING (a, b) CROSS JOIN t)"""


_BAND = "CASE WHEN {0} IS NULL THEN 'undefined' WHEN {0} < 0 THEN 'worse than chance' WHEN {0} < 0.2 THEN 'slight' WHEN {0} < 0.4 THEN 'fair' WHEN {0} < 0.6 THEN 'moderate' WHEN {0} < 0.8 THEN 'substantial' ELSE 'almost perfect' END"


@query(f"""WITH {P}, {_LABELS}, {_PAIRS}, l AS {_kappa("relevance_label", "judge_relevance_label", "(abs(a - b) / 2.0)")}, v AS {_kappa("constraint_violation", "judge_constraint_violation", "(a <> b)::INTEGER")}
SELECT l.n AS paired_items, l.same AS relevance_exact_agreement, l.kappa AS relevance_weighted_kappa, {_BAND.format("l.kappa")} AS relevance_kappa_band, v.kappa AS constraint_violation_kappa, {_BAND.format("v.kappa")} AS constraint_violation_kappa_band FROM l, v""")
def agreement_report(spark, sf):
    """JON-01, AGG-19 to AGG-23: the report over the pairs."""
    return G.agreement_report(G.label_pairs(sheet(spark, sf), judged(spark, sf), ["config", "rank"]))


@query(f"""WITH {P}, {_LABELS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, novel_id ORDER BY config, rank) AS m FROM js WHERE broken IS NOT NULL AND query_id IN (SELECT query_id FROM qs WHERE checkable AND len(unwanted) > 0))
SELECT query_id, novel_id, broken = 'True' AS judge FROM o WHERE m = 1""")
def checkable_verdicts(spark, sf):
    """JON-13."""
    return G.checkable_verdicts(judged(spark, sf), asked(spark, sf), ["config", "rank"])


@query(f"""WITH {P}, {_LABELS} SELECT unwanted[1] AS trope, novel_id, arg_max(broken = 'True', (query_id, config, rank)) AS violates FROM js JOIN qs USING (query_id) WHERE broken IS NOT NULL AND len(unwanted) = 1 AND unwanted[1] = 'harem' GROUP BY 1, 2""")
def single_negative_labels(spark, sf):
    """JON-14."""
    return G.single_negative_labels(judged(spark, sf), asked(spark, sf), ["harem", "cheating"], ["query_id", "config", "rank"])


_KIND = "CASE (novel_id + rank) % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'synopsis' WHEN 2 THEN 'chapter' ELSE '' END"


@query(f"""WITH {P}, {_A}, r AS (SELECT *, {_KIND} AS section_kind FROM rows), f AS (SELECT r.config, query_id, anchor, arg_min(section_kind, (rank, novel_id)) AS kind FROM r JOIN a USING (query_id) WHERE rank <= 6 AND starts_with({_N('title')}, {_N('anchor')}) GROUP BY 1, 2, 3),
top AS (SELECT * FROM r WHERE rank <= 3 AND section_kind <> ''), s AS (SELECT DISTINCT query_id, novel_id FROM jd WHERE positive = 2)
SELECT config, 'anchor_hits_by_kind' AS counter, kind, count(*) AS n FROM f WHERE kind <> '' GROUP BY 1, 3
UNION ALL SELECT config, 'strong_hits_by_kind', section_kind, count(*) FROM top SEMI JOIN s USING (query_id, novel_id) GROUP BY 1, 3
UNION ALL SELECT config, 'top3_rows_by_kind', section_kind, count(*) FROM top GROUP BY 1, 3""")
def kind_report(spark, sf):
    """AGG-06."""
    r = rows(spark, sf).withColumn("section_kind", F.expr(_KIND))
    v = verdicts(spark, sf).where(S.is_strong("positive"))
    return G.kind_report(r, anchors(spark, sf), v, 3, 6, S.title_matches_anchor("title", "anchor"))
