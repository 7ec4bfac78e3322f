"""Evaluation queries over a pool made of line items, verdicts made of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import supply as S
from .base import parts_of, query, table
from .ingest_queries import POOL, pool

P = POOL + """, vd AS (SELECT p_partkey AS novel_id, (p_size % 3)::INTEGER AS positive, p_size % 7 = 0 AS violated FROM part WHERE p_size % 5 > 0),
rows AS (SELECT pool.*, p_name AS title, o_orderpriority AS kind, o_custkey AS task_id FROM pool JOIN part ON novel_id = p_partkey JOIN orders ON query_id = o_orderkey),
jd AS (SELECT rows.*, positive, violated, CASE WHEN positive IS NOT NULL THEN (positive >= 2 AND NOT violated)::INTEGER END AS strict, CASE WHEN positive IS NOT NULL THEN (positive >= 1 AND NOT violated)::INTEGER END AS lenient FROM rows LEFT JOIN vd USING (novel_id))"""


def dealt(spark, sf):
    """Into how many parts the pool, the largest table here, is dealt."""
    return parts_of(table(spark, sf, "lineitem"))


def rows(spark, sf):
    n = dealt(spark, sf)
    parts = S.spread(table(spark, sf, "part").select(F.col("p_partkey").alias("novel_id"), F.col("p_name").alias("title")), n, "novel_id")
    orders = S.spread(table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("task_id")), n, "query_id")
    return pool(spark, sf, n).join(parts, "novel_id").join(orders, "query_id")


def by_book(spark, sf):
    p = table(spark, sf, "part").where("p_size % 5 > 0")
    return p.select(F.col("p_partkey").alias("novel_id"), (F.col("p_size") % 3).alias("positive"), (F.col("p_size") % 7 == 0).alias("violated"))


def verdicts(spark, sf):
    n = dealt(spark, sf)
    pairs = S.spread(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("novel_id")), n, "query_id", "novel_id").distinct()
    return S.spread(pairs.join(S.spread(by_book(spark, sf), n, "novel_id"), "novel_id"), n, "query_id", "novel_id")


@query(f"WITH {P} SELECT task_id AS request_id, novel_id, arg_min(title, (rank, config, title)) AS title FROM rows WHERE rank <= 3 GROUP BY 1, 2")
def pool_pairs(spark, sf):
    """SET-01, WIN-01."""
    return S.pool_pairs(rows(spark, sf).withColumnRenamed("task_id", "request_id"), 3)


@query(f"""WITH {P}, q AS (SELECT config, query_id, count(*) AS n, count(positive) AS judged, avg((positive = 2)::INTEGER) AS s, avg((positive >= 1)::INTEGER) AS l, sum(strict) AS u, sum(lenient) AS ul FROM jd WHERE rank <= 4 GROUP BY 1, 2)
SELECT config, count(*) FILTER (judged > 0) AS queries, round(avg(s), 4) AS precision_strict, round(avg(l), 4) AS precision_lenient, round(sum(judged) / sum(n), 4) AS coverage,
round(avg(CASE WHEN judged > 0 THEN (u >= 3)::INTEGER END), 4) AS feasible_strict, round(avg(CASE WHEN judged > 0 THEN (ul >= 3)::INTEGER END), 4) AS feasible_lenient FROM q GROUP BY 1 HAVING queries > 0""")
def judged_metrics(spark, sf):
    """JON-08, AGG-27, FLT-19."""
    return S.judged_metrics(rows(spark, sf), verdicts(spark, sf), 4, parts=dealt(spark, sf))


@query(f"""WITH {P}, q AS (SELECT kind, query_id, count(*) AS n, count(positive) AS j, count(*) FILTER (positive = 2) AS s, count(*) FILTER (positive >= 1) AS l, count(*) FILTER (violated) AS v, coalesce(sum(lenient), 0) AS u FROM jd WHERE rank <= 3 GROUP BY 1, 2)
SELECT coalesce(kind, 'all') AS kind, count(*) FILTER (j > 0) AS sessions, sum(n)::BIGINT AS recommended, round(sum(j) / sum(n), 4) AS coverage, round(sum(s) / sum(j), 4) AS strict, round(sum(l) / sum(j), 4) AS lenient, round(sum(v) / sum(j), 4) AS violation,
round(sum(u) / sum(j), 4) AS usable, round(avg(CASE WHEN j > 0 THEN (u = j)::INTEGER END), 4) AS all_usable FROM q GROUP BY GROUPING SETS ((), (kind))""")
def recommendation_metrics(spark, sf):
    """JON-09."""
    return S.recommendation_metrics(rows(spark, sf).where("rank <= 3"), verdicts(spark, sf), dealt(spark, sf))


@query(f"WITH {P}, q AS (SELECT task_id, query_id, count(DISTINCT CASE WHEN lenient = 1 THEN novel_id END) AS u FROM jd WHERE rank <= 5 AND positive IS NOT NULL GROUP BY 1, 2) SELECT task_id, bool_and(u >= 2) AS feasible, count(*) AS requests FROM q GROUP BY 1")
def request_feasibility(spark, sf):
    """AGG-09."""
    return S.request_feasibility(rows(spark, sf), verdicts(spark, sf), 5, 2, False)


_N = lambda e: f"lower(regexp_replace({e}, '[《》〈〉「」『』\\[\\]【】\\s_-]+', '', 'g'))"
_K = lambda e: f"regexp_replace({e}, '[\\s《》〈〉<>「」『』]', '', 'g')"
_A = f"""a AS (SELECT o_orderkey AS query_id, p_name[1:5] AS anchor FROM orders JOIN part ON p_partkey = 1 + o_orderkey % (SELECT count(*) FROM part)),
ap AS (SELECT DISTINCT config, query_id FROM pool), b AS (SELECT config, query_id, anchor, min(rank) AS rank FROM a JOIN rows USING (query_id) WHERE starts_with({_N('title')}, {_N('anchor')}) GROUP BY 1, 2, 3),
ar AS (SELECT config, query_id, anchor, rank FROM a JOIN ap USING (query_id) LEFT JOIN b USING (config, query_id, anchor))"""


def anchors(spark, sf):
    p = table(spark, sf, "part")
    n = p.count()
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), (1 + F.col("o_orderkey") % n).alias("p_partkey"))
    parts = dealt(spark, sf)
    names = S.spread(p.select("p_partkey", "p_name"), parts, "p_partkey")
    return S.spread(o.join(names, "p_partkey").select("query_id", F.substring("p_name", 1, 5).alias("anchor")), parts, "query_id")


@query(f"WITH {P}, {_A} SELECT config, query_id, anchor, rank FROM ar")
def anchor_hit_recall(spark, sf):
    """AGG-03, AGG-07, FLT-17, JON-02."""
    return S.anchor_ranks(rows(spark, sf), anchors(spark, sf))


@query(f"WITH {P}, {_A} SELECT config, count(*) AS anchors, round(avg((coalesce(rank <= 1, false))::INTEGER), 4) AS hit_1, round(avg((coalesce(rank <= 5, false))::INTEGER), 4) AS hit_5, quantile_cont(coalesce(rank, 11), 0.5) AS median_rank, count(*) FILTER (rank IS NULL) AS unfound FROM ar GROUP BY 1")
def anchor_rank_stats(spark, sf):
    """AGG-04, AGG-05."""
    return S.anchor_metrics(S.anchor_ranks(rows(spark, sf), anchors(spark, sf)), [1, 5], 10)


_FOLD = "CASE WHEN anchor < 'g' THEN 'train' WHEN anchor < 'n' THEN 'eval' END"


@query(f"""WITH {P}, {_A}, t AS (SELECT *, '*' AS fold FROM ar UNION ALL SELECT *, coalesce({_FOLD}, 'unknown') FROM ar),
q AS (SELECT config, fold, query_id, count(*) AS n, min(rank) FILTER (rank <= 5) AS first, count(*) FILTER (rank <= 1) AS f1, count(*) FILTER (rank <= 5) AS f5 FROM t GROUP BY 1, 2, 3)
SELECT config, fold, count(*) AS queries, sum(n)::BIGINT AS anchors, round(avg((f1 > 0)::INTEGER), 4) AS hit_1, round(sum(f1) / sum(n), 4) AS recall_1, round(avg((f5 > 0)::INTEGER), 4) AS hit_5, round(sum(f5) / sum(n), 4) AS recall_5, round(avg(first), 4) AS mean_first_rank FROM q GROUP BY 1, 2""")
def anchor_summary(spark, sf):
    """AGG-02: by query and by anchor, in all and by fold."""
    a = anchors(spark, sf)
    folds = a.select("anchor").distinct().select("anchor", F.when(F.col("anchor") < "g", "train").when(F.col("anchor") < "n", "eval").alias("fold")).where("fold is not null")
    return S.anchor_summary(S.anchor_ranks(rows(spark, sf), a), [1, 5], folds, dealt(spark, sf))


@query(f"WITH {P}, s AS (SELECT DISTINCT query_id, novel_id FROM jd WHERE positive = 2), h AS (SELECT DISTINCT query_id, novel_id, 1 AS hit FROM pool WHERE rank <= 2) SELECT query_id, round(sum(coalesce(hit, 0)) / count(*), 4) AS recall FROM s LEFT JOIN h USING (query_id, novel_id) GROUP BY 1")
def strong_recall(spark, sf):
    """JON-02, FLT-18."""
    v = verdicts(spark, sf)
    return S.strong_recall(rows(spark, sf), v.where(S.is_strong("positive")).select("query_id", "novel_id"), 2)


@query(f"""WITH {P}, j AS (SELECT rows.config, rows.query_id, p_type, p_brand, string_split(p_name, ' ') AS e, p_size % 9 > 0 AS carded, CASE WHEN p_size >= 40 THEN true WHEN p_size <= 20 THEN false END AS violation, o_orderstatus AS st, (SELECT min(p_type) FROM part) AS g0, (SELECT min(p_brand) FROM part) AS b0, (SELECT min(string_split(p_name, ' ')[1]) FROM part) AS e0
 FROM rows JOIN part ON novel_id = p_partkey JOIN orders ON query_id = o_orderkey WHERE rank <= 5),
q AS (SELECT config, query_id, avg(CASE WHEN carded AND st = 'F' THEN (p_type = g0 OR p_brand = b0)::INTEGER END) AS g, avg(CASE WHEN carded AND st IN ('F', 'O') THEN list_contains(e, e0)::INTEGER END) AS x, avg((NOT violation)::INTEGER) AS c FROM j GROUP BY 1, 2)
SELECT config, count(*) AS queries, round(avg(g), 4) AS genre_consistency, count(g) AS genre_queries, round(avg(x), 4) AS element_consistency, count(x) AS element_queries, round(avg(c), 4) AS density_clean, count(c) AS clean_queries FROM q GROUP BY 1""")
def judge_free_metrics(spark, sf):
    """AGG-08."""
    p = table(spark, sf, "part")
    cards = p.where("p_size % 9 > 0").select(F.col("p_partkey").alias("novel_id"), F.col("p_type").alias("genre"), F.col("p_brand").alias("subgenre"), F.split("p_name", " ").alias("elements"))
    dense = p.select(F.col("p_partkey").alias("novel_id"), F.when(F.col("p_size") >= 40, True).when(F.col("p_size") <= 20, False).alias("violation"))
    g, b, e = p.agg(F.min("p_type"), F.min("p_brand"), F.min(F.split("p_name", " ")[0])).first()
    none = F.array().cast("array<string>")
    strict = F.col("o_orderstatus") == "F"
    wish = [F.when(strict, F.array(F.lit(g))).otherwise(none).alias("genres"), F.when(strict, F.array(F.lit(b))).otherwise(none).alias("subgenres"), F.array(F.lit(e)).alias("elements")]
    wanted = table(spark, sf, "orders").where("o_orderstatus in ('F', 'O')").select(F.col("o_orderkey").alias("query_id"), *wish)
    n = dealt(spark, sf)
    return S.judge_free_metrics(rows(spark, sf), S.spread(cards, n, "novel_id"), S.spread(dense, n, "novel_id"), wanted, 5, n)


@query(f"""WITH {P}, s AS (SELECT config, task_id, query_id, list(DISTINCT novel_id) AS s FROM rows WHERE rank <= 5 GROUP BY 1, 2, 3)
SELECT a.config, count(*) AS pairs, round(avg(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))), 4) AS overlap FROM s a JOIN s b ON a.config = b.config AND a.task_id = b.task_id AND a.query_id < b.query_id GROUP BY 1""")
def pairwise_jaccard(spark, sf):
    """AGG-08: overlap of the queries of one task."""
    return S.pairwise_jaccard(rows(spark, sf), 5)


@query(f"WITH {P} SELECT config, count(*) AS n, round(avg((positive >= 1)::INTEGER), 4) AS precision, round(avg((positive = 2)::INTEGER), 4) AS strong, round(avg(positive), 4) AS mean_label, round(avg(violated::INTEGER), 4) AS violation FROM jd WHERE rank <= 10 AND positive IS NOT NULL GROUP BY 1")
def precision_by_variant(spark, sf):
    """AGG-01."""
    j = S.judged(rows(spark, sf), verdicts(spark, sf), ["query_id", "novel_id"]).where("positive is not null").withColumnRenamed("positive", "label")
    return S.manual_metrics(j, 10)


_R = "r AS (SELECT l.doc_id, quality, toxic, (n_chars > 1500)::INTEGER AS rule, (n_chars // 1200 % 3)::INTEGER AS c3, quality + (l.doc_id % 2)::INTEGER AS d3 FROM labels l JOIN documents USING (doc_id))"


def raters(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    j = table(spark, sf, "labels").join(d, "doc_id")
    return j.select("doc_id", "quality", "toxic", (F.col("n_chars") > 1500).cast("int").alias("rule"), (F.floor(F.col("n_chars") / 1200) % 3).cast("int").alias("c3"), (F.col("quality") + F.col("doc_id") % 2).cast("int").alias("d3"))


@query(f"WITH {_R} SELECT quality AS a, rule AS b, count(*) AS n FROM r GROUP BY 1, 2")
def confusion(spark, sf):
    """AGG-18."""
    return S.confusion(raters(spark, sf), "quality", "rule")


def _kappa_sql(a: str, b: str, w: str) -> str:
    return f"""WITH {_R}, t AS (SELECT count(*)::DOUBLE AS t FROM r), pa AS (SELECT {a} AS a, count(*) AS na FROM r GROUP BY 1), pb AS (SELECT {b} AS b, count(*) AS nb FROM r GROUP BY 1), c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM r GROUP BY 1, 2),
g AS (SELECT sum({w} * coalesce(n, 0) / t) AS seen, sum({w} * na * nb / (t * t)) AS chance, sum(CASE WHEN a = b THEN coalesce(n, 0) END) AS same, max(t)::BIGINT AS n FROM (SELECT * FROM pa CROSS JOIN pb) g0 LEFT JOIN c USING (a, b) CROSS JOIN t),
k AS (SELECT n, round(same / n, 4) AS exact, round(CASE WHEN chance = 0 THEN CASE WHEN seen = 0 THEN 1 ELSE 0 END ELSE 1 - seen / chance END, 4) AS kappa FROM g)
SELECT *, CASE WHEN kappa < 0 THEN 'worse than chance' WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM k"""


@query(_kappa_sql("quality", "rule", "(a <> b)::INTEGER"))
def kappa_binary(spark, sf):
    """AGG-19, AGG-21, AGG-23."""
    return S.kappa(raters(spark, sf), "quality", "rule")


@query(_kappa_sql("c3", "d3", "(abs(a - b) / 2.0)"))
def kappa_linear(spark, sf):
    """AGG-20."""
    return S.kappa(raters(spark, sf), "c3", "d3", weighted=True, categories=[0, 1, 2])


@query(f"WITH {_R} SELECT count(*) AS n, round(avg((c3 = d3)::INTEGER), 4) AS exact, round(avg((abs(c3 - d3) <= 1)::INTEGER), 4) AS adjacent, round(avg((quality = rule)::INTEGER), 4) AS violation FROM r")
def calibration_agreement(spark, sf):
    """AGG-22."""
    return raters(spark, sf).agg(F.count("*").alias("n"), S.share(F.col("c3") == F.col("d3")).alias("exact"), S.share(F.abs(F.col("c3") - F.col("d3")) <= 1).alias("adjacent"), S.share(F.col("quality") == F.col("rule")).alias("violation"))


@query(f"WITH {_R} SELECT doc_id, c3, d3, abs(c3 - d3)::INTEGER AS gap FROM r WHERE abs(c3 - d3) >= 2")
def disagreements(spark, sf):
    """JON-11."""
    return S.disagreements(raters(spark, sf), "c3", "d3", 2).select("doc_id", "c3", "d3", "gap")


@query(f"""WITH {_R}, x AS (SELECT (doc_id % 5)::VARCHAR AS term, CASE WHEN c3 = 2 THEN true WHEN c3 = 0 THEN false END AS rule, toxic = 1 AS judge FROM r)
SELECT term, count(*) AS pairs, count(rule) AS decided, count(*) FILTER (rule IS NULL) AS abstained, round(avg((rule = judge)::INTEGER), 4) AS agreement, count(*) FILTER (judge AND NOT rule) AS missed, count(*) FILTER (NOT judge AND rule) AS overfired FROM x GROUP BY 1""")
def rule_vs_judge(spark, sf):
    """AGG-24."""
    r = raters(spark, sf).select((F.col("doc_id") % 5).cast("string").alias("term"), F.when(F.col("c3") == 2, True).when(F.col("c3") == 0, False).alias("rule"), (F.col("toxic") == 1).alias("judge"))
    return S.rule_vs_judge(r, "term", "rule", "judge")


_W = "CASE WHEN tasks > 0 THEN round({0}(({1} + 1.9208 / tasks {2} 1.96 * sqrt({1} * (1 - {1}) / tasks + 3.8416 / (4 * tasks * tasks))) / (1 + 3.8416 / tasks), {3}), 4) END"


@query(f"""WITH t AS (SELECT o_orderpriority AS kind, o_orderstatus AS variant, o_totalprice > 150000 AS passed, o_custkey % 12 AS steps FROM orders),
g AS (SELECT kind, variant, count(*) AS tasks, sum(passed::INTEGER)::BIGINT AS passes, round(avg(steps), 4) AS mean_steps FROM t GROUP BY GROUPING SETS ((), (kind), (variant)))
SELECT coalesce(kind, '*') AS kind, coalesce(variant, '*') AS variant, tasks, passes, round(passes / tasks, 4) AS rate, {_W.format('greatest', '(passes / tasks)', '-', '0.0')} AS low, {_W.format('least', '(passes / tasks)', '+', '1.0')} AS high, mean_steps FROM g""")
def wilson_summary(spark, sf):
    """AGG-11, AGG-12."""
    o = table(spark, sf, "orders")
    return S.task_summary(o.select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("variant"), (F.col("o_totalprice") > 150000).alias("passed"), (F.col("o_custkey") % 12).alias("steps")))


_AZ = lambda e: f"regexp_replace({e}, '[^a-z]', '', 'g')"
_BG = lambda e: f"list_distinct(list_transform(range(1, length({e})), lambda i: substr({e}, i, 2)))"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, {_AZ('a.text')} AS answer, {_AZ('u.text')} AS question, {_AZ('d.text')} AS source FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 JOIN documents d ON d.doc_id = a.conv_id * 7 + a.turn WHERE a.role = 'assistant' AND u.role = 'user'),
g AS (SELECT conv_id, turn, {_BG('answer')} AS a, {_BG('question')} AS q, {_BG("source")} AS src FROM p),
b AS (SELECT conv_id, turn, src, list_distinct(list_filter(a, lambda x: NOT list_contains(q, x))) AS own FROM g)
SELECT conv_id, turn, CASE WHEN len(own) >= 8 THEN round(len(list_intersect(own, src)) / len(own), 4) END AS support FROM b""")
def answer_support(spark, sf):
    """AGG-30: answers against whole texts."""
    c = table(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("d"), F.col("text").alias("source"))
    j = c.where("role = 'assistant'").join(u, ["conv_id", "turn"]).join(d, F.col("d") == F.col("conv_id") * 7 + F.col("turn"))
    return j.select("conv_id", "turn", S.answer_support("text", "source", "question", "[^a-z]").alias("support"))


@query("""WITH e AS (SELECT user_id, event_id, ts, round(value / 100, 6) AS cost FROM events), s AS (SELECT user_id, event_id, round(sum(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS spent FROM e) SELECT user_id, event_id, spent, spent <= 2.0 AS within FROM s""")
def budget_cutoff(spark, sf):
    """MTH-03."""
    e = table(spark, sf, "events").withColumn("cost", F.round(F.col("value") / 100, 6))
    return S.budget_cut(e, ["ts", "event_id"], "cost", 2.0, "user_id").select("user_id", "event_id", "spent", "within")


@query("SELECT doc_id, trunc(450 + length(text) / 1.4::DOUBLE + 20 / 1.4::DOUBLE)::BIGINT AS tokens, round((trunc(450 + length(text) / 1.4::DOUBLE + 20 / 1.4::DOUBLE) * 0.8 + 60 * 2.0) / 1e6, 8) AS cost FROM documents")
def judge_costs(spark, sf):
    """MTH-01, MTH-02."""
    t = S.prompt_tokens("text", F.lit("x" * 20))
    return table(spark, sf, "documents").select("doc_id", t.alias("tokens"), F.round(S.cost(t, F.lit(60), 0.8, 2.0), 8).alias("cost"))


@query(f"""WITH t AS (SELECT p_partkey AS novel_id, p_name AS title, p_partkey AS ordinal FROM part), a AS (SELECT DISTINCT p_name[1:6] AS anchor FROM part) SELECT anchor, arg_min(novel_id, ordinal) AS novel_id FROM a JOIN t ON starts_with({_N('title')}, {_N('anchor')}) GROUP BY 1""")
def first_anchor(spark, sf):
    """JON-03."""
    p = table(spark, sf, "part")
    a = p.select(F.substring("p_name", 1, 6).alias("anchor")).distinct().withColumn("query_id", F.lit(0))
    t = p.select(F.col("p_partkey").alias("novel_id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ordinal"))
    return S.first_anchor(a, t).select("anchor", "novel_id")


@query(f"""WITH t AS (SELECT min(p_partkey) AS novel_id, {_K('p_name')} AS key FROM part GROUP BY 2), q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand || ' ' || p_name || ' ' || p_type END AS query FROM part),
x AS (SELECT query_id, novel_id, key, 0 AS tier FROM q JOIN t ON {_K('query')} = key), h AS (SELECT query_id, novel_id, key, 1 AS tier FROM q JOIN t ON contains({_K('query')}, key) AND length(key) >= 3 WHERE query_id NOT IN (SELECT query_id FROM x)),
u AS (FROM x UNION ALL FROM h) SELECT query_id, novel_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, length(key) DESC, novel_id DESC)::INTEGER AS place FROM u) WHERE place <= 3""")
def title_promotion(spark, sf):
    """FLT-25, TOOL-01."""
    from ..functions import text as X

    p = table(spark, sf, "part")
    t = p.groupBy(X.title_key("p_name").alias("key")).agg(F.min("p_partkey").alias("novel_id"))
    q = p.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_brand", "p_name", "p_type")).alias("query"))
    return S.find_titles(q, t)


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT l_orderkey, l_partkey FROM r EXCEPT SELECT l_orderkey, l_partkey FROM s""")
def unseen_pairs(spark, sf):
    """JON-10: recommended pairs that were not seen."""
    li = table(spark, sf, "lineitem")
    side = lambda f: li.where(F.col("l_returnflag") == f).select("l_orderkey", "l_partkey").distinct()
    return side("R").join(side("A"), ["l_orderkey", "l_partkey"], "left_anti")
