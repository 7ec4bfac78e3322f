"""Scores of tasks whose runs are made from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from .base import query, table

_KINDS = ("constrained_rec", "clarify", "session_state")


@query("""
WITH u AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn // 4 AS part, row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) - 1 AS session FROM u),
f AS (SELECT conv_id || '-' || part AS task_id, session, conv_id + part AS t, conv_id + part + session AS x, ['constrained_rec', 'clarify', 'session_state'][(conv_id + part) % 3 + 1] AS kind FROM r),
g AS (SELECT *, ['finish', 'finish', 'max_steps', 'loop', 'finish'][x % 5 + 1] AS ending, [x % 7, (x + 3) % 7] AS recs, [x % 7, (2 * x + 1) % 7] AS found,
  CASE WHEN x % 2 = 0 THEN [x % 7, (x + 3) % 7, x % 5] ELSE [x % 7, x % 5] END AS looked, [t % 7, (t + 3) % 7] AS before,
  CASE kind WHEN 'constrained_rec' THEN CASE WHEN x % 4 = 0 THEN 3 ELSE 1 END WHEN 'session_state' THEN CASE WHEN session = 0 THEN 1 WHEN session % 3 = 1 THEN 3 WHEN session % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END AS least FROM f),
l AS (
  SELECT task_id, kind, CASE WHEN x % 2 = 1 THEN 1 WHEN kind = 'constrained_rec' THEN 0 ELSE 2 END AS unrequested, [y FOR y IN [
    CASE WHEN ending <> 'finish' THEN 'format' END, CASE WHEN ending = 'max_steps' THEN 'budget_exhausted' END, CASE WHEN ending = 'loop' THEN 'loop' END,
    CASE WHEN NOT list_has_all(found, recs) THEN 'ungrounded_id' END, CASE WHEN least > 2 THEN 'no_recommendation' END,
    CASE WHEN kind = 'constrained_rec' AND ((recs[1] + t % 3) % 4 = 0 OR (recs[2] + t % 3) % 4 = 0) THEN 'constraint_violated' END,
    CASE WHEN kind = 'constrained_rec' AND x % 2 = 1 THEN 'tool_skipped' END,
    CASE WHEN kind = 'clarify' AND x % 2 = 1 THEN 'no_clarification' END, CASE WHEN kind = 'clarify' THEN 'recommended_without_asking' END,
    CASE WHEN kind = 'session_state' AND session % 3 = 1 AND list_has_any(recs, before) THEN 'repeat_recommended' END,
    CASE WHEN kind = 'session_state' AND session % 3 = 2 AND NOT list_contains(looked, before[2]) THEN 'reference_missed' END,
    CASE WHEN kind = 'session_state' AND session > 0 AND session % 3 = 0 AND list_contains(recs, before[1]) THEN 'excluded_recommended' END] IF y IS NOT NULL] AS labels FROM g)
SELECT task_id, any_value(kind) AS kind, array_to_string(list_sort(list_distinct(flatten(list(labels)))), ',') AS labels, bool_and(len(labels) = 0) AS passed,
  count(*) AS steps, 3 * count(*) AS prompt_tokens, sum(unrequested)::BIGINT AS unrequested_checks FROM l GROUP BY 1
""")
def task_scores(spark, sf):
    """EVL-01, EVL-03, EVL-05, EVL-06, SET-05 to SET-09, WIN-10: four turns of a conversation are a task; what its runs
    searched, checked and recommended follows from their numbers."""
    user = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn").distinct()
    parts = user.groupBy("conv_id", F.floor(F.col("turn") / 4).alias("part")).agg(F.count("*").alias("n"))  # four turns at most
    parts = parts.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("part").cast("string")).alias("task_id"), (F.col("conv_id") + F.col("part")).cast("long").alias("t"), "n")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("t") % 3).cast("int"))
    own = F.array(F.concat(F.lit("k"), (F.col("t") % 3).cast("string")))
    names = dict(x.split(":", 1) for x in E.EXPECT.removeprefix("struct<").removesuffix(">").split(","))

    def expect(i):
        x, place = F.col("t") + i, i % 3
        given = {
            "min_recommendations": F.when(kind == "constrained_rec", F.when(x % 4 == 0, 3).otherwise(1)).when(kind == "session_state", F.when(i == 0, 1).when(place == 1, 3).when(place == 0, 1)),
            "disjoint_from": F.when((kind == "session_state") & (place == 1), 0), "refers_to": F.when((kind == "session_state") & (place == 2), 2), "exclude_index": F.when((kind == "session_state") & (i > 0) & (place == 0), 1),
        }
        return F.struct(F.lit("").alias("user_message"), F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()]).alias("expect"))

    every = F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))
    tasks = parts.select("task_id", kind.alias("kind"), F.lit("").alias("variant"), F.lit("").alias("split"), F.when(kind == "constrained_rec", own).alias("negatives_in_text"), F.lit(None).cast("array<string>").alias("negatives_meta"), F.transform(every, expect).alias("sessions"))
    runs = parts.select("task_id", "t", own.alias("own"), F.explode(every).alias("session")).withColumn("x", F.col("t") + F.col("session"))
    x = F.col("x")
    book = lambda n: F.concat(F.lit("b"), n.cast("string"))
    one, two = book(x % 7), book((x + 3) % 7)
    null = F.lit(None).cast("string")
    hits = F.to_json(F.array(*[F.struct(b.alias("novel_id")) for b in (one, book((2 * x + 1) % 7))]))
    obs = lambda tool, result, **args: F.struct(F.lit(tool).alias("tool"), F.create_map(*[y for k, v in args.items() for y in (F.lit(k), v)]).alias("arguments"), result.alias("result"), null.alias("error"))
    check = lambda b, terms: obs("check_term", null, novel_id=b, terms=F.to_json(terms))
    seen = [obs("search_books", hits, query=F.lit("q")), obs("get_profile", null, novel_id=book(x % 5))]
    calls = F.when(x % 2 == 0, F.array(*seen, check(one, F.col("own")), check(two, F.col("own")))).otherwise(F.array(*seen, check(one, F.array(F.lit("zz")))))
    runs = runs.select(
        "task_id", "session", F.get(F.array(*map(F.lit, ("finish", "finish", "max_steps", "loop", "finish"))), (x % 5).cast("int")).alias("termination"),
        F.array(F.struct(F.lit(3).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"), calls.alias("observations"))).alias("steps"),
        F.array(*[F.struct(b.alias("novel_id"), F.lit("").alias("title")) for b in (one, two)]).alias("recommendations"), F.array().cast("array<struct<novel_id:string,chapter:string>>").alias("citations"), (x % 2 == 0).alias("asks_user"), null.alias("final_answer"),
    )
    rule = spark.range(21).select(book(F.col("id") % 7).alias("novel_id"), F.concat(F.lit("k"), F.floor(F.col("id") / 7).cast("string")).alias("term"), (F.col("id") % 7 + F.floor(F.col("id") / 7)).alias("s"))
    verdicts = rule.where("s % 4 <> 1").select("novel_id", "term", (F.col("s") % 4 == 0).alias("violation"))
    done = E.score_tasks(tasks, runs, verdicts)
    return done.select("task_id", "kind", F.array_join("labels", ",").alias("labels"), "passed", "steps", "prompt_tokens", "unrequested_checks")
