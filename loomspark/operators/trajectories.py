"""Agent trajectories: nested steps and observations as tables, and the scores of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import ABSTAINS, Lexicon
from .supply import answer_support

SCHEMA = (
    "task_id string, session int, steps array<struct<observations:array<struct<tool:string,arguments:map<string,string>,result:string,error:string>>>>,"
    " recommendations array<struct<novel_id:string,title:string>>, final_answer string"
)
ROWS = "array<struct<novel_id:string,title:string,chapter:string,text:string>>"


def observations(trajectories: DataFrame) -> DataFrame:
    """EVL-10: one row per observation, in order; errors are kept apart by their column."""
    steps = trajectories.select("task_id", "session", F.posexplode("steps").alias("step", "s"))
    return steps.select("task_id", "session", "step", F.posexplode("s.observations").alias("place", "o")).select("task_id", "session", "step", "place", "o.*")


def calls_of(trajectories: DataFrame, tool: str) -> DataFrame:
    """EVL-10: arguments of every call of a tool."""
    return observations(trajectories).where(F.col("tool") == tool)


def rows_of(trajectories: DataFrame, tools: list[str]) -> DataFrame:
    """SET-06, SET-09, EVL-07, EVL-08: rows that tools returned, as a list or under ``results``; errors have none."""
    o = observations(trajectories).where(F.col("tool").isin(*tools) & F.col("error").isNull())
    rows = F.coalesce(F.from_json("result", ROWS), F.from_json("result", f"results {ROWS}")["results"])
    whole = F.from_json(F.get_json_object("result", "$.results"), ROWS)
    parsed = F.when(F.col("result").startswith("["), rows).otherwise(whole)
    return o.select("task_id", "session", "step", "place", "tool", "arguments", F.posexplode(parsed).alias("rank", "r")).select("task_id", "session", "step", "place", "tool", "arguments", (F.col("rank") + 1).alias("rank"), "r.*")


def recommended(trajectories: DataFrame) -> DataFrame:
    """SET-05, JON-06: recommended books in order."""
    return trajectories.select("task_id", "session", F.posexplode("recommendations").alias("p", "r")).where("r.novel_id is not null").select("task_id", "session", (F.col("p") + 1).alias("rank"), "r.novel_id", "r.title")


def checked(trajectories: DataFrame, tool: str, argument: str) -> DataFrame:
    """SET-07, SET-08: what was checked of which book."""
    return calls_of(trajectories, tool).groupBy("task_id", "session", F.col("arguments")["novel_id"].alias("novel_id")).agg(F.array_sort(F.collect_set(F.col("arguments")[argument])).alias("checked"))


def asked(trajectories: DataFrame, tool: str = "ask_book") -> DataFrame:
    """SET-10."""
    return calls_of(trajectories, tool).select("task_id", "session", F.col("arguments")["novel_id"].alias("novel_id")).distinct()


def cited(trajectories: DataFrame) -> DataFrame:
    """EVL-09: chapters that an answer names in brackets."""
    found = F.regexp_extract_all("final_answer", F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    return trajectories.select("task_id", "session", F.explode(found).alias("chapter"))


def trajectory_queries(trajectories: DataFrame, tasks: DataFrame, tool: str = "search_books") -> DataFrame:
    """JON-05: the distinct search queries of each known task, numbered in the order they were first asked."""
    first = calls_of(trajectories, tool).groupBy("task_id", F.trim(F.col("arguments")["query"]).alias("query")).agg(F.min(F.struct("session", "step", "place")).alias("at")).where("query <> ''")
    w = Window.partitionBy("task_id").orderBy("at")
    return first.join(tasks, "task_id").withColumn("number", F.row_number().over(w)).drop("at").withColumn("query_id", F.concat_ws("#", "task_id", "number"))


def observed_supply(trajectories: DataFrame, tasks: DataFrame, tool: str = "search_books") -> DataFrame:
    """JON-06: seen and recommended rows of known tasks in one pool; failed and empty searches give none."""
    seen = rows_of(trajectories, [tool]).groupBy("task_id", "session", "novel_id").agg(F.min(F.struct("step", "place", "rank")).alias("at"), F.min_by("title", F.struct("step", "place", "rank")).alias("title"))
    w = Window.partitionBy("task_id", "session").orderBy("at")
    pool = seen.select("task_id", "session", F.lit("seen").alias("config"), F.row_number().over(w).alias("rank"), "novel_id", "title")
    return pool.unionByName(recommended(trajectories).select("task_id", "session", F.lit("recommended").alias("config"), "rank", "novel_id", "title")).join(tasks, "task_id")


def session_positives(tasks: DataFrame) -> DataFrame:
    """JON-07: the n-th request session of a task goes with its n-th positive."""
    s = tasks.select("task_id", F.posexplode("sessions").alias("session", "kind")).where("kind = 'request'")
    n = s.withColumn("n", F.row_number().over(Window.partitionBy("task_id").orderBy("session")) - 1)
    return n.join(tasks.select("task_id", F.posexplode("positives").alias("n", "positive")), ["task_id", "n"]).select("task_id", "session", "positive")


def score_sessions(trajectories: DataFrame, violations: DataFrame, tool: str = "search_books", check_tool: str = "check_term", least: int = 1) -> DataFrame:
    """EVL-01: labels and rates of each session: too few books, books that no search returned, books that break a rule,
    books left unchecked; ``undecided`` is the share of books on which the rule is silent, which no label counts."""
    r = recommended(trajectories)
    found = rows_of(trajectories, [tool]).select("task_id", "session", "novel_id", F.lit(True).alias("found")).distinct()
    seen = checked(trajectories, check_tool, "term").select("task_id", "session", "novel_id", F.lit(True).alias("seen"))
    on = ["task_id", "session", "novel_id"]
    j = r.join(found, on, "left").join(seen, on, "left").join(violations, ["novel_id"], "left")
    per = j.groupBy("task_id", "session").agg(
        F.count("*").alias("n"), F.count_if(F.col("found").isNull()).alias("ungrounded"), F.count_if(F.coalesce("violation", F.lit(False))).alias("violating"),
        F.count_if(F.col("seen").isNull()).alias("unchecked"), F.round(F.avg(F.col("violation").isNull().cast("int")), 4).alias("undecided"),
    )
    full = trajectories.select("task_id", "session").join(per, ["task_id", "session"], "left").fillna(0, ["n", "ungrounded", "violating", "unchecked"])
    label = lambda c, name: F.when(c, F.lit(name))
    labels = F.array_compact(F.array(label(F.col("n") < least, "too_few"), label(F.col("ungrounded") > 0, "ungrounded"), label(F.col("violating") > 0, "violation"), label(F.col("unchecked") > 0, "unchecked")))
    return full.withColumn("labels", labels)


def ending_labels(termination: str | Column) -> list[tuple[Column, str | Column]]:
    """What the way in which a session ended says about it, as conditions and labels; a null end is no proper one."""
    end = F.coalesce(termination, F.lit(""))
    return [(end != "finish", "format"), (end == "max_steps", "budget_exhausted"), (end.isin("loop", "model_error"), end)]


def labelled(*pairs: tuple[Column, str | Column]) -> Column:
    """The labels whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(when, name if isinstance(name, Column) else F.lit(name)) for when, name in pairs]))


def session_labels(sessions: DataFrame, least: int = 1, required: bool = True) -> DataFrame:
    """EVL-01: ``labels`` and rates of recommending sessions, row by row.

    Columns read: ``termination, recommended array<string>, searched array<string>, in_text array<string>, meta
    array<string>, terms map<string, array<string>>`` and ``tropes`` alike (what was checked of which book), ``verdicts
    map<string, boolean>`` (does a book break the rule; null or missing: the rule is silent). Null arrays and maps count as
    empty. Rates are null where no book or no constraint is there.
    """
    strings, checks = "array<string>", "map<string,array<string>>"
    kinds = {"recommended": strings, "searched": strings, "in_text": strings, "meta": strings, "terms": checks, "tropes": checks, "verdicts": "map<string,boolean>"}
    nothing = lambda t: (F.array() if t == strings else F.create_map()).cast(t)
    s = sessions.withColumns({f"__{c}": F.coalesce(F.col(c), nothing(t)) for c, t in kinds.items()})
    recs, n = F.col("__recommended"), F.size("__recommended")

    def coverage(wanted: str, done: str) -> Column:
        whole = lambda r: F.forall(wanted, lambda t: F.coalesce(F.array_contains(F.try_element_at(F.col(done), r), t), F.lit(False)))
        return F.when((n > 0) & (F.size(wanted) > 0), F.size(F.filter(recs, whole)) / n)

    verdict = lambda r: F.try_element_at(F.col("__verdicts"), r)
    bound = (n > 0) & (F.size("__in_text") > 0)
    decided, broken = F.size(F.filter(recs, lambda r: verdict(r).isNotNull())), F.size(F.filter(recs, verdict))
    s = s.withColumns({
        "n": n, "grounded": F.forall(recs, lambda r: F.array_contains("__searched", r)), "term_coverage": coverage("__in_text", "__terms"),
        "trope_coverage": coverage("__meta", "__tropes"), "violation_rate": F.when(bound & (decided > 0), broken / decided), "undecided_rate": F.when(bound, 1 - decided / n),
    })
    skipped = F.coalesce(F.col("term_coverage") < 1, F.lit(False)) | F.coalesce(F.col("trope_coverage") < 1, F.lit(False))
    labels = labelled(*ending_labels("termination"), (~F.col("grounded"), "ungrounded_id"), (F.lit(required) & (F.col("n") < least), "no_recommendation"), (F.col("violation_rate") > 0, "constraint_violated"), (skipped, "tool_skipped"))
    return s.withColumn("labels", labels).drop(*[f"__{c}" for c in kinds])


def score_tasks(sessions: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """EVL-03: a task passes if none of its sessions, nor its memory, has a label."""
    rows = sessions.select("task_id", "labels")
    if memory is not None:
        rows = rows.unionByName(memory.select("task_id", F.array("label").alias("labels")))
    return rows.groupBy("task_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels")).withColumn("passed", F.size("labels") == 0)


#: The least share of an answer that its sources must have.
SUPPORT = 0.25


def qa_labels(sessions: DataFrame, least: float = SUPPORT) -> DataFrame:
    """EVL-02: ``labels`` of sessions that ask about one book.

    Columns read: ``termination, novel_id, answerable`` (null: true), ``gold array<string>, question, final_answer, asked
    boolean, profiled boolean, returned array<string>, passages array<string>, citations array<struct<novel_id, chapter>>,
    chapters array<struct<kind, heading, text>>``. Null arrays count as empty. What the tool never returned is the tool's
    fault, and then the labels for citations and support are not given; inventing a chapter counts either way.
    """
    strings, flag = "array<string>", lambda c: F.coalesce(F.col(c), F.lit(False))
    empty = {"gold": strings, "returned": strings, "passages": strings, "citations": "array<struct<novel_id:string,chapter:string>>", "chapters": "array<struct<kind:string,heading:string,text:string>>"}
    s = sessions.withColumns({f"__{c}": F.coalesce(F.col(c), F.array().cast(t)) for c, t in empty.items()})
    gold, returned, cites, chapters = F.col("__gold"), F.col("__returned"), F.col("__citations"), F.col("__chapters")
    is_gold = lambda c: F.exists(gold, lambda g: X.match_chapter(c, g))
    headings = F.transform(chapters, lambda c: c["heading"])
    opening = F.transform(F.filter(chapters, lambda c: c["kind"] == "opening"), lambda c: c["heading"])
    chapter_hit = lambda c: F.get(F.filter(headings, lambda h: X.match_chapter(c, h)), F.lit(0))
    section = lambda c: F.when(F.exists(returned, lambda r: X.squash(r) == X.squash(c)), F.lit(""))
    hits = F.transform(cites, lambda c: F.when(c["novel_id"] == F.col("novel_id"), F.coalesce(chapter_hit(c["chapter"]), section(c["chapter"]))))
    quote = X.quoted_line("question")
    s = s.withColumns({
        "__answerable": F.coalesce("answerable", F.lit(True)), "__hits": hits, "__quote": F.when(~F.coalesce(is_gold(quote), F.lit(False)), quote),
        "__found": F.coalesce(F.exists(returned, is_gold) | (flag("profiled") & F.exists(opening, is_gold)), F.lit(False)),
        "__cited": F.coalesce(F.exists(cites, lambda c: is_gold(c["chapter"])), F.lit(False)),
    })
    grounded = F.filter("__hits", lambda h: h.isNotNull() & (h != ""))
    text_of = lambda h: F.try_element_at(F.filter(chapters, lambda c: c["heading"] == h), F.lit(-1))["text"]
    sources = F.transform(F.when(F.size(grounded) > 0, grounded).otherwise(F.filter(headings, is_gold)), text_of)
    shown = F.when((F.size("__passages") > 0) & F.col("__quote").isNotNull(), F.exists("__passages", lambda p: F.contains(X.squash(p), F.substring(X.squash("__quote"), 1, 12))))
    s = s.withColumns({"__support": answer_support("final_answer", F.array_join(sources, "\n"), F.coalesce("question", F.lit(""))), "__shown": shown, "__n": F.size("__citations")})
    model = labelled((F.col("__n") == 0, "no_citation"), ((F.col("__n") > 0) & ~F.col("__cited"), "gold_not_cited"), (F.col("__support") < least, "answer_unsupported"))
    s = s.withColumn("__model", model)
    always = labelled(*ending_labels("termination"), (~(flag("asked") | flag("profiled")), "book_unresolved"), (F.exists("__hits", lambda h: h.isNull()), "ungrounded_citation"))
    own = (
        F.when(F.col("__answerable") & ~F.col("__found"), F.array(F.lit("chapter_not_retrieved")))
        .when(F.col("__answerable") & (F.size("__model") > 0) & ~F.coalesce("__shown", F.lit(True)), F.array(F.lit("quote_not_retrieved")))
        .when(F.col("__answerable"), F.col("__model"))
        .otherwise(labelled((F.col("final_answer").isNotNull() & ~F.col("final_answer").rlike(ABSTAINS), "fabricated_answer")))
    )
    return s.withColumn("labels", F.concat(always, own)).select(*[c for c in sessions.columns if c != "labels"], "labels")


def redacted(trajectories: DataFrame) -> DataFrame:
    """STR-22: results and the final answer give way to checksums and lengths."""
    show = lambda c: F.to_json(X.fingerprint_redacted(c))
    obs = lambda o: F.struct(o["tool"].alias("tool"), o["arguments"].alias("arguments"), F.when(o["result"].isNotNull(), show(o["result"])).alias("result"), o["error"].alias("error"))
    steps = F.transform("steps", lambda s: F.struct(F.transform(s["observations"], obs).alias("observations")))
    return trajectories.withColumns({"steps": steps, "final_answer": show(F.col("final_answer"))})


def new_tasks(candidates: DataFrame, existing: DataFrame, prefix: str) -> DataFrame:
    """SET-11: candidates whose messages no existing task has, numbered anew in their order."""
    key = F.to_json("messages")
    fresh = candidates.withColumn("k", key).join(existing.select(key.alias("k")).distinct(), "k", "left_anti").dropDuplicates(["k"]).drop("k")
    return fresh.withColumn("task_id", F.concat(F.lit(prefix + "-"), F.row_number().over(Window.orderBy("ordinal")).cast("string")))


def rewritten_queries(rewrites: DataFrame, tasks: DataFrame) -> DataFrame:
    """JON-04: rephrased queries take over their task's constraints; unknown tasks and blank texts go."""
    w = Window.partitionBy("task_id").orderBy("ordinal")
    ok = rewrites.where(F.trim(F.coalesce("query", F.lit(""))) != "").join(tasks, "task_id")
    suffix = F.coalesce("variant", F.row_number().over(w).cast("string"))
    return ok.withColumn("query_id", F.concat_ws("~", "task_id", suffix)).drop("ordinal")


def precheck(pool: DataFrame, violations: DataFrame, k: int = 20) -> DataFrame:
    """GEN-06: tasks whose first candidates hold both a book that breaks the rule and one that is clean."""
    j = pool.where(F.col("rank") <= k).join(violations, "novel_id", "left")
    return j.groupBy("task_id").agg(F.bool_or(F.col("violation")).alias("bad"), F.bool_or(~F.col("violation")).alias("good")).where("bad and good").select("task_id")


def task_queries(tasks: DataFrame) -> DataFrame:
    """EVL-15: one query per task that has positives."""
    return tasks.where(F.size("positives") > 0).select(F.col("task_id").alias("query_id"), F.array_join("positives", " ").alias("query"))


def legacy_queries(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """EVL-16: where positives are missing they are parsed from the query."""
    p = X.parse_query("query", lex)
    return rows.withColumn("positives", F.when(F.size(F.coalesce("positives", F.array().cast("array<string>"))) > 0, F.col("positives")).otherwise(p["positive"]))


def summary_line(c: str | Column) -> Column:
    """SVC-05: one line of a result."""
    t = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", " ")
    return X.truncate(t, 120, "...")
