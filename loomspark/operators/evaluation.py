"""One scorer for the sessions of all kinds of tasks: facts of a run, what its task expects, labels, and the task's verdict.

A run is a row with its steps nested. What it searched, checked and cited is read off the row by expressions, so runs are not
taken apart and put together again; they meet their tasks, memories, verdicts and digests in joins on small keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from .trajectories import ROWS, labelled, qa_labels, session_labels

RUNS = (
    "task_id string, session int, termination string, steps array<struct<prompt_tokens:int,completion_tokens:int,observations:array<struct<tool:string,arguments:map<string,string>,result:string,error:string>>>>,"
    " recommendations array<struct<novel_id:string,title:string>>, citations array<struct<novel_id:string,chapter:string>>, asks_user boolean, final_answer string"
)
EXPECT = (
    "struct<min_recommendations:int,max_recommendations:int,persist:array<string>,must_pass:array<string>,must_not_persist:array<string>,"
    "disjoint_from:int,refers_to:int,exclude_index:int,novel_id:string,answerable:boolean,gold_chapters:array<string>>"
)
TASKS = f"task_id string, kind string, variant string, split string, negatives_in_text array<string>, negatives_meta array<string>, sessions array<struct<user_message:string,expect:{EXPECT}>>"
MEMORY = "task_id string, session int, negative array<struct<value:string,persistent:boolean>>, positive array<struct<value:string,persistent:boolean>>"
VERDICTS = "novel_id string, term string, violation boolean"
DIGESTS = "novel_id string, chapters array<struct<kind:string,heading:string,text:string>>"

#: Tools whose rows a run may recommend from, and tools that look at one book.
SEARCHES = ("search_books", "similar_books")
LOOKS = ("get_profile", "ask_book", "check_term", "check_trope", "similar_books")

_STRINGS = "array<string>"


def _none(kind: str = _STRINGS) -> Column:
    return F.array().cast(kind)


def _or_none(c: str | Column, kind: str = _STRINGS) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, _none(kind))


def _of(tools: tuple[str, ...]) -> Column:
    return F.filter("__obs", lambda o: o["tool"].isin(*tools))


def _book(o: Column) -> Column:
    return F.coalesce(o["arguments"]["novel_id"], F.lit(""))


def _list(c: Column) -> Column:
    """A list argument, which maps hold as JSON; anything else is no list."""
    return F.coalesce(F.from_json(c, _STRINGS), _none())


def _checks(tool: str, values) -> Column:
    """What was checked of each book, as a map from the book."""
    calls = _of((tool,))
    books = F.array_distinct(F.transform(calls, _book))
    return F.map_from_arrays(books, F.transform(books, lambda b: F.array_distinct(F.flatten(F.transform(F.filter(calls, lambda o: _book(o) == b), values)))))


def run_facts(runs: DataFrame) -> DataFrame:
    """SET-05 to SET-10, EVL-07 to EVL-10: each run with ``recommended, searched, terms, tropes, checked, referenced, asked_ids,
    profiled_ids, passages_of`` and its counts. Calls count whether or not they failed; failed searches show nothing."""
    obs = F.flatten(F.transform(_or_none("steps", dict(runs.dtypes)["steps"]), lambda s: F.coalesce(s["observations"], _none("array<struct<tool:string,arguments:map<string,string>,result:string,error:string>>"))))
    rows = lambda o: F.coalesce(F.when(F.ltrim(o["result"]).startswith("["), F.from_json(o["result"], ROWS)).otherwise(F.from_json(F.get_json_object(o["result"], "$.results"), ROWS)), _none(ROWS))
    terms = lambda o: _list(o["arguments"]["terms"])
    trope = lambda o: F.array(F.coalesce(o["arguments"]["trope"], F.lit("")))
    passage = "array<struct<chapter:string,text:string>>"
    passages = lambda o: F.coalesce(F.from_json(F.get_json_object(o["result"], "$.passages"), passage), _none(passage))
    total = lambda c: F.aggregate(_or_none("steps", dict(runs.dtypes)["steps"]), F.lit(0).cast("long"), lambda n, s: n + F.coalesce(s[c], F.lit(0)))
    ids = lambda *tools: F.array_distinct(F.transform(_of(tools), _book))
    return runs.withColumn("__obs", obs).withColumns({
        "recommended": F.filter(F.transform(_or_none("recommendations", dict(runs.dtypes)["recommendations"]), lambda r: r["novel_id"]), lambda i: i.isNotNull() & (i != "")),
        "searched": F.array_distinct(F.flatten(F.transform(F.filter(_of(SEARCHES), lambda o: o["error"].isNull()), lambda o: F.transform(rows(o), lambda r: F.coalesce(r["novel_id"], F.lit("")))))),
        "terms": _checks("check_term", terms), "tropes": _checks("check_trope", trope),
        "checked": F.concat(F.flatten(F.transform(_of(("check_term",)), terms)), F.flatten(F.transform(_of(("check_trope",)), trope))),
        "referenced": ids(*LOOKS), "asked_ids": ids("ask_book"), "profiled_ids": ids("get_profile"),
        "passages_of": F.flatten(F.transform(_of(("ask_book",)), lambda o: F.transform(passages(o), lambda p: F.struct(_book(o).alias("novel_id"), p["chapter"].alias("chapter"), p["text"].alias("text"))))),
        "n_steps": F.size(_or_none("steps", dict(runs.dtypes)["steps"])).cast("long"), "prompt_tokens": total("prompt_tokens"), "completion_tokens": total("completion_tokens"),
    }).drop("__obs")


def unrequested(checked: str | Column, requested: str | Column, lex: Lexicon = Lexicon()) -> Column:
    """EVL-05, EVL-06: ``struct<expansion, off_topic, total>`` of the terms and tropes that a run checked unasked.

    A term is asked for if it is, holds, or is held by a requested term or one of its forms. Of the others those that are,
    hold, or are held by a term related to a requested one are expansions; the rest is off the topic. Both columns are
    arrays; repeats count each, and null arrays are empty.
    """
    known = lambda words, r: F.coalesce(F.element_at(F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), r), _none()) if words else _none()
    wanted = F.filter(F.transform(_or_none(requested), lambda r: F.trim(r)), lambda r: r != "")
    forms = F.flatten(F.transform(wanted, lambda r: F.concat(F.array(r), known(lex.term_forms, r))))
    related = F.flatten(F.transform(wanted, lambda r: known(lex.related_terms, r)))
    touches = lambda t, words: F.exists(words, lambda w: F.contains(t, w) | F.contains(w, t))
    unasked = F.filter(F.transform(_or_none(checked), lambda t: F.trim(t)), lambda t: ~((t != "") & touches(t, forms)))
    near = F.size(F.filter(unasked, lambda t: touches(t, related)))
    return F.struct(near.alias("expansion"), (F.size(unasked) - near).alias("off_topic"), F.size(unasked).alias("total"))


def memory_labels(persist: Column, must_not: Column, values: Column) -> Column:
    """EVL-04: what should have been remembered and was not, and what should not have been and was."""
    held = lambda t: F.exists(values, lambda v: F.contains(v, t))
    return labelled((F.exists(persist, lambda t: ~held(t)), "memory_missed"), (F.exists(must_not, held), "memory_overpersisted"))


def state_labels(expect: Column, recommended: Column, referenced: Column, earlier: Column) -> Column:
    """WIN-10: a follow-up against what earlier sessions of its task recommended (a map from the session): books that were to
    be others and are not, a book that was meant by its place and not looked at, a book that was ruled out and came again."""
    of = lambda n: F.coalesce(F.element_at(earlier, n), _none())
    at = lambda n: F.get(of(F.lit(0)), n - 1)
    return labelled(
        (F.arrays_overlap(recommended, of(expect["disjoint_from"])), "repeat_recommended"),
        (at(expect["refers_to"]).isNotNull() & ~F.array_contains(referenced, at(expect["refers_to"])), "reference_missed"),
        (F.array_contains(recommended, at(expect["exclude_index"])), "excluded_recommended"),
    )


def rule_verdicts(sessions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``verdicts`` for :func:`session_labels`: of each recommended book, whether it breaks one of its session's terms; null
    where the rule is silent on one and none is broken. Books and terms meet the table of verdicts in a join."""
    each = sessions.select("task_id", "session", F.explode(F.array_distinct("recommended")).alias("novel_id"), "in_text").select("task_id", "session", "novel_id", F.explode("in_text").alias("term"))
    found = each.join(verdicts, ["novel_id", "term"], "left").groupBy("task_id", "session", "novel_id").agg(F.bool_or(F.coalesce("violation", F.lit(False))).alias("broken"), F.bool_or(F.col("violation").isNull()).alias("silent"))
    one = F.when(F.col("broken"), True).when(~F.col("silent"), False)
    return found.groupBy("task_id", "session").agg(F.map_from_entries(F.collect_list(F.struct("novel_id", one.alias("v")))).alias("verdicts"))


def score_sessions(tasks: DataFrame, runs: DataFrame, verdicts: DataFrame, memory: DataFrame | None = None, digests: DataFrame | None = None, lex: Lexicon = Lexicon()) -> DataFrame:
    """EVL-01 to EVL-06, WIN-10: ``(task_id, session, labels, n_steps, prompt_tokens, completion_tokens, unrequested, ...)`` of
    every session that has a run, by its task's kind.

    ``clarify`` must ask and must not recommend; ``session_state`` is held against earlier sessions; ``book_qa`` against its
    book's digest, and a book without one fails the job; ``memory`` is bound by what its own session expects; every other
    kind by its task's negatives. Runs of unknown tasks, and sessions that a task does not have, are left out.
    """
    spark = tasks.sparkSession
    memory = spark.createDataFrame([], MEMORY) if memory is None else memory
    rest = ["task_id", "kind", "negatives_in_text", "negatives_meta"]
    lasting = F.flatten(F.transform("sessions", lambda s: F.concat(_or_none(s["expect"]["persist"]), _or_none(s["expect"]["must_pass"]))))
    asked = tasks.select(*rest, lasting.alias("lasting"), F.posexplode("sessions").alias("session", "s")).select(*rest, "lasting", "session", "s.*")
    s = asked.join(run_facts(runs), ["task_id", "session"]).join(memory, ["task_id", "session"], "left")
    e, kind = F.col("expect"), F.col("kind")
    least = F.coalesce(e["min_recommendations"], F.lit(0))
    free = kind.isin("clarify", "session_state")
    values = lambda c: F.transform(_or_none(c, dict(memory.dtypes)[c]), lambda m: F.coalesce(m["value"], F.lit("")))
    held = F.transform(F.filter(_or_none("negative", dict(memory.dtypes)["negative"]), lambda m: F.coalesce(m["persistent"], F.lit(True))), lambda m: F.coalesce(m["value"], F.lit("")))
    s = s.withColumns({
        "in_text": F.when(free, _none()).when(kind == "memory", F.coalesce(e["must_pass"], e["persist"], _none())).otherwise(_or_none("negatives_in_text")),
        "meta": F.when(kind == "constrained_rec", _or_none("negatives_meta")).otherwise(_none()),
        "remembered": F.when(free, _none()).otherwise(F.concat(values("negative"), values("positive"), "lasting")),
        "earlier": F.map_from_entries(F.collect_list(F.struct("session", "recommended")).over(Window.partitionBy("task_id"))),  # a task has few sessions
    })
    talk = s.where(kind != "book_qa")
    judged = talk.join(rule_verdicts(talk.select("task_id", "session", "recommended", "in_text"), verdicts), ["task_id", "session"], "left")
    scored = session_labels(judged, least=F.greatest(least, F.lit(1)), required=(least > 0) & (kind != "clarify"))
    clarify = labelled((~F.coalesce("asks_user", F.lit(False)), "no_clarification"), (F.size("recommended") > F.coalesce(e["max_recommendations"], F.lit(0)), "recommended_without_asking"))
    more = (
        F.when(kind == "clarify", clarify)
        .when(kind == "session_state", state_labels(e, F.col("recommended"), F.col("referenced"), F.col("earlier")))
        .otherwise(memory_labels(_or_none(e["persist"]), _or_none(e["must_not_persist"]), held))
    )
    extra = unrequested("checked", F.concat("in_text", "meta", "remembered"), lex)
    columns = ["task_id", "session", "labels", "n_steps", "prompt_tokens", "completion_tokens", "unrequested"]
    rates = ["term_coverage", "trope_coverage", "violation_rate", "undecided_rate"]
    rows = scored.withColumn("labels", F.concat("labels", more)).withColumn("unrequested", extra).select(*columns, *rates)
    if digests is None:
        books = s.where(kind == "book_qa").withColumn("chapters", F.lit(None).cast(dict(spark.createDataFrame([], DIGESTS).dtypes)["chapters"]))
    else:
        books = s.where(kind == "book_qa").withColumn("novel_id", e["novel_id"]).join(digests, "novel_id", "left")
    there = F.when(F.col("chapters").isNotNull(), F.col("chapters")).otherwise(F.raise_error(F.concat(F.lit("no digest for "), F.coalesce(e["novel_id"], F.lit("a null book")))))
    own = F.filter("passages_of", lambda p: p["novel_id"] == e["novel_id"])
    qa = books.withColumns({
        "chapters": there, "novel_id": e["novel_id"], "answerable": e["answerable"], "gold": e["gold_chapters"], "question": F.col("user_message"),
        "asked": F.array_contains("asked_ids", e["novel_id"]), "profiled": F.array_contains("profiled_ids", e["novel_id"]),
        "returned": F.filter(F.transform(own, lambda p: p["chapter"]), lambda c: c.isNotNull() & (c != "")), "passages": F.filter(F.transform(own, lambda p: p["text"]), lambda t: t.isNotNull()),
    })
    nothing = F.struct(F.lit(0).alias("expansion"), F.lit(0).alias("off_topic"), F.lit(0).alias("total"))
    answered = qa_labels(qa).withColumn("unrequested", nothing).select(*columns, *[F.lit(None).cast("double").alias(c) for c in rates])
    return rows.unionByName(answered)


def score_tasks(tasks: DataFrame, runs: DataFrame, verdicts: DataFrame, memory: DataFrame | None = None, digests: DataFrame | None = None, supply: DataFrame | None = None, lex: Lexicon = Lexicon()) -> DataFrame:
    """EVL-03: one row for each task: it passes if none of its sessions has a label and none lacks its run.

    ``supply`` is a table ``(task_id, supply_feasible)``; tasks that it lacks have null there.
    """
    rows = score_sessions(tasks, runs, verdicts, memory, digests, lex)
    per = rows.groupBy("task_id").agg(
        F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_list("labels"))).alias("found"), F.sum("n_steps").alias("steps"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("unrequested.total").alias("unrequested_checks"),
    )
    j = tasks.select("task_id", "kind", "variant", "split", F.size("sessions").alias("wanted")).join(per, "task_id", "left")
    missing = F.when(F.coalesce("n", F.lit(0)) < F.col("wanted"), F.array(F.lit("model_error"))).otherwise(_none())
    out = j.withColumn("labels", F.array_sort(F.array_distinct(F.concat(_or_none("found"), missing)))).withColumn("passed", F.size("labels") == 0)
    out = out.join(supply.select("task_id", "supply_feasible"), "task_id", "left") if supply is not None else out.withColumn("supply_feasible", F.lit(None).cast("boolean"))
    sums = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("steps", "prompt_tokens", "completion_tokens", "unrequested_checks")]
    return out.select("task_id", "kind", "variant", "split", "passed", "supply_feasible", "labels", *sums)
