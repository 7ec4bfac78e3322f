"""Labels of tasks by kind, in literal cases."""

from __future__ import annotations

import json

import pytest
from loomspark.functions.lexicon import Lexicon
from loomspark.operators import evaluation as E
from pyspark.sql import functions as F


def call(tool, result=None, error=None, **arguments):
    return (tool, {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in arguments.items()}, None if result is None else json.dumps(result, ensure_ascii=False), error)


def run(task, session, *calls, end="finish", recs=(), cites=(), asks=None, answer=None):
    return (task, session, end, [(10, 2, list(calls))], [(r, r) for r in recs], list(cites), asks, answer)


def expect(**given):
    names = ["min_recommendations", "max_recommendations", "persist", "must_pass", "must_not_persist", "disjoint_from", "refers_to", "exclude_index", "novel_id", "answerable", "gold_chapters"]
    return tuple(given.get(n) for n in names)


def task(name, kind, *sessions, in_text=None, meta=None):
    return (name, kind, "v", "dev", in_text, meta, [(m, expect(**e)) for m, e in sessions])


FOUND = call("search_books", [{"novel_id": "a"}, {"novel_id": "b"}, {"novel_id": "c"}], query="q")


def scores(spark, tasks, runs, verdicts=(), memory=(), digests=None):
    made = [spark.createDataFrame(list(x), t) for x, t in ((tasks, E.TASKS), (runs, E.RUNS), (verdicts, E.VERDICTS), (memory, E.MEMORY))]
    d = None if digests is None else spark.createDataFrame(digests, E.DIGESTS)
    return {r.task_id: r for r in E.score_tasks(*made, digests=d).collect()}


def test_constrained(spark):
    want = {"min_recommendations": 2}
    check = lambda book, *terms: call("check_term", {}, novel_id=book, terms=list(terms))
    trope = lambda book, t: call("check_trope", {}, novel_id=book, trope=t)
    names = ["good", "broken", "skipped", "few", "unknown", "loop", "lost"]
    tasks = [task(n, "constrained_rec", ("m", want), in_text=["系统"], meta=["压抑"]) for n in names]
    full = [FOUND, check("a", "系统"), check("b", "系统"), trope("a", "压抑"), trope("b", "压抑")]
    runs = [
        run("good", 0, *full, recs=["a", "b"]), run("broken", 0, *full, check("c", "系统"), trope("c", "压抑"), recs=["a", "c"]), run("skipped", 0, FOUND, check("a", "系统"), recs=["a", "b"]),
        run("few", 0, *full, recs=["a"]), run("unknown", 0, *full, check("z", "系统"), trope("z", "压抑"), recs=["a", "z"]), run("loop", 0, FOUND, end="loop"), run("stray", 0, *full),
    ]
    got = scores(spark, tasks, runs, [("a", "系统", False), ("c", "系统", True)])
    assert {n: got[n].labels for n in names} == {
        "good": [], "broken": ["constraint_violated"], "skipped": ["tool_skipped"], "few": ["no_recommendation"], "unknown": ["ungrounded_id"],
        "loop": ["format", "loop", "no_recommendation"], "lost": ["model_error"],
    }
    assert (got["good"].passed, got["good"].steps, got["good"].prompt_tokens, got["good"].completion_tokens, got["good"].unrequested_checks) == (True, 1, 10, 2, 0)
    assert got["lost"].passed is False and len(got) == 7


def test_clarify(spark):
    ask = {"max_recommendations": 0}
    tasks = [task(n, "clarify", ("m", ask)) for n in ("asks", "guesses", "silent")]
    runs = [run("asks", 0, asks=True), run("guesses", 0, FOUND, recs=["a"], asks=True), run("silent", 0, end="answer_without_finish")]
    got = scores(spark, tasks, runs)
    assert {n: r.labels for n, r in got.items()} == {"asks": [], "guesses": ["recommended_without_asking"], "silent": ["format", "no_clarification"]}


def test_session_state(spark):
    first = ("m", {"min_recommendations": 1})
    follow = {"more": {"min_recommendations": 1, "disjoint_from": 0}, "refer": {"refers_to": 2}, "exclude": {"min_recommendations": 1, "exclude_index": 1}}
    tasks = [task(f"{k}{i}", "session_state", first, ("n", e)) for k, e in follow.items() for i in (0, 1)] + [task("far", "session_state", first, ("n", {"refers_to": 9}))]
    runs = [run(t[0], 0, FOUND, recs=["a", "b"]) for t in tasks]
    runs += [
        run("more0", 1, FOUND, recs=["c"]), run("more1", 1, FOUND, recs=["c", "a"]), run("refer0", 1, call("get_profile", {}, novel_id="b")), run("refer1", 1, call("ask_book", {}, novel_id="a")),
        run("exclude0", 1, FOUND, recs=["b"]), run("exclude1", 1, FOUND, recs=["a"]), run("far", 1),
    ]
    got = scores(spark, tasks, runs)
    assert {n: r.labels for n, r in got.items()} == {"more0": [], "more1": ["repeat_recommended"], "refer0": [], "refer1": ["reference_missed"], "exclude0": [], "exclude1": ["excluded_recommended"], "far": []}


def test_memory(spark):
    tasks = [
        task("kept", "memory", ("m", {"persist": ["系统"]}), ("n", {"must_pass": ["系统"], "min_recommendations": 1})),
        task("missed", "memory", ("m", {"persist": ["系统"]})), task("once", "memory", ("m", {"must_not_persist": ["系统"]})), task("weak", "memory", ("m", {"persist": ["系统"]})),
    ]
    runs = [run("kept", 0), run("kept", 1, FOUND, call("check_term", {}, novel_id="a", terms=["系统"]), recs=["a"]), run("missed", 0), run("once", 0), run("weak", 0)]
    memory = [("kept", 0, [("不要系统", True)], []), ("kept", 1, [("不要系统", None)], []), ("once", 0, [("系统流", True)], []), ("weak", 0, [("系统", False)], [("系统", True)])]
    got = scores(spark, tasks, runs, [("a", "系统", False)], memory)
    assert {n: r.labels for n, r in got.items()} == {"kept": [], "missed": ["memory_missed"], "once": ["memory_overpersisted"], "weak": ["memory_missed"]}


def test_book_qa(spark):
    text = "他走进山门，看见一位老者坐在石阶上，手中握着一卷旧书，目光平静如水。"
    digests = [("b", [("opening", "第1章 山门", text), ("middle", "第5章 旧书", "别的内容")])]
    ask = {"novel_id": "b", "answerable": True, "gold_chapters": ["第1章 山门"]}
    tasks = [task(n, "book_qa", ("第1章讲了什么", ask)) for n in ("good", "unfound", "made_up", "no_book")] + [task("outside", "book_qa", ("第9章讲了什么", ask | {"answerable": False, "gold_chapters": []}))]
    told = call("ask_book", {"passages": [{"chapter": "第1章 山门", "text": text}]}, novel_id="b")
    runs = [
        run("good", 0, told, cites=[("b", "第1章")], answer=text), run("unfound", 0, call("ask_book", {"passages": []}, novel_id="b"), answer=text), run("made_up", 0, told, cites=[("b", "第77章")], answer=text),
        run("no_book", 0, answer="x", end="max_steps"), run("outside", 0, told, answer="摘要里没有收录这一章。"),
    ]
    got = scores(spark, tasks, runs, digests=digests)
    assert {n: r.labels for n, r in got.items()} == {
        "good": [], "unfound": ["chapter_not_retrieved"], "made_up": ["gold_not_cited", "ungrounded_citation"],
        "no_book": ["book_unresolved", "budget_exhausted", "chapter_not_retrieved", "format"], "outside": [],
    }
    with pytest.raises(Exception, match="no digest for b"):
        scores(spark, tasks[:1], runs[:1])


@pytest.mark.parametrize(
    "checked, requested, want",
    [
        (["系统"], ["系统"], (0, 0)), (["系统流"], ["系统"], (0, 0)), (["面板", "外挂"], ["系统"], (2, 0)), (["后宫"], ["系统"], (0, 1)), (["多女主", "多女主"], ["后宫"], (2, 0)),
        (["a"], [], (0, 1)), ([""], ["系统"], (1, 0)), ([""], [], (0, 1)), (None, None, (0, 0)), ([" 金手指 "], [" 系统 "], (1, 0)), (["直播间"], ["直播"], (0, 0)),
    ],
)
def test_unrequested(spark, checked, requested, want):
    lex = Lexicon(term_forms={"修仙": ("筑基",), "系统": ("任务奖励",)})
    row = spark.createDataFrame([(checked, requested)], "c array<string>, r array<string>").select(E.unrequested("c", "r", lex).alias("u")).first().u
    assert (row.expansion, row.off_topic, row.total) == (*want, sum(want))


def test_forms_are_requested(spark):
    lex = Lexicon(term_forms={"修仙": ("筑基",)})
    df = spark.createDataFrame([(["筑基", "筑基丹", "修真"], ["修仙"])], "c array<string>, r array<string>")
    u = df.select(E.unrequested("c", "r", lex).alias("u")).first().u
    assert (u.expansion, u.off_topic) == (1, 0)


def test_no_tasks(spark):
    assert scores(spark, [], [run("x", 0)]) == {}
    assert spark.createDataFrame([], E.RUNS).transform(E.run_facts).where(F.size("searched") > 0).count() == 0
