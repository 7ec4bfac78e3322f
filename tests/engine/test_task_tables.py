"""Tasks as tables: variants, expectations and golds."""

from __future__ import annotations

import re

import pytest
from loomspark.functions.lexicon import Lexicon
from loomspark.operators import evaluation as E
from loomspark.operators import task_tables as G

WORDS = G.TaskWords()
LEX = Lexicon()


def tasks(df):
    return [r.asDict(recursive=True) for r in df.orderBy("task_id").collect()]


def given(expect):
    return {k: v for k, v in expect.items() if v is not None}


def test_constrained(spark):
    got = tasks(G.constrained(spark, 60, seed=3))
    assert got == tasks(G.constrained(spark.newSession(), 60, seed=3).repartition(7))  # no order, machine or session matters
    assert got != tasks(G.constrained(spark, 60, seed=4))
    assert got[30:] == tasks(G.constrained(spark, 30, seed=3, start=30))  # later batches go on where earlier ones end
    assert [t["variant"] for t in got] == ["in_text", "meta", "mixed"] * 20
    for t in got:
        genre, *feats = t["positives"]
        text, meta = t["negatives_in_text"], t["negatives_meta"]
        assert set(feats) <= set(WORDS.themes[genre]) and 1 <= len(feats) <= 3 and len(set(feats)) == len(feats)
        assert set(text) <= set(LEX.term_forms) - set(WORDS.own_terms.get(genre, ())) and set(meta) <= set(LEX.meta_labels)
        sizes = {"in_text": (len(text) in (1, 2), len(meta) == 0), "meta": (len(text) == 0, len(meta) in (1, 2)), "mixed": (len(text) == 1, len(meta) == 1)}
        assert all(sizes[t["variant"]])
        (s,) = t["sessions"]
        assert given(s["expect"]) == {"min_recommendations": 3}
        assert all(x in s["user_message"] for x in [genre, *feats, *text, *meta]) and "{" not in s["user_message"]
    assert len({t["positives"][0] for t in got}) == len(WORDS.themes) and len({s for t in got for s in t["negatives_in_text"]}) > 5


def test_memory(spark):
    got = tasks(G.memory(spark, 12, seed=1))
    assert [t["variant"] for t in got] == ["persist", "accumulate", "oneoff"] * 4
    for t in got:
        e, neg = [given(s["expect"]) for s in t["sessions"]], t["negatives_in_text"]
        assert len(set(t["positives"])) == 2 and not set(neg) & {x for g in t["positives"] for x in WORDS.own_terms.get(g, ())}
        if t["variant"] == "persist":
            assert e == [{"persist": neg, "min_recommendations": 1}, {"must_pass": neg, "min_recommendations": 1}]
        elif t["variant"] == "accumulate":
            assert len(set(neg)) == 2 and e == [{"persist": neg[:1]}, {"persist": neg[1:]}, {"must_pass": neg, "min_recommendations": 1}]
        else:
            assert e == [{"must_not_persist": neg, "must_pass": neg, "min_recommendations": 1}, {"must_not_persist": neg, "min_recommendations": 1}]


def test_session_state_and_clarify(spark):
    got = tasks(G.session_state(spark, 6))
    assert [given(t["sessions"][1]["expect"]) for t in got[:3]] == [{"min_recommendations": 3, "disjoint_from": 0}, {"refers_to": 2}, {"min_recommendations": 1, "exclude_index": 1}]
    assert all(given(t["sessions"][0]["expect"]) == {"min_recommendations": 3} for t in got)
    vague = tasks(G.clarify(spark, 5))
    assert sorted(t["sessions"][0]["user_message"] for t in vague) == sorted(WORDS.vague)
    assert given(vague[0]["sessions"][0]["expect"]) == {"max_recommendations": 0}
    with pytest.raises(ValueError, match="6 tasks, and 5 phrases"):
        G.clarify(spark, 6)
    assert tasks(G.constrained(spark, 0)) == []


LINE = "他抬头望着远处的山峰心里想着明年春天第{}次下山的事情"


def chapter(n, kind, *lines):
    heading = f"第{n}章 标题{n}"
    return {"kind": kind, "heading": heading, "text": "\n".join([heading, *lines])}


def books(spark, n=12, quotes=True):
    rows = []
    for b in range(n):
        own = lambda k: (LINE.format(f"甲乙丙丁戊己庚辛壬癸子丑寅卯"[k] + "一二三四五六七八九十百千"[b % 12]), "所有章节里都有的一句话它不能被引用因为到处都有") if quotes else ("短",)
        chapters = [chapter(k + 1, "opening" if k < 2 else "ending" if k > 11 else "middle", *own(k)) for k in range(14)]
        rows.append((f"n{b}", f"《书名之{b}》", chapters, ["第3章 标题3", "第99章 只有标题", "序"]))
    rows += [("x1", "同名的书", rows[0][2], []), ("x2", "《同名的书》", rows[0][2], []), ("x3", "短", rows[0][2], []), ("x4", "章数太少", rows[0][2][:5], []), ("x5", "没有编号", [*rows[0][2][:12], {"kind": "middle", "heading": "序", "text": "序"}], [])]
    return spark.createDataFrame(rows, "novel_id string, title string, chapters array<struct<kind:string,heading:string,text:string>>, sampled_titles array<string>")


def test_book_qa(spark):
    df = books(spark)
    got = tasks(G.book_qa(df, 10, seed=5))
    assert got == tasks(G.book_qa(df.repartition(6), 10, seed=5))
    assert [t["variant"] for t in got] == ["chapter_event", "quote_locate", "opening", "ending", "out_of_coverage"] * 2
    text = {r.novel_id: {c.heading: c.text for c in r.chapters} for r in df.collect()}
    assert len({t["meta_facts"]["novel_id"] for t in got}) == 10 and all(t["meta_facts"]["novel_id"].startswith("n") for t in got)
    for t in got:
        m, (s,) = t["meta_facts"], t["sessions"]
        e = given(s["expect"])
        assert e["novel_id"] == m["novel_id"] and m["title"] in s["user_message"] and "《《" not in s["user_message"] and "{" not in s["user_message"]
        assert e["answerable"] == (t["variant"] != "out_of_coverage")
        if t["variant"] == "chapter_event":
            assert e["gold_chapters"] == [m["chapter"]] and m["chapter"] in text[m["novel_id"]] and m["chapter"] in s["user_message"]
        if t["variant"] == "quote_locate":
            assert [h for h, x in text[m["novel_id"]].items() if m["quote"] in x] == e["gold_chapters"] and m["quote"] in s["user_message"]
        if t["variant"] == "opening":
            assert e["gold_chapters"] == ["第1章 标题1", "第2章 标题2"]
        if t["variant"] == "ending":
            assert e["gold_chapters"] == ["第13章 标题13", "第14章 标题14"]
        if t["variant"] == "out_of_coverage":
            assert e["gold_chapters"] == [] and m["chapter"] == "第99章 只有标题"


def test_what_a_book_cannot_serve_becomes_a_question_on_a_chapter(spark):
    from pyspark.sql import functions as F

    got = tasks(G.book_qa(books(spark, quotes=False).withColumn("sampled_titles", F.lit(None).cast("array<string>")), 10))
    assert [t["variant"] for t in got] == ["chapter_event", "chapter_event", "opening", "ending", "chapter_event"] * 2
    with pytest.raises(ValueError, match="12 eligible books for 13 tasks"):
        G.book_qa(books(spark), 13)


def test_tasks_can_be_scored(spark):
    made = G.session_state(spark, 3).drop("positives")
    runs = spark.createDataFrame([(f"ses-{i:03d}", s, "finish", [], [], [], None, None) for i in range(3) for s in (0, 1)], E.RUNS)
    rows = {r.task_id: r for r in E.score_tasks(made, runs, spark.createDataFrame([], E.VERDICTS)).collect()}
    assert all(re.fullmatch(r"ses-00\d", k) for k in rows) and rows["ses-001"].labels == ["no_recommendation"]
