"""Tables: files, duplicates, splits, vectors, lexical search, pools, state, streaming, tools."""

from __future__ import annotations

import json

import pytest
from loomspark.functions import hashing as H
from loomspark.functions.lexicon import Lexicon
from loomspark.operators import cards as K
from loomspark.operators import digest as D
from loomspark.operators import ingest as I
from loomspark.operators import lexical as B
from loomspark.operators import models as M
from loomspark.operators import state as S
from loomspark.operators import supply as P
from loomspark.operators import tasks as G
from loomspark.operators import tools as T
from loomspark.operators import trajectories as R
from loomspark.operators import vectors as V
from loomspark.sources import files as SF
from loomspark.sources import tables as ST
from pyspark.sql import functions as F

ZH = Lexicon()


# ------------------------------------------------------------------ files


@pytest.fixture
def folder(tmp_path):
    body = "第一章 起\n" + "这是一个很长的故事。" * 30
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "某书 作者：张三.txt").write_bytes(body.encode())
    (tmp_path / "b.txt").write_bytes(body.replace("\n", "\r\n").encode())
    (tmp_path / "c.txt").write_bytes(("另一本书。" * 50).encode("gb18030") + b"\xff")
    (tmp_path / "d.txt").write_bytes(b"\xff" * 5000)
    (tmp_path / "._x.txt").write_bytes(b"junk")
    (tmp_path / ".hidden.txt").write_bytes(b"junk")
    return str(tmp_path)


def test_inventory_of_files(spark, folder):
    files = SF.discover(spark, folder)
    inv = SF.inventory(files, ZH).cache()
    rows = {r.relative_path: r for r in inv.collect()}
    assert sorted(rows) == ["a/某书 作者：张三.txt", "b.txt", "c.txt", "d.txt"]
    assert rows["a/某书 作者：张三.txt"].title_guess == "某书" and rows["a/某书 作者：张三.txt"].author_guess == "张三"
    assert (rows["c.txt"].read_status, rows["c.txt"].decode_replacement_chars, rows["d.txt"].read_status) == ("ok", 1, "failed")
    assert rows["b.txt"].estimated_chapter_count == 1
    marked = I.mark_content_duplicates(inv)
    dup = {r.relative_path: r.is_duplicate for r in marked.collect()}
    assert dup == {"a/某书 作者：张三.txt": False, "b.txt": True, "c.txt": False, "d.txt": False}
    ids = inv.where("relative_path = 'b.txt'").select("novel_id")
    assert SF.texts(inv, files, ids).count() == 1
    report = I.duplicate_report(marked, I.near_duplicates(marked)).first()
    assert (report.exact, report.near, report.groups) == (1, 0, 1)


def test_codecs():
    assert SF.decode("é".encode())[:2] == ("é", "utf-8") and SF.decode("中文".encode("gb18030"))[:2] == ("中文", "gb18030")
    odd = b"\xff" * 5000
    assert SF.decode(odd, guess=lambda raw: ("latin-1", 0.9))[:2] == ("\xff" * 5000, "latin-1") and SF.decode(odd, guess=lambda raw: ("latin-1", 0.1))[0] is None
    assert SF.decode(odd, guess=lambda raw: ("no such codec", 0.9))[3] == "no codec fits"
    assert SF.decode(b"\xef\xbb\xbfa")[0] == "﻿a" and SF.decode(b"\xff" * 5000)[0] is None


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    assert SF.read_jsonl(spark, path, "k string, v int").count() == 0
    SF.append_jsonl(spark.createDataFrame([("a", 1)], "k string, v int"), path)
    SF.append_jsonl(spark.createDataFrame([("a", 2), (None, 3)], "k string, v int"), path)
    (tmp_path / "log" / "part-x.json").write_text('{"k": "b", "v": 4}\n\n{broken\n')
    rows = SF.read_jsonl(spark, path, "k string, v int")
    assert {(r.k, r.v) for r in S.latest(rows, ["k"], ["v"]).collect()} == {("a", 2), ("b", 4)}
    with pytest.raises(ValueError, match="k"):
        SF.read_jsonl(spark, path, "k string, v int", required=("k",))
    a, b = spark.createDataFrame([("t", 1)], "task_id string, x int"), spark.createDataFrame([("t", 2)], "task_id string, x int")
    assert SF.task_records([a, b]).first().x == 2


def test_judged_sheets(spark, tmp_path):
    (tmp_path / "s.csv").write_text("query_id,novel_id,relevance_label,constraint_violation,notes\nq,a,2.0,yes,\nq,b,bad,no,x\n")
    rows = {r.novel_id: r for r in SF.manual_judgements(spark, str(tmp_path)).collect()}
    assert (rows["a"].relevance_label, rows["a"].constraint_violation, rows["b"].relevance_label) == (2, True, 0)
    (tmp_path / "s.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="query_id"):
        SF.manual_judgements(spark, str(tmp_path))


def test_near_duplicates_need_title_author_and_length(spark):
    rows = [("a", "1", "x", "T", "A", 10000), ("b", "2", "y", "T", "A", 9950), ("c", "3", "z", "T", "B", 9950), ("d", "4", "w", "T", "A", 9000), ("e", "5", "v", "T", None, 10000)]
    inv = spark.createDataFrame(rows, "novel_id string, relative_path string, content_sha256 string, title_guess string, author_guess string, char_count long").withColumn("read_status", F.lit("ok"))
    assert [(r.novel_id, r.near_duplicate_of) for r in I.near_duplicates(I.mark_content_duplicates(inv)).collect()] == [("b", "a")]


def test_splits_are_stable(spark):
    inv = spark.range(300).select(F.col("id").cast("string").alias("novel_id"), F.sha2(F.col("id").cast("string"), 256).alias("content_sha256"), F.lit("ok").alias("read_status"), (F.col("id") % 10 == 3).alias("is_duplicate"))
    a = {r.novel_id: r.fold for r in H.build_splits(inv, 0.3, "s").collect()}
    b = {r.novel_id: r.fold for r in H.build_splits(inv.where("cast(novel_id as int) < 100"), 0.3, "s").collect()}
    assert all(a[k] == v for k, v in b.items()) and len(a) == 270 and 40 < sum(v == "eval" for v in a.values()) < 120
    assert H.split_report(inv).first().duplicates == 30
    with pytest.raises(ValueError, match="is_duplicate"):
        H.build_splits(inv.drop("is_duplicate"), 0.3, "s")


# ------------------------------------------------------------------ vectors and words


def test_pooling(spark):
    rows = [("a", "blurb", [1.0, 0.0, 0.0]), ("a", "middle", [0.0, 1.0, 0.0]), ("b", "middle", [0.0, 1.0, 0.0]), ("b", "ending", [0.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "novel_id string, kind string, embedding array<float>")

    def pooled(**kw):
        return {r.novel_id: [round(x, 4) for x in r.embedding] for r in V.pool_books(df, "novel_id", "kind", **kw).collect()}

    unit = lambda *v: [round(x / sum(y * y for y in v) ** 0.5, 4) for x in v]
    assert pooled() == {"a": unit(1, 1, 0), "b": unit(0, 2, 1)}
    assert pooled(weights={"blurb": 3.0})["a"] == unit(3, 1, 0)
    assert pooled(weights={"blurb": 0.0, "middle": 0.0}) == {"a": unit(1, 1, 0), "b": unit(0, 1, 1)}
    more = spark.createDataFrame([("a", "blurb", [1.0, 0.0, 0.0])] + [("a", "middle", [0.0, 1.0, 0.0])] * 3, "novel_id string, kind string, embedding array<float>")
    got = [round(x, 4) for x in V.pool_books(more, "novel_id", "kind", kind_mean=True).first().embedding]
    assert got == unit(1, 1, 0) and [round(x, 4) for x in V.pool_books(more, "novel_id", "kind").first().embedding] == unit(1, 3, 0)


def test_search_and_filters(spark):
    e = spark.createDataFrame([(i, [1.0 if j == i else 0.1 for j in range(4)]) for i in range(4)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in V.topk(e, [1.0, 0.0, 0.0, 0.0], 2).collect()] == [0, 1]
    only = e.where("vec_id > 1")
    assert [r.vec_id for r in V.topk(e, [1.0, 0.0, 0.0, 0.0], 5, allowed=only).collect()] == [2, 3]
    assert [r.vec_id for r in V.topk(e, [1.0, 0.0, 0.0, 0.0], 5, avoid=only).collect()] == [0, 1]
    with pytest.raises(ValueError):
        V.topk(e, [1.0], 0)
    assert V.topk(e, [], 3).count() == 0
    q = e.where("vec_id = 1").select(F.lit("q").alias("query_id"), "embedding")
    assert [r.vec_id for r in V.topk_batch(q, e, 2).orderBy("rank").collect()] == [1, 0]
    assert V.topk_batch(q.limit(0), e, 2).count() == 0
    bad = spark.createDataFrame([([1.0, float("nan")],), ([],), ([1.0, 2.0],), (None,)], "v array<float>")
    assert [r.ok for r in bad.select(V.valid("v", 2).alias("ok")).collect()] == [False, False, True, False]


def test_lexical(spark):
    d = spark.createDataFrame([("a", "red dragon"), ("b", "blue sea"), ("c", "green tree")], "doc_id string, text string")
    find = lambda q, k=5: [r.doc_id for r in B.search(spark.createDataFrame([("q", q)], "query_id string, query string"), d, k, "query_id", "query", "doc_id", "text").collect()]
    assert find("blue dragonfly") == ["b"] and find("unknown") == [] and find("blue", 0) == []
    one, two = (spark.createDataFrame(x, "id string, rank int") for x in ([("a", 1), ("b", 2)], [("b", 1), ("a", 2)]))
    assert [r.id for r in B.fuse([one, two], [], "id", weights=[1.0, 3.0]).orderBy("rank").collect()] == ["b", "a"]
    assert [r.id for r in B.fuse([one, two], [], "id").orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        B.fuse([one, two], [], "id", weights=[1.0])


# ------------------------------------------------------------------ cards, rules, pools


def test_rule_keeps_its_silence(spark):
    d = spark.createDataFrame([(0.0,), (9.0,), (2.0,), (None,)], "d double")
    assert [r.v for r in d.select(K.violation("d").alias("v")).collect()] == [False, True, None, None]
    m = spark.createDataFrame([({"系统": 2.0, "任务奖励": 1.5},), ({},), (None,)], "m map<string,double>")
    by = lambda t: [r.v for r in m.select(K.violation_by_terms("m", t, ZH).alias("v")).collect()]
    assert by(["系统"]) == [True, False, None] and by(["后宫"]) == [None, None, None]


def test_card_filters(spark):
    rows = [("a", "G", "s1", ["x"], [], {"d": "1"}), ("b", "G", "s2", ["y"], ["z"], {"d": "2"}), ("c", "H", "s3", [], ["y"], {})]
    c = spark.createDataFrame(rows, "novel_id string, genre string, subgenre string, elements array<string>, elements_unverified array<string>, style map<string,string>")
    pick = lambda **kw: sorted(r.novel_id for r in K.CardFilter(**kw).select(c).collect())
    assert pick(genre="G") == ["a", "b"] and pick(genre="G", subgenre="s1") == ["a"] and pick(elements=("y",)) == ["b", "c"]
    assert pick(genre="G", elements=("y",), style=(("d", "2"),)) == ["b"] and pick() == ["a", "b", "c"]
    v = K.card_verdict("t", {"t": {"element": "x", "style": ("d", "1")}})
    assert [(r.v and r.v.verdict) for r in c.select(v.alias("v")).collect()] == ["yes", "no", None]


def test_pool_metrics(spark):
    rows = spark.createDataFrame([("m", "q1", 1, "a"), ("m", "q1", 2, "b"), ("m", "q1", 3, "c"), ("m", "q2", 1, "d")], "config string, query_id string, rank int, novel_id string")
    v = spark.createDataFrame([("q1", "a", 2, False), ("q1", "b", 2, True), ("q1", "c", 1, False)], "query_id string, novel_id string, positive int, violated boolean")
    r = P.judged_metrics(rows, v, 10).first()
    assert (r.precision_strict, r.precision_lenient, r.coverage, r.feasible_strict, r.queries) == (0.6667, 1.0, 0.75, 0.0, 1)
    assert P.judged_metrics(rows, v, 10, needed=2).first().feasible_lenient == 1.0 and P.judged_metrics(rows.where("query_id = 'q2'"), v, 10).count() == 0
    done = {r.kind: r for r in P.recommendation_metrics(rows.withColumn("kind", F.lit("k")), v).collect()}
    assert [done["all"][c] for c in ("sessions", "recommended", "coverage", "strict", "lenient", "violation", "usable", "all_usable")] == [1, 4, 0.75, 0.6667, 1.0, 0.3333, 0.6667, 0.0]
    bands = spark.createDataFrame([(-0.1,), (0.0,), (0.2,), (0.4,), (0.79,), (0.8,)], "k double").select(P.kappa_band(F.col("k")).alias("b"))
    assert [r.b for r in bands.collect()] == ["worse than chance", "slight", "fair", "moderate", "substantial", "almost perfect"]
    w = spark.createDataFrame([(65, 75), (0, 0)], "s long, n long").select(P.wilson(F.col("s"), F.col("n")).alias("w")).collect()
    assert 0.77 < w[0].w.low < 0.78 and 0.92 < w[0].w.high < 0.93 and w[1].w is None
    a = spark.createDataFrame([("《Abc》 two",), ("xabc",), ("",)], "t string").select(P.title_matches_anchor("t", F.lit("abc")).alias("m"))
    assert [r.m for r in a.collect()] == [True, False, False]
    k = spark.createDataFrame([(0, 0), (1, 1)], "a int, b int")
    assert P.kappa(k, "a", "b").first().kappa == 1.0 and P.kappa(k.where("a = 1"), "a", "b").first().kappa == 1.0
    assert P.kappa(k.where("a = 1"), "a", "b", degenerate="null").first().kappa is None


# ------------------------------------------------------------------ digests


def book(n, text="这是正文。"):
    return "内容简介：\n一个故事。\n\n" + "\n".join(f"第{i + 1}章 题{i + 1}\n{text * 200}" for i in range(n)) + "\n全书完"


def test_digests():
    sections, used = D.make_digest(book(40), ZH, "书", "人")
    assert sections[0][1] == f"标题：书\n作者：人\n长度：约{len(book(40))}字\n章节数：约40章\n结局：完结标记\n\n内容简介：\n一个故事。"
    titles = dict(sections)["titles"].split("\n")
    assert titles[0] == "章节目录（抽样）：" and titles[1].split(" / ")[:2] == ["第1章 题1", "第2章 题2"]
    kinds = [k for k, _ in sections]
    assert kinds == ["blurb"] + ["opening"] * 4 + ["titles"] + ["middle"] * 6 + ["ending"] * 2 and len(used) == 12
    assert used[:4] == [0, 1, 2, 3] and used[-2:] == [38, 39] and used[4:10] == [4 + int(f * 34) for f in (0.15, 0.30, 0.45, 0.60, 0.75, 0.90)]
    for a, b in (("番外", "后记"), ("作者的话", "完本感言"), ("上架通知", "请假"), ("公告", "新书推荐")):
        tail = book(10).replace("题10", a).replace("题9", b)
        assert D.digest_indices(D.split_chapters(tail, ZH))["ending"] == [6, 7]
    long = D.make_digest(book(10, "一二三四五六七八九十" * 6 + "。"), ZH)[0]
    assert max(len(t) for k, t in long if k in ("opening", "middle", "ending")) <= 8000 + len("第10章 题10\n")
    assert len(D.sample_titles([(i, str(i), "") for i in range(300)], list(range(300)), 10)) == 10
    plain, none = D.make_digest("一句话。" * 3000, ZH)
    assert none == [] and plain[1][0] == "opening" and len(plain[1][1]) == 12000 + len("开头：\n") and [k for k, _ in plain] == ["blurb", "opening", *["middle"] * 6, "ending"]
    assert plain[2][1].startswith("中段 15%：\n") and plain[-1][1].startswith("结尾：\n")
    assert D.split_chapters("  ", ZH) == [] and D.split_chapters("x", ZH) == [(1, "全文", "x")]


def test_profiles_and_excerpts():
    text = D.make_profile("书", "人", 10, 2, "简介文字", ["甲。" * 100, "乙"], 300)
    assert text.startswith("标题：书\n作者：人\n长度：约10字\n章节数：约2章\n\n内容简介：\n简介文字\n\n正文节选：\n节选1：\n甲。") and text.endswith("节选2：\n乙") and len(text) <= 300
    assert D.split_profile(text)[0] == ("blurb", "标题：书\n作者：人\n长度：约10字\n章节数：约2章\n\n内容简介：\n简介文字") and D.split_profile(text)[2] == ("excerpt", "标题：书\n乙")
    assert D.split_profile(" ") == [] and D.split_profile("x") == [("blurb", "x")] and "作者" not in D.make_profile("书", "", 1, 1, "", [])
    assert D.window_excerpts("一二三。四五六", [0.0, 0.9], 4, ZH.sentence_ends) == ["一二三。", "。四五六"]
    chapters = [("opening", "第1章", "第1章 起\n" + "这一句话只在第一章里出现过一次而已\n" + "短句\n" + "这一句话两章都有所以不能拿来提问的"), ("middle", "第2章", "第2章\n这一句话两章都有所以不能拿来提问的")]
    assert D.quote_lines(chapters, 0) == []
    chapters[0] = ("opening", "第1章", "第1章 起\n这一句话独独出现过一次而已别无他处\n短句\n这一句话两章都有所以不能拿来提问的")
    assert D.quote_lines(chapters, 0) == ["这一句话独独出现过一次而已别无他处"]


def test_chunks():
    text = "\n".join("段落文字。" * (3 + i % 5) for i in range(60))
    pieces = D.chunk_text(text, 300)
    assert "\n".join(pieces) == text and max(map(len, pieces)) <= 300 and min(map(len, pieces)) > max(map(len, pieces)) / 2
    assert [len(p) for p in D.chunk_text("字" * 1200, 500)] == [500, 500, 200]
    heads = [t.split("\n")[0] for _, t in D.chunk_section("opening", "标题\n" + "内容。" * 400, 500)]
    assert set(heads) == {"标题"} and len(heads) > 2
    assert D.split_long("一。" * 5 + "二" * 7, 4) == ["一。一。", "一。一。", "一。", "二二二二", "二二二"] and D.chunk_section("k", " x ", 9) == [("k", " x ")] and D.chunk_section("k", " ", 9) == []
    assert D.chunk_text("a / b / c", 4) == ["a /", "b /", "c"]


def test_evidence_avoids_the_digest():
    chapters = D.split_chapters(book(40), ZH)
    used = {i for v in D.digest_indices(chapters).values() for i in v}
    picks = D.judge_indices("n", chapters)
    assert len(picks) == 6 and not set(picks) & used and picks == D.judge_indices("n", chapters) != D.judge_indices("n", chapters, salt="x")
    assert D.judge_indices("n", chapters[:2]) == [] and D.judge_indices("n", chapters, 0) == [] and len(D.judge_indices("n", chapters[:12])) >= 1
    text = D.judge_evidence(book(40), "n", ZH)
    assert text.startswith("【作品简介】\n一个故事。\n\n[……]\n\n第") and text.count("\n\n[……]\n\n") == 6 and D.judge_evidence(" ", "n", ZH) == ""
    assert D.judge_evidence("一句话。" * 3000, "n", ZH).count("[……]") == 5
    assert D.profile_indices(5) == [0, 1, 2, 3] and D.profile_indices(10) == list(range(9)) and D.profile_indices(0) == [] and D.profile_indices(100)[:4] == [0, 1, 2, 3] and max(D.profile_indices(100)) == 94


def test_digest_tables(spark):
    df = spark.createDataFrame([("a", book(20)), ("b", ""), ("c", None)], "novel_id string, text string")
    d = D.digests(df, "novel_id", "text", ZH)
    assert [(r.novel_id, r.ending_status) for r in d.collect()] == [("a", "完结标记")]
    cards = spark.createDataFrame([("a", "card")], "novel_id string, card_text string")
    s = D.section_table(d, "novel_id", 400, ZH, cards)
    rows = s.orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(rows))) and rows[-1].kind == "card"
    joint = {(r.kind, r.ordinal, r.text) for r in rows}
    later = D.append_cards(D.section_table(d, "novel_id", 400, ZH), cards, "novel_id")
    assert {(r.kind, r.ordinal, r.text) for r in later.collect()} == joint
    assert D.without_kind(s, "card").where("kind = 'card'").count() == 0
    with pytest.raises(ValueError):
        D.without_kind(s.where("kind = 'card'"), "card")
    chapters = D.chapters_table(df, "novel_id", "text", ZH)
    assert [r.novel_id for r in D.qa_books(chapters, spark.createDataFrame([("a", "长书名")], "novel_id string, title string")).collect()] == ["a"]
    assert d.select(F.size(D.digest_chapters("sections")).alias("n"), F.size(D.sampled_titles("sections")).alias("t")).first() == (12, 20)


# ------------------------------------------------------------------ state, streaming


def test_stream_equals_batch(spark, tmp_path):
    from loomspark.streaming.memory import current_state, latest_stream

    src = tmp_path / "log"
    src.mkdir()
    seq = 0
    for f in range(3):
        lines = []
        for i in range(10):
            seq += 1
            lines.append(json.dumps({"k": f"k{(seq * 7) % 6}", "v": seq, "seq": seq}))
        (src / f"{f}.json").write_text("\n".join(lines))
    q = latest_stream(spark, str(src), "k string, v int, seq int", str(tmp_path / "state"), str(tmp_path / "cp"), ["k"], ["seq"])
    q.awaitTermination()
    got = {(r.k, r.v) for r in current_state(spark, str(tmp_path / "state"), 2).collect()}
    want = {(r.k, r.v) for r in S.latest(spark.read.schema("k string, v int, seq int").json(str(src)), ["k"], ["seq"]).collect()}
    assert got == want and len(got) == 6


def test_memory_and_session():
    m = T.Memory()
    m.write("positive", "a", False)
    m.write("positive", "b", True)
    m.write("positive", " a ", True)
    assert list(m.entries) == [("positive", "b"), ("positive", "a")] and m.saved() == [("positive", "b"), ("positive", "a")]
    m.write("positive", "a", False)
    assert m.saved() == [("positive", "b")]
    assert m.forget("positive", "b") == 1 and m.forget("positive", "b") == 0 and m.summary() == "偏好：a"
    for kind, v in (("likes", "a"), ("positive", " ")):
        with pytest.raises(ValueError):
            m.write(kind, v, True)
    s = T.Session()
    s.note_recommendations([{"novel_id": "x", "title": "X"}, {"novel_id": "x", "title": "Y"}])
    assert s.exclude(["y", "y", "z"]) == ["y", "z"] and s.exclude(["y"]) == [] and s.avoid() == {"x", "y", "z"} and s.summary() == "1. X\nexcluded: y, z"


# ------------------------------------------------------------------ tools and loop


@pytest.fixture
def engine(spark):
    texts = [("a", "red dragon"), ("b", "blue sea"), ("c", "green tree")]
    e = spark.createDataFrame([(i, [float(x) for x in M.encode_texts(M.CharHash(), [t])[0]]) for i, t in texts], "novel_id string, embedding array<float>")
    c = spark.createDataFrame([("a", "仙侠", "幻想修仙", ["系统"], [], {"爽度": "高"}), ("b", "都市", "都市生活", [], [], {})], "novel_id string, genre string, subgenre string, elements array<string>, elements_unverified array<string>, style map<string,string>")
    d = spark.createDataFrame([("a", {"系统": 9.0}), ("b", {"系统": 0.0})], "novel_id string, densities map<string,double>")
    p = e.withColumns({"ordinal": F.lit(0), "text": F.lit("passage")})
    return T.Engine(e, lambda t: [float(x) for x in M.encode_texts(M.CharHash(), [t])[0]], cards=c, densities=d, passages=p)


def test_tools(engine):
    s, m = T.Session(), T.Memory()
    tools = engine.registry(m, s)
    ids = lambda found: [r["novel_id"] for r in found["results"]]
    assert ids(tools.call("search_books", {"query": "red dragon"}))[0] == "a"
    town = tools.call("search_books", {"query": "red", "genre": "都市"})
    assert ids(town) == ["b"] and (town["filter"], town["filter_matches"]) == ("genre 都市", 1) and "excluded" not in town and set(s.seen) == {"a", "b", "c"}
    s.exclude(["a"])
    assert ids(tools.call("search_books", {"query": "red dragon"}))[0] == "a"  # what was shown is left out on request only
    rest = tools.call("search_books", {"query": "red dragon", "exclude_shown": True})
    assert "a" not in ids(rest) and rest["excluded"] == 1
    assert ids(tools.call("similar_books", {"novel_id": "b"}))[0] in ("a", "c")
    assert tools.call("check_term", {"novel_id": "a", "terms": ["系统", "后宫"]}) == {"violation": True, "evidence": {"系统": 9.0}, "uncheckable": ["后宫"]}
    assert tools.call("ask_book", {"novel_id": "a", "question": "red"})["passages"][0]["text"] == "passage" and tools.call("get_profile", {"novel_id": "b"})["genre"] == "都市"
    assert len(ids(tools.call("search_books", {"query": "x", "k": 1, "genre": None}))) == 1
    tools.call("write_memory", {"kind": "positive", "value": "dragons"})
    assert tools.call("read_memory", {}) == "偏好：dragons"
    for name, args in (("nothing", {}), ("search_books", {}), ("search_books", {"query": "x", "y": 1}), ("search_books", {"query": "x", "genre": "没有"}), ("search_books", {"query": " "}), ("search_books", {"query": "x", "k": 21}), ("search_books", {"query": "x", "k": 0}), ("search_books", {"query": "x", "genre": "历史"}), ("similar_books", {"novel_id": "?"}), ("ask_book", {"novel_id": "?", "question": "x"}), ("ask_book", {"novel_id": "a", "question": "x", "k": 6}), ("get_profile", {"novel_id": "?"}), ("search_books", {"query": "x", "genre": "仙侠", "exclude_shown": True})):
        with pytest.raises(ValueError):
            tools.call(name, args)


def test_titles_previews_and_coverage(engine, spark):
    from dataclasses import replace

    text = "作者：某\n【简介】一句话。"
    profiles = spark.createDataFrame([("a", "《红龙》", text), ("b", "《蓝色的大海》", "plain"), ("c", None, None)], "novel_id string, title string, text string")
    sections = spark.createDataFrame([("a", [("opening", "第1章 起\n他来了"), ("blurb", "x")])], "novel_id string, sections array<struct<kind:string,text:string>>")
    e = replace(engine, profiles=profiles, sections=sections)
    found = e.search("蓝色的大海怎么样")["results"]
    assert (found[0]["novel_id"], found[0]["title"], found[0]["score"], found[0]["title_match"], found[0]["preview"]) == ("b", "《蓝色的大海》", 1.0, True, "plain")
    assert all("title_match" not in r for r in found[1:]) and [r["rank"] for r in found] == [1, 2, 3]
    assert e.search("红龙", k=1)["results"][0]["novel_id"] == "a"
    assert all("title_match" not in r for r in e.search("蓝色的大海", genre="仙侠")["results"])  # a filter holds for titles too
    assert all(r["novel_id"] != "b" for r in e.search("蓝色的大海", avoid={"b"})["results"])
    told = e.ask("a", "red")
    assert told["title"] == "《红龙》" and "第1章 起" in told["coverage"] and set(told["passages"][0]) == {"chapter", "kind", "text", "score"}
    assert e.profile("c")["title"] == "" and e.profile("a")["opening"].startswith("作者") and e.profile("a")["genre"] == "仙侠"
    assert e.similar("a", avoid={"b"})["results"][0]["novel_id"] == "c"


def test_agent_ends_in_five_ways(engine):
    tools = engine.registry(T.Memory(), T.Session())
    script = lambda *a: (lambda it: lambda messages: next(it))(iter(a))
    pick = {"finish": {"answer": "ok", "recommendations": [{"novel_id": "a"}]}}
    check = {"tool": "check_term", "arguments": {"novel_id": "a", "terms": ["系统"]}}
    done = T.run_agent(script(check, pick, pick), tools, "hi", ["系统"])
    assert done.termination == "finish" and len(done.steps) == 1 and done.recommendations == [{"novel_id": "a"}]
    assert T.run_agent(script(pick, pick), tools, "hi", ["系统"]).termination == "finish"
    assert T.run_agent(script({"content": "so"}, {}), tools, "hi").termination == "answer_without_finish"
    assert T.run_agent(script({}, check, {}, pick, pick), tools, "hi").termination == "finish"
    assert T.run_agent(script(check, check), tools, "hi").termination == "loop"
    assert T.run_agent(script(check, {"tool": "read_memory"}, check, pick, pick), tools, "hi").termination == "finish"
    assert T.run_agent(script(), tools, "hi").termination == "model_error"
    assert T.run_agent(script({"finish": {"answer": " "}}, pick), tools, "hi").termination == "finish"
    other = {"finish": {"answer": "ok", "recommendations": [{"novel_id": "a"}, {"novel_id": "b"}]}}
    said: list = []
    chat = iter([check, pick, other, other])
    assert T.run_agent(lambda m: (said.append(m[-1]["content"]), next(chat))[1], tools, "hi", ["系统"]).termination == "finish"
    assert "break a condition: a: 系统" in said[2] and "not checked for 系统: b" in said[3]  # each book is refused once for each reason
    many = [{"tool": "read_memory", "arguments": {"x": i}} for i in range(3)]
    last = T.run_agent(script(*many), tools, "hi", max_steps=3)
    assert last.termination == "max_steps" and all(s["error"] for s in last.steps)
    assert len(T.render(["x" * 9000])) == 6000


def test_judging_skips_the_cache_and_failures(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, x int")
    cache = spark.createDataFrame([("a", "old")], "k string, raw string")
    got = {r.k: r.raw for r in M.judge(t, cache, "k", lambda r: "new" if r["x"] == 2 else 1 / 0).collect()}
    assert got == {"a": "old", "b": "new"}
    assert sorted(r.x for r in M.within_budget(t, "x", F.col("x") * 1.0, 3.0).collect()) == [1, 2]


# ------------------------------------------------------------------ trajectories, tasks


def test_trajectories(spark):
    hits = json.dumps([{"novel_id": "a", "title": "A"}, {"novel_id": "b", "title": "B"}])
    wrapped = json.dumps({"results": [{"novel_id": "b", "title": "B"}, {"novel_id": "c", "title": "C"}]})
    step = lambda *o: {"observations": [{"tool": t, "arguments": a, "result": r, "error": e} for t, a, r, e in o]}
    one = [step(("search_books", {"query": "x"}, hits, None), ("search_books", {"query": "y"}, None, "failed")), step(("search_books", {"query": "x"}, wrapped, None), ("check_term", {"novel_id": "a", "term": "系统"}, "{}", None), ("check_term", {"novel_id": "a", "term": "任务奖励"}, "{}", None), ("check_term", {"novel_id": "a", "term": "别的"}, "{}", None))]
    rows = [("t1", 0, one, [{"novel_id": "a", "title": "A"}, {"novel_id": "z", "title": "Z"}], "see [第一章]"), ("t2", 0, [], [], "")]
    tr = spark.createDataFrame(rows, R.SCHEMA)
    tasks = spark.createDataFrame([("t1", "rec")], "task_id string, kind string")
    assert [(r.config, r.rank, r.novel_id) for r in R.observed_supply(tr, tasks).orderBy("config", "rank").collect()] == [("recommended", 1, "a"), ("recommended", 2, "z"), ("seen", 1, "a"), ("seen", 2, "b"), ("seen", 3, "c")]
    assert [(r.query, r.number) for r in R.trajectory_queries(tr, tasks).orderBy("number").collect()] == [("x", 1), ("y", 2)]
    v = spark.createDataFrame([("a", True), ("z", None)], "novel_id string, violation boolean")
    scored = {r.task_id: r for r in R.score_sessions(tr, v).collect()}
    assert scored["t1"].labels == ["ungrounded", "violation", "unchecked"] and scored["t1"].undecided == 0.5 and scored["t2"].labels == ["too_few"]
    assert {r.task_id: r.passed for r in R.score_tasks(R.score_sessions(tr, v, least=0)).collect()} == {"t1": False, "t2": True}
    assert R.cited(tr).first().chapter == "第一章" and R.checked(tr, "check_term", "term").first().checked == ["任务奖励", "别的", "系统"] and R.asked(tr).count() == 0
    red = R.redacted(tr).where("task_id = 't1'").first()
    assert json.loads(red.final_answer)["length"] == len("see [第一章]") and "novel_id" not in red.steps[0].observations[0].result
    p = spark.createDataFrame([("t", ["setup", "request", "request"], ["p", "q"])], "task_id string, sessions array<string>, positives array<string>")
    assert [(r.session, r.positive) for r in R.session_positives(p).orderBy("session").collect()] == [(1, "p"), (2, "q")]
    old = spark.createDataFrame([(0, ["a"]), (1, ["b"]), (2, ["b"])], "ordinal int, messages array<string>")
    assert [r.task_id for r in R.new_tasks(old, old.where("ordinal = 0"), "x").collect()] == ["x-1"]
    pool = spark.createDataFrame([("t", 1, "a"), ("t", 2, "c"), ("s", 1, "a")], "task_id string, rank int, novel_id string")
    assert [r.task_id for r in R.precheck(pool, spark.createDataFrame([("a", True), ("c", False)], "novel_id string, violation boolean")).collect()] == ["t"]
    rw = spark.createDataFrame([("t1", 0, "new", None), ("t1", 1, " ", None), ("no", 2, "x", None)], "task_id string, ordinal int, query string, variant string")
    assert [r.query_id for r in R.rewritten_queries(rw, tasks).collect()] == ["t1~1"]
    assert R.task_queries(p).first().query == "p q" and R.legacy_queries(spark.createDataFrame([("科幻 不要系统", None)], "query string, positives array<string>"), ZH).first().positives == ["科幻"]


def test_generators():
    a = G.constrained(9, ["p"], ["n", "m", "x"], {"p": {"x"}})
    assert a == G.constrained(9, ["p"], ["n", "m", "x"], {"p": {"x"}}) and [len(t.negatives) for t in a[:3]] == [1, 2, 0] and all("x" not in t.negatives for t in a)
    assert [t.variant for t in G.memory(3, ["p"], ["n"])] == ["persists", "session_only", "forgets"] and len(G.memory(3, ["p"], ["n"])[2].sessions) == 3
    assert len(G.clarify(5, ["a", "b"])) == 2 and [t.variant for t in G.session_state(3, ["p"])] == ["more", "like_nth", "exclude_nth"]
    qa = G.book_qa({"b": [(1, "第1章", "短"), (2, "第2章", "短")]}, 5)
    assert {t.meta["novel_id"] for t in qa} == {"b"} and qa[4].variant == "chapter_event" and G.book_qa({}, 3) == []
    assert G.score_qa(["第1章"], ["b"], G.Task("t", "book_qa", (), meta={"novel_id": "b", "chapter": "第1章"}), lambda a, b: a == b) == []
    assert G.score_qa([], [], G.Task("t", "book_qa", (), meta={"novel_id": "b", "chapter": "第1章"}), lambda a, b: a == b) == ["not_asked", "other_chapter"]
    assert G.format_summary([{"a": 1}], ["a", "b"]) == "| a | b |\n| - | - |\n| 1 |  |"


def test_index_tables(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0])], "novel_id string, embedding array<float>")
    ST.save_index(v, str(tmp_path / "i"))
    with pytest.raises(Exception, match="exists"):
        ST.save_index(v, str(tmp_path / "i"))
    ST.save_index(v, str(tmp_path / "i"), overwrite=True)
    assert ST.load_index(spark, str(tmp_path / "i")).count() == 1
    assert ST.index_metadata(spark, "m", 64, 1, True, "s", None).first().dim == 64
    rows = ST.id_map(spark.range(50).select(F.col("id").alias("k"), F.lit("t").alias("title"), F.lit("x").alias("text")), "k", "title", "text").collect()
    assert sorted((r.k, r.row) for r in rows) == [(i, i) for i in range(50)]
    assert ST.density_map(spark.createDataFrame([("a", 1.0, None)], "k string, x double, y double"), "k", ["x", "y"]).first().densities == {"x": 1.0, "y": 0.0}


def test_row_numbers_hold_where_ranges_are_sampled(spark, tmp_path):
    from loomspark.sources import tables as ST

    k = F.col("id") * 7919 % 20_000
    spark.range(20_000).select(k.alias("k"), F.md5(k.cast("string")).alias("title"), F.sha2(k.cast("string"), 256).alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = ST.id_map(spark.read.parquet(str(tmp_path / "t")), "k", "title", "text").collect()
    assert sorted((r.k, r.row) for r in rows) == [(i, i) for i in range(20_000)]
