"""Text scalars with hand-computed values."""

from __future__ import annotations

import pytest
from loomspark.functions import hashing as H
from loomspark.functions import jsons as J
from loomspark.functions import text as X
from loomspark.functions.lexicon import LATIN, Lexicon
from loomspark.operators import models as M
from loomspark.operators.cards import CardFilter, Vocabulary
from pyspark.sql import functions as F

ZH = Lexicon()


def value(spark, column, **cells):
    row = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells))
    return row.select(column.alias("v")).first().v


def test_white_space(spark):
    assert value(spark, X.normalize_whitespace("t"), t="﻿a\x00\r\nb\t\tc 　 d \n\n\n\n e　") == "a\nb c d\n\ne"
    assert value(spark, X.squash("t"), t=" a　b\n c") == "abc"
    assert value(spark, X.bare("t"), t="“你好”，world! ") == "你好world"


def test_boilerplate(spark):
    ruler = "=" * 12
    r = value(spark, X.remove_boilerplate("t"), t=f"{ruler}\n更多精校小说尽在知轩藏书下载\n{ruler}\nbody")
    assert (r.text, r.detected, r.removed) == ("body", True, 3)
    r = value(spark, X.remove_boilerplate("t"), t=f"body\n{ruler}\nmore")
    assert (r.removed, r.detected) == (0, False)
    middle = "\n".join(["x"] * 150) + f"\n知轩藏书\n{ruler}\n" + "\n".join(["y"] * 150)
    assert value(spark, X.remove_boilerplate("t"), t=middle).removed == 1
    assert value(spark, X.remove_ad_lines("t"), t="a\nsee http://x.y\nwww.z\nb") == "a\nb"


def test_titles_and_authors(spark):
    assert value(spark, X.title_from_stem("t"), t="《某书》（校对版全本）作者：张三") == "《某书》"
    assert value(spark, X.title_from_stem("t"), t="某书【精校版】 ( )  上 -_ by Someone") == "某书 上" and value(spark, X.title_from_stem("t"), t="txt") == "txt"
    assert value(spark, X.author_of("t"), t="某书 作者：张三 - ") == "张三" and value(spark, X.author_of("t"), t="某书") is None
    assert value(spark, X.author_of("t"), t="x by （A B）-") == "A B" and value(spark, X.author_of("t"), t="作者： - by C") == "by C"
    assert value(spark, X.peel_title("t"), t=" 《〈某书》> ") == "某书" and value(spark, X.normalize_title("t"), t="《A b》-C(d)") == "abc(d)"
    assert value(spark, X.title_key("t"), t=" 《A b》「c」<d>") == "Abcd"


def test_chapters(spark):
    text = "第一章 起\nx\n第2章\ny\nChapter 3\nz\n第一章 起"
    assert value(spark, X.chapter_titles("t"), t=text) == ["第一章 起", "第2章", "Chapter 3", "第一章 起"]
    assert value(spark, X.chapter_count("t"), t=text) == 3


@pytest.mark.parametrize("s,n", [("十", 10), ("十二", 12), ("二十", 20), ("一百零五", 105), ("三千二百一十", 3210), ("一万二千", None), ("两百", 200), ("零", 0), ("百", 100), ("x", None), ("", 0)])
def test_numerals(spark, s, n):
    assert value(spark, X.numeral("t"), t=s) == n


def test_chapter_numbers(spark):
    for t, n in ((" 第十二章 x", 12), ("第１２章", 12), ("第184章 题", 184), ("第 7 回", None), ("后记 第3章", None), ("第3卷", None), ("序", None)):
        assert value(spark, X.chapter_number("t"), t=t) == n
    m = X.match_chapter("a", "b")
    assert value(spark, m, a="第十二章", b="第12章 起") and not value(spark, m, a="第3章", b="第4章")
    assert value(spark, m, a="风起云涌", b="序 风起云涌") and not value(spark, m, a="风起", b="序 风起云涌")


def test_trim(spark):
    assert value(spark, X.trim_to_sentence("t", 10), t="一二三四五六。八九十十一") == "一二三四五六。"
    assert value(spark, X.trim_to_sentence("t", 10), t="一。三四五六七八九十十一") == "一。三四五六七八九十"
    assert value(spark, X.trim_to_sentence("t", 4), t="　一二  三四 ") == "一二"
    assert value(spark, X.truncate("t", 8), t="一二三四五六七八九十") == "一二三…[截断]" and value(spark, X.truncate("t", 0), t="ab") == "ab"


def test_blurbs(spark):
    text = "书名\n内容简介：\n一个故事。\n第一章 起\n正文"
    assert value(spark, X.blurb("t"), t=text) == "一个故事。" and value(spark, X.blurb("t"), t="没有") == ""
    for t, status in (("……全书完", "完结标记"), ("本书完结", "完结标记"), ("（完）", "完结标记"), ("未完", "无标记"), ("全剧终", "无标记")):
        assert value(spark, X.ending_status("t"), t=t) == status
    assert value(spark, X.synopsis_preview("t"), t="标题：书\n作者：张三\n\n内容简介：\n好书\n\n正文节选：\n节选1：\nx") == "作者：张三\n好书"
    assert value(spark, X.synopsis_preview("t", 4), t=" 没有简介的 ") == "没有简介"


def test_density(spark):
    assert value(spark, X.term_density("t", "aa"), t="aaaa") == pytest.approx(2 / 4 * 1e5)
    assert value(spark, X.term_density("t", "a"), t="") == 0 and value(spark, X.term_density("t", ""), t="a") == 0
    assert value(spark, X.merged_density("t", ("系统", "任务奖励")), t="系统任务奖励系统x") == pytest.approx(3 / 9 * 1e5)


def test_queries(spark):
    for q, pos, neg in (("科幻 不要系统 女主角", ["科幻", "女", "主角"], ["系统"]), ("不系统，别穿越 避免后宫、无敌", [], ["系统", "穿越", "后宫", "敌"]), ("玄幻 不要 系统", ["玄幻"], ["系统"])):
        r = value(spark, X.parse_query("t"), t=q)
        assert (r.positive, r.negative) == (pos, neg)
    assert value(spark, X.parse_query("t"), t="不一样").negative == ["一样"]  # a short marker misfires, as stated
    assert value(spark, X.retrieval_query("t"), t=" 不要系统 ") == "不要系统"
    assert value(spark, X.required_negatives("t"), t="想看科幻，不要系统和超能力") == ["系统"]
    assert value(spark, X.required_negatives("t"), t="这次不看穿越。来点机甲") == ["穿越"] and value(spark, X.required_negatives("t"), t="恋爱脑的别推，受不了直播") == ["直播"]
    assert value(spark, X.required_negatives("t"), t="系统文，也看别致无聊的") == [] and value(spark, X.required_negatives("t", memory=F.array(F.lit("不喜欢僵尸题材"))), t="你好") == ["僵尸"]
    assert value(spark, X.negative_clauses("t"), t="不要太长的，要系统流；别给校园!ok") == ["不要太长的", "别给校园"]
    assert value(spark, X.quoted_line("t"), t="他说「一二三四五六七」吗") == "一二三四五六七" and value(spark, X.quoted_line("t"), t='"一二三四五六七"「短」') is None


def test_bigrams_and_quotes(spark):
    assert value(spark, X.bigrams("t"), t="你a好吗") == ["你好", "好吗"] and value(spark, X.bigrams("t"), t="你") == []
    s = X.quote_supported("q", "s")
    assert value(spark, s, q="一，二三四", s="零一二三四五") and not value(spark, s, q="一二三", s="一二三")
    assert value(spark, s, q="一二三四五六七八", s="x二三四五六七y") and not value(spark, s, q="一二三四五六七", s="x二三四五六七y")
    assert value(spark, X.tokens("t"), t="你好吗 Hello_1 x") == ["你好", "好吗", "hello_1", "x"]


def test_hashes(spark):
    a, b = (value(spark, H.content_fingerprint("t"), t=t) for t in ("a b\r\nc", "ab c"))
    assert a == b != value(spark, H.content_fingerprint("t"), t="abd")
    assert 0 <= value(spark, H.split_bucket("t", "s"), t="x") < 1
    with pytest.raises(ValueError):
        H.assign_fold("t", 1.0, "s")
    assert H.fractions(3) == [0.0, 0.475, 0.95] and H.fractions(0) == []
    assert len(H.judge_fractions(20)) == 9 and H.judge_fractions(1) == H.judge_fractions(20)[:1] and H.judge_fractions(2, 1) == [0.5]
    points = value(spark, H.jittered("t"), t="a book")
    assert len(points) == 6 and all(abs(p - q) >= 0.08 for p in points for q in (0.0, 0.5)) and points == sorted(points)


def test_vocabulary():
    v = Vocabulary()
    assert v.resolve_genre("仙侠") == ("仙侠", None) and v.resolve_genre("修仙") == ("仙侠", "幻想修仙") and v.resolve_genre("谍战") == ("军事", "谍战特工")
    assert v.resolve_element("金手指") == "系统" and v.resolve_style("爽度：高") == ("爽度", "高") and v.resolve_style("群像") == ("主角结构", "群像")
    for wrong, fn in (("重生", v.resolve_genre), ("没有", v.resolve_genre), ("没有", v.resolve_element), ("爽度=极高", v.resolve_style), ("没有", v.resolve_style)):
        with pytest.raises(ValueError):
            fn(wrong)
    assert CardFilter.parse(v, "修仙", ["系统", "金手指"], ["群像"]) == CardFilter("仙侠", "幻想修仙", ("系统",), (("主角结构", "群像"),))
    assert "仙侠：古典仙侠、幻想修仙、现代修真" in v.text() and "- 系统：有面板、任务、奖励、签到等游戏化外挂" in v.text() and M.card_prompt("p", v.text()).endswith("\n\np")


def test_json_extraction():
    assert J.split_first_object('<think>{"a"}</think>x {"a": {"b": 1}} rest {') == ('{"a": {"b": 1}}', " rest {")
    assert J.first_object('cut off</think> {"a": 1}') == {"a": 1}
    assert J.last_object('{"a": 1} {"b": {"c": 2}} {broken') == {"b": {"c": 2}} and J.last_object("none") is None
    with pytest.raises(ValueError):
        J.split_first_object("no object")
    assert J.split_first_object('a</think>b</think>{"c": 1}') == ('{"c": 1}', "") and J.last_object('{"a": 1} {x {"b": 2}}') == {"a": 1}
    assert J.recommendations('[{"a": 1}]') == ([{"a": 1}], None) and J.recommendations("x")[1] and J.recommendations(None) == J.recommendations("") == ([], None)
    assert J.recommendations_or_none({"a": 1}) == [] and J.recommendations_or_none([{"a": 1}, 2]) == [{"a": 1}]
    v = J.supply_verdict('so {"positive": 7, "violations": {"系统": "yes"}, "confidence": "HIGH"} end', ["系统", "穿越"])
    assert v["positive"] == 2 and v["violations"] == {"系统": True, "穿越": False} and v["confidence"] == "high" and J.supply_verdict("{broken", []) is None
    assert J.supply_verdict('{"positive": "x"}', []) is None and J.supply_verdict("{}", ["a"])["positive"] == 0 and J.supply_verdict('{"positive": 1, "violations": {"a": "是"}}', ["a"])["violations"] == {"a": True}
    v = J.judge_verdict('<think>{系统}</think>{"relevance_label": 2, "constraint_violation": true, "judge_confidence": " High ", "reason": "' + "r" * 500 + '"}')
    assert (v["relevance_label"], v["constraint_violation"], v["judge_confidence"], len(v["reason"])) == (2, True, "high", 400)
    assert J.judge_verdict('{"relevance_label": "bad", "constraint_violation": "是"}') == {"relevance_label": 0, "constraint_violation": False, "reason": "", "judge_confidence": "low"} and J.judge_verdict("nothing") is None
    assert J.trope_verdict('{"verdict": "Yes", "quotes": ["a", "b", "c", "d"], "reason": "because"}') == {"verdict": "yes", "quotes": ["a", "b", "c"], "confidence": "low", "reason": "because"}
    assert J.trope_verdict('{"verdict": "no", "quotes": "one"}')["quotes"] == ["one"]
    for bad in ('{"verdict": "?"}', "nothing"):
        with pytest.raises(ValueError):
            J.trope_verdict(bad)


def test_cards_from_model_output():
    out = '{"subgenre": "仙侠：幻想修仙", "elements": [{"name": "系统", "quote": "眼前弹出一个光屏"}, {"name": "修真"}, "没有"], "style": {"爽度": "高", "基调": "奇怪"}, "keywords": ["a", "a", " b "]}'
    c = J.parse_card("n", out, Vocabulary(), "忽然眼前弹出一个光屏。")
    assert (c["genre"], c["subgenre"], c["elements"], c["elements_unverified"]) == ("仙侠", "幻想修仙", ["系统"], [])
    assert c["style"] == {"主角结构": "", "爽度": "高", "基调": "", "感情线": "", "主角起点": ""} and c["keywords"] == ["a", "b"]
    assert c["dropped"] == ["element_unsupported:修仙=", "element:没有", "style:基调=奇怪"] and c["evidence"] == {"系统": "眼前弹出一个光屏"}
    out = '{"subgenre": "无敌流", "subgenre_evidence": "没有这句话", "elements": {"主角来路": {"穿越": "主角从另一个世界或时代来到故事世界"}, "后宫": "q", "爽度": "低", "特种兵": "他曾是一名特种兵"}, "keywords": ["穿越者", "军旅", "k"], "one_liner": "x", "tone": null}'
    c = J.parse_card("n", out, Vocabulary(), "他曾是一名特种兵。", "m")
    assert (c["genre"], c["subgenre"], c["elements"], c["elements_unverified"]) == ("其他", "", ["军旅"], ["穿越"]) and c["keywords"] == ["k"] and c["model"] == "m"
    assert c["dropped"] == ["subgenre:无敌流", "element_definition:穿越=主角从另一个世界或时代来到故事世界", "subgenre_evidence_unsupported"]
    assert (c["style"]["感情线"], c["style"]["爽度"], c["one_liner"], c["tone"]) == ("多女主", "低", "x", "")
    assert J.parse_card("n", '{"subgenre": "都市小说/都市"}', Vocabulary())["subgenre"] == "都市生活" and J.parse_card("n", '{"subgenre": "言情"}', Vocabulary())["dropped"] == ["subgenre_missing:言情"]
    assert J.element_pairs({"系统": "q", "g": ["a", {"label": "b", "quote": "r"}]}) == [("系统", "q"), ("a", ""), ("b", "r")]


@pytest.mark.parametrize(
    "raw,want",
    [("特种兵", ("军旅特战", "军事")), ("官场", ("官场仕途", "都市")), ("现代都市", ("都市生活", "都市")), ("仙侠", ("幻想修仙", "仙侠")), ("玄幻：东方玄幻", ("东方玄幻", "玄幻")), ("东方玄幻（玄幻）", ("东方玄幻", "玄幻")),
     ("科幻·末世", ("末世危机", "科幻")), ("言情", ("", "言情")), ("言情/别的", ("", "言情")), ("（无限流）", ("无限", "诸天无限")), ("没有", ("", "其他")), ("", ("", "其他"))],
)
def test_sub_genres_with_the_default_names(spark, raw, want):
    got = value(spark, J.normalise_subgenre("t", Vocabulary()), t=raw)
    assert (got.subgenre, got.genre) == want == J.subgenre_of(raw, Vocabulary())


def test_fixed_values_are_whole():
    v = Vocabulary()
    assert (len(v.subgenre_aliases), len(v.element_aliases), len(v.elements), len(v.subgenre_notes)) == (34, 72, 42, 20)
    assert set(v.element_aliases.values()) <= set(v.elements) and all(v.genre_of(s) for s in v.subgenre_aliases.values()) and all(o in v.styles[d] for d, o in v.element_styles.values())
    assert len(ZH.clause_markers) == 13 and len(ZH.related_terms) == 16


def test_weights_and_encoders():
    assert M.parse_weights(["blurb=3", " middle = .5"]) == {"blurb": 3.0, "middle": 0.5}
    for bad in ("x", "=1", "a=b"):
        with pytest.raises(ValueError):
            M.parse_weights([bad])
    v = M.encode_texts(M.CharHash(), ["ab", "", "b"], batch=2)
    assert v.shape == (3, 64) and abs(float((v[0] ** 2).sum()) - 1) < 1e-6 and M.encode_texts(M.CharHash(), []).shape == (0, 0)
    with pytest.raises(ValueError):
        M.encode_texts(M.CharHash(), ["a"], batch=0)

    class Tight(M.CharHash):
        def encode(self, texts):
            if len(texts) > 1:
                raise MemoryError
            return super().encode(texts)

    assert (M.encode_texts(Tight(), ["a", "b", "c"], batch=8) == M.encode_texts(M.CharHash(), ["a", "b", "c"])).all()


def test_encoder_in_a_query(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    got = [r.v for r in df.select(M.encoder_udf(M.CharHash)("t").alias("v")).collect()]
    assert len(got[0]) == 64 and sum(got[1]) == 0


def test_latin_set_is_complete(spark):
    assert set(LATIN.__dataclass_fields__) == set(ZH.__dataclass_fields__)
