"""Answers of models as tables."""

from __future__ import annotations

import json

from loomspark.operators import answers as A
from loomspark.operators.cards import Vocabulary
from pyspark.sql import functions as F

WORDS = Vocabulary(
    genres={"metal": ("tin", "zinc"), "wood": ("oak",)}, elements=("red", "ring"), styles={"size": ("big", "little")}, subgenre_aliases={"eiche": "oak"},
    element_aliases={"hoop": "ring"}, element_styles={"green": ("size", "big")}, element_groups={"all": {"ring": "a round thing"}}, unknown="other",
)


def texts(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "novel_id long, text string").repartition(3)


def values(df, column):
    return [(r.v.value, r.v.error) for r in df.select("novel_id", column.alias("v")).orderBy("novel_id").collect()]


def test_first_object(spark):
    rows = ['<think>{"no": 1}</think> a {"x": {"y": 1}} b {"z": 2}', 'lost {"no": 1}</think>{bad} rest', "nothing", None, "", '{"open": {"x": 1}']
    got = values(texts(spark, rows), A.first_objects("text"))
    assert [(v.head, v.rest, v.parses) if v else None for v, _ in got] == [('{"x": {"y": 1}}', ' b {"z": 2}', True), ("{bad}", " rest", False), None, None, None, None]
    assert [e is not None for _, e in got] == [False, False, True, False, True, True]


def test_last_object(spark):
    got = values(texts(spark, ['{"a": 1} {"b": 2} {c}', "none", None, '{"a": "é"}{']), A.last_objects("text"))
    assert [json.loads(v) if v else None for v, _ in got] == [{"b": 2}, None, None, {"a": "é"}] and not any(e for _, e in got)


def test_recommendation_lists(spark):
    rows = ['[{"novel_id": "1"}, {"novel_id": "2"}]', '[{"novel_id": "1"}, 2]', "words", "", None, '{"novel_id": "1"}']
    strict, loose = (values(texts(spark, rows), A.recommendation_lists("text", strict=s)) for s in (True, False))
    assert [v and len(v) for v, _ in strict] == [2, None, None, [], [], None] and [e is not None for _, e in strict] == [False, True, True, False, False, True]
    assert [len(v) for v, _ in loose] == [2, 1, 0, 0, 0, 0] and not any(e for _, e in loose)


def test_supply_verdicts(spark):
    rows = ['say {"positive": 7, "violations": {"dark": "是", "slow": "no"}, "confidence": "HIGH"}', '{"positive": 1} {"positive": 2}', '{"positive": "some"}', "{}", None]
    got = [v for v, _ in values(texts(spark, rows), A.supply_verdicts("text", F.array(F.lit("dark"), F.lit("slow"))))]
    assert (got[0].positive, got[0].violations, got[0].confidence) == (2, {"dark": True, "slow": False}, "high") and got[1] is None and got[2] is None
    assert (got[3].positive, got[3].violations, got[3].confidence, got[3].reason) == (0, {"dark": False, "slow": False}, "low", "") and got[4] is None
    assert values(texts(spark, ["{}"]), A.supply_verdicts("text", F.lit(None).cast("array<string>")))[0][0].violations == {}


def test_judge_and_trope_verdicts(spark):
    got = [v for v, _ in values(texts(spark, ['{"relevance_label": "1.9", "constraint_violation": "Y", "reason": "' + "r" * 900 + '"}', "nothing", '{"relevance_label": []}']), A.judge_verdicts("text"))]
    assert (got[0].relevance_label, got[0].constraint_violation, len(got[0].reason), got[0].judge_confidence) == (1, True, 400, "low") and got[1] is None and got[2].relevance_label == 0
    told = values(texts(spark, ['{"verdict": "Yes", "quotes": ["' + "q" * 300 + '", "b", "c", "d"]}', '{"verdict": "perhaps"}', "[]"]), A.trope_verdicts("text"))
    assert told[0][0].verdict == "yes" and [len(q) for q in told[0][0].quotes] == [120, 1, 1] and told[1][0] is None and "perhaps" in told[1][1] and told[2][1]


ANSWERS = [
    json.dumps({"subgenre": "eiche", "elements": {"hoop": "wore a ring of gold", "red": "a quote from nowhere", "green": "", "blue": ""}, "style": {"size": ""}, "keywords": ["ring", "gold", "gold", " sea "], "tone": "calm"}),
    json.dumps({"subgenre": "metal", "elements": ["red"], "style": {"size": "huge"}}),
    "no card here",
    None,
]


def test_cards(spark):
    books = texts(spark, ANSWERS).withColumn("book", F.lit("she wore a ring of gold that day"))
    got = A.cards(books, WORDS, source="book", model="m").orderBy("novel_id").collect()
    first, second, third, fourth = got
    assert (first.novel_id, first.genre, first.subgenre, first.elements, first.style, first.keywords, first.model) == ("0", "wood", "oak", ["ring"], {"size": "big"}, ["gold", "sea"], "m")
    assert first.evidence == {"ring": "wore a ring of gold"} and sorted(d.split(":")[0] for d in first.dropped) == ["element", "element_unsupported"]
    assert (second.genre, second.subgenre, second.elements, second.dropped) == ("metal", "", [], ["subgenre_missing:metal", "element_unsupported:red=", "style:size=huge"])
    assert third.genre is None and third.error.startswith("ValueError") and fourth.genre is None and fourth.error
    assert A.cards(books.where("novel_id = 1"), WORDS).first().elements == ["red"]  # without a source, claims count
    assert A.cards(books.limit(0), WORDS).count() == 0


def test_cards_flat_and_back(spark, tmp_path):
    cards = A.cards(texts(spark, ANSWERS[:2]), WORDS).drop("error")
    flat = A.flat_cards(cards)
    assert dict(flat.dtypes)["style"] == dict(flat.dtypes)["elements"] == "string"
    flat.write.parquet(str(tmp_path / "cards"))
    key = lambda r: r.novel_id
    back = A.nested_cards(spark.read.parquet(str(tmp_path / "cards"))).select(cards.columns)
    assert sorted(back.collect(), key=key) == sorted(cards.collect(), key=key)
    text = flat.where("novel_id = '0'").first().card_text
    assert text == "题材：wood·oak\n元素：ring、red\n风格：size big\n气质：calm\n关键词：gold、sea"
    blank = spark.createDataFrame([("1", "g", None, None, "")], "novel_id string, genre string, elements array<string>, style map<string,string>, keywords string").withColumn("subgenre", F.lit(None).cast("string"))
    row = A.flat_cards(blank.drop("keywords")).first()
    assert (row.elements, row.style, row.card_text) == ("[]", "{}", "题材：g")
    assert A.nested_cards(spark.createDataFrame([("1", None, "")], "novel_id string, elements string, style string")).first()[1:] == ([], {})


def test_tropes_ask_only_for_the_rest(spark, tmp_path):
    rules = {"rings": {"element": "ring"}}
    cards = spark.createDataFrame([("a", ["ring"], "", "", {}), ("b", ["red"], "", "", {})], "novel_id string, elements array<string>, subgenre string, genre string, style map<string,string>")
    pairs = spark.createDataFrame([(n, t) for n in "abcde" for t in ("rings", "odd")] + [("a", "rings")], "novel_id string, trope string")
    cache = spark.createDataFrame([("c", "rings", "no", ["q"], "high", "r")], "novel_id string, trope string, verdict string, quotes array<string>, confidence string, reason string")
    texts = spark.createDataFrame([("a", "x"), ("b", "good"), ("d", "bad"), ("e", "")], "novel_id string, evidence string")
    log = tmp_path / "calls"
    log.mkdir()

    def ask(prompt):
        (log / prompt.replace("|", "_")).touch(exist_ok=False)  # a second call of one prompt fails
        return '{"verdict": "yes", "quotes": ["g"], "confidence": "medium"}' if "good" in prompt else "what?"

    told, fresh = A.judge_tropes(pairs, cards, cache, texts, {"rings": "about rings"}, ask, lambda t, d, e: f"{t}|{d}|{e}", rules)
    got = {(r.novel_id, r.trope): (r.verdict, r.source) for r in told.collect()}
    assert len(got) == told.count() == 10
    assert {k[0]: v for k, v in got.items() if k[1] == "rings"} == {"a": ("yes", "card"), "b": ("yes", "text"), "c": ("no", "cache"), "d": ("unclear", "unparsed"), "e": ("no_text", "none")}
    assert {v for k, v in got.items() if k[1] == "odd"} == {("unknown_trope", "glossary")}
    assert [tuple(r) for r in fresh.collect()] == [("b", "rings", "yes", ["g"], "medium", "")]
    assert sorted(p.name for p in log.iterdir()) == ["rings_about rings_bad", "rings_about rings_good"]
    again, none = A.judge_tropes(pairs, cards, cache.unionByName(fresh), texts.where("novel_id = 'b'"), {"rings": "about rings"}, ask, lambda t, d, e: f"{t}|{d}|{e}", rules)
    assert {r.source for r in again.where("novel_id = 'b' and trope = 'rings'").collect()} == {"cache"} and none.count() == 0
