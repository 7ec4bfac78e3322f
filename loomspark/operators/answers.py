"""Answers of models as tables: raw text in, typed rows out. A row that does not parse keeps its place, with an error.

Text is parsed in Arrow batches, since no expression of the engine finds the first balanced object of a text; what stands
in the parsed rows is then plain columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions import jsons as J
from ..sources import folders
from .cards import Vocabulary, card_verdict


def _arrow_value(value, kind: DataType):
    """Maps as lists of pairs, which is how Arrow takes them."""
    if value is None:
        return None
    if isinstance(kind, MapType):
        return [(k, _arrow_value(v, kind.valueType)) for k, v in value.items()]
    if isinstance(kind, ArrayType):
        return [_arrow_value(v, kind.elementType) for v in value]
    if isinstance(kind, StructType):
        return {f.name: _arrow_value(value.get(f.name), f.dataType) for f in kind}
    return value


def parsed(fn: Callable, schema: str, *inputs: str | Column) -> Column:
    """``struct<value, error>`` of a function of one row's values. Its errors are told in the row and fail nothing; a null
    in the first input gives two nulls, without a call."""
    kind = DataType.fromDDL(f"struct<value:{schema},error:string>")
    arrow = to_arrow_type(kind)

    def one(first, *rest):
        if first is None:
            return {"value": None, "error": None}
        try:
            return {"value": _arrow_value(fn(first, *rest), kind["value"].dataType), "error": None}
        except (ValueError, TypeError, AttributeError, RecursionError) as e:
            return {"value": None, "error": f"{type(e).__name__}: {e}"[:300]}

    @F.arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([one(*values) for values in zip(*(c.to_pylist() for c in columns))], arrow)

    return run(*inputs)


def first_objects(text: str | Column) -> Column:
    """JSN-01, JSN-02: ``value`` holds the first balanced object as text, what follows it, and whether it parses."""

    def split(t: str) -> dict:
        head, rest = J.split_first_object(t)
        try:
            return {"head": head, "rest": rest, "parses": isinstance(json.loads(head), dict)}
        except ValueError:
            return {"head": head, "rest": rest, "parses": False}

    return parsed(split, "struct<head:string,rest:string,parses:boolean>", text)


def last_objects(text: str | Column) -> Column:
    """JSN-03: ``value`` is the last object that parses, as JSON text; null if there is none."""

    def last(t: str) -> str | None:
        found = J.last_object(t)
        return None if found is None else json.dumps(found, ensure_ascii=False)

    return parsed(last, "string", text)


def recommendation_lists(value: str | Column, strict: bool = True) -> Column:
    """JSN-04, JSN-05: the objects of a list that is given as JSON text, each as JSON text. If ``strict``, all that is no
    list of objects is an error; else only objects are taken. A null is an empty list."""

    def listed(v: str) -> list[str]:
        items, error = J.recommendations(v) if strict else (J.recommendations_or_none(v), None)
        if error:
            raise ValueError(error)
        return [json.dumps(x, ensure_ascii=False) for x in items]

    return parsed(listed, "array<string>", F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")))


def supply_verdicts(text: str | Column, negatives: str | Column) -> Column:
    """JSN-06: verdicts on a book of a pool; ``value`` is null where nothing was judged."""
    given = F.coalesce(F.col(negatives) if isinstance(negatives, str) else negatives, F.array().cast("array<string>"))
    return parsed(J.supply_verdict, "struct<positive:int,violations:map<string,boolean>,confidence:string,reason:string>", text, given)


def judge_verdicts(text: str | Column) -> Column:
    """JSN-07: verdicts on a result; ``value`` is null where nothing was judged, never a label of nought."""
    return parsed(J.judge_verdict, "struct<relevance_label:int,constraint_violation:boolean,reason:string,judge_confidence:string>", text)


_TROPE = "struct<verdict:string,quotes:array<string>,confidence:string,reason:string>"


def trope_verdicts(text: str | Column) -> Column:
    """JSN-15: ``value`` is null and ``error`` says why where there is no verdict."""
    return parsed(J.trope_verdict, _TROPE, text)


_CARD = f"struct<{', '.join(f.replace(' ', ':', 1) for f in J.CARD_SCHEMA.split(', '))}>"


def cards(answers: DataFrame, vocabulary: Vocabulary, novel_id: str = "novel_id", text: str = "text", source: str | None = None, model: str = "") -> DataFrame:
    """JSN-11, JSN-12: a card for each answer, and ``error`` where an answer holds none (its other fields are null then).

    With ``source``, a column of the book's text, quotes must stand in it; a null there counts as an empty text.
    """
    body = [F.coalesce(source, F.lit(""))] if source else []

    def card(t: str, key: str, book: str | None = None) -> dict:
        return J.parse_card(key, t, vocabulary, book, model)

    out = answers.select(F.col(novel_id).cast("string").alias("novel_id"), parsed(card, _CARD, F.coalesce(text, F.lit("")), F.col(novel_id).cast("string"), *body).alias("a"))
    return out.select("novel_id", *[F.col(f"a.value.{f.name}") for f in DataType.fromDDL(_CARD) if f.name != "novel_id"], F.col("a.error").alias("error"))


#: Fields that are stored as JSON text where a table must be flat.
LISTS = ("elements", "elements_unverified", "keywords", "dropped")
MAPS = ("style", "evidence")


#: Headings of a card's lines: fixed values, in this order.
LINES = (("elements", "元素："), ("elements_unverified", "疑似元素："), ("style", "风格："), ("protagonist", "主角："), ("setting", "背景："), ("tone", "气质："), ("keywords", "关键词："), ("one_liner", "一句话："))


def section_text(types: dict[str, str]) -> Column:
    """JSN-16: a card with nested fields as the text that is embedded: the genre with its sub-genre, then a line for each
    field that says something; options of a style follow their scale, and scales without an option are left out."""

    def said(c: str) -> Column:
        if c == "style":
            chosen = F.filter(F.map_entries(c), lambda e: F.coalesce(e["value"], F.lit("")) != "")
            return F.array_join(F.transform(chosen, lambda e: F.concat_ws(" ", e["key"], e["value"])), "；")
        return F.array_join(c, "、") if types[c].startswith("array") else F.col(c)

    sub = F.when(F.coalesce("subgenre", F.lit("")) != "", F.concat(F.lit("·"), "subgenre"))
    lines = [F.when(F.coalesce(said(c), F.lit("")) != "", F.concat(F.lit(heading), said(c))) for c, heading in LINES if c in types]
    return F.concat_ws("\n", F.concat(F.lit("题材："), F.coalesce("genre", F.lit("")), F.coalesce(sub, F.lit(""))), *lines)


def flat_cards(rows: DataFrame) -> DataFrame:
    """SRC-23: nested fields as JSON text, and the card's own text beside them. A null field is an empty one."""
    names = [c for c in rows.columns if c not in (*LISTS, *MAPS, "card_text")]
    empty = {**{c: "[]" for c in LISTS}, **{c: "{}" for c in MAPS}}
    nested = [F.coalesce(F.to_json(c), F.lit(empty[c])).alias(c) for c in (*LISTS, *MAPS) if c in rows.columns]
    return rows.select(*names, *nested, section_text(dict(rows.dtypes)).alias("card_text"))


def nested_cards(rows: DataFrame) -> DataFrame:
    """SRC-22: the fields of :func:`flat_cards` decoded, without the card's text. Fields that are nested already stay, and
    an empty or null one is empty."""
    kinds = {**{c: "array<string>" for c in LISTS}, **{c: "map<string,string>" for c in MAPS}}
    empty = {"array<string>": F.array().cast("array<string>"), "map<string,string>": F.create_map().cast("map<string,string>")}
    types = dict(rows.dtypes)

    def field(c: str) -> Column:
        if c not in kinds:
            return F.col(c)
        value = F.from_json(c, kinds[c]) if types[c] == "string" else F.col(c)
        return F.coalesce(value, empty[kinds[c]]).alias(c)

    return rows.select(*[field(c) for c in rows.columns if c != "card_text"])


def judge_tropes(pairs: DataFrame, card_rows: DataFrame, cache: DataFrame, evidence: DataFrame, definitions: dict[str, str], ask: Callable[[str], str], prompt: Callable[[str, str, str], str], rules: dict | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """UDF-13, TOOL-06: ``(verdicts, fresh)`` of ``(novel_id, trope)`` pairs.

    A trope without a definition is ``unknown_trope``; then the card's word counts, then the ``cache`` of
    ``(novel_id, trope, verdict, quotes, confidence, reason)``, and only the rest is asked of the model, on the book's
    ``evidence`` (``novel_id, evidence``). A book without evidence is ``no_text``. An answer that does not parse is
    ``unclear`` and is not in ``fresh``, the rows to add to the cache. Answers are written once to ``path``, so no call is
    made twice by what reads them later.
    """
    spark = pairs.sparkSession
    known = spark.createDataFrame(list(definitions.items()) or [("", "")], "trope string, definition string")  # a glossary
    asked = pairs.select("novel_id", "trope").distinct().join(F.broadcast(known), "trope", "left")
    by_card = None
    for t in definitions:
        v = card_verdict(t, rules)
        part = card_rows.select("novel_id", F.lit(t).alias("trope"), v["verdict"].alias("by_card")).where("by_card is not null")
        by_card = part if by_card is None else by_card.unionByName(part)
    asked = asked.join(by_card, ["novel_id", "trope"], "left") if by_card is not None else asked.withColumn("by_card", F.lit(None).cast("string"))
    stored = cache.select("novel_id", "trope", F.struct("verdict", "quotes", "confidence", "reason").alias("stored"))
    asked = asked.join(stored, ["novel_id", "trope"], "left")
    open_ = asked.where("definition is not null and by_card is null and stored is null").select("novel_id", "trope", "definition")
    ready = open_.join(evidence.select("novel_id", "evidence"), "novel_id").where("evidence <> ''")
    call = parsed(lambda e, t, d: ask(prompt(t, d, e)), "string", "evidence", "trope", "definition")
    target = path or folders.work_folder(spark)
    ready.select("novel_id", "trope", call["value"].alias("raw")).write.mode("errorifexists").parquet(target)
    told = spark.read.parquet(target).select("novel_id", "trope", trope_verdicts(F.coalesce("raw", F.lit("")))["value"].alias("told"), F.lit(True).alias("was_asked"))
    fresh = told.where("told is not null").select("novel_id", "trope", "told.*")
    rows = asked.join(told, ["novel_id", "trope"], "left")
    none = F.struct(F.lit("unclear").alias("verdict"), F.array().cast("array<string>").alias("quotes"), F.lit("low").alias("confidence"), F.lit("the answer does not parse").alias("reason"))
    best = F.coalesce("stored", "told", F.when(F.col("was_asked"), none))
    source = F.when(F.col("definition").isNull(), "glossary").when(F.col("by_card").isNotNull(), "card").when(F.col("stored").isNotNull(), "cache").when(F.col("told").isNotNull(), "text").when(F.col("was_asked"), "unparsed").otherwise("none")
    verdict = F.when(F.col("definition").isNull(), "unknown_trope").when(F.col("by_card").isNotNull(), F.col("by_card")).otherwise(F.coalesce(best["verdict"], F.lit("no_text")))
    own = ~source.isin("glossary", "card")
    return rows.select("novel_id", "trope", verdict.alias("verdict"), *[F.when(own, best[c]).alias(c) for c in ("quotes", "confidence", "reason")], source.alias("source")), fresh
