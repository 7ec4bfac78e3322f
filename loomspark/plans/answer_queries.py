"""Queries over answers of models, made of the tables' rows, and over cards parsed from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators.cards import Vocabulary
from .base import query, table

#: Answers to a judge: with reasoning before them, with the end of one, without an object, with values out of place.
JUDGED = """CASE p_partkey % 4
WHEN 0 THEN '<think>{"relevance_label": 9}</think>so {"relevance_label": ' || (p_size - 20) || ', "constraint_violation": "' || CASE p_size % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE '1' END || '", "reason": "' || p_name || '", "judge_confidence": "' || CASE p_size % 2 WHEN 0 THEN 'High' ELSE 'sure' END || '"} {"relevance_label": 1}'
WHEN 1 THEN 'lost {"relevance_label": 8}</think>{"relevance_label": "' || (p_size % 5) || '.7", "constraint_violation": true, "reason": ""}'
WHEN 2 THEN 'no object for ' || p_name
ELSE '{"relevance_label": "many", "constraint_violation": false, "reason": "' || repeat(p_name || ' ', 60) || '", "judge_confidence": "medium"}' END"""
_TAIL = "regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g')"
_FIRST = f"regexp_extract(CASE WHEN contains({_TAIL}, '</think>') THEN substr({_TAIL}, strpos({_TAIL}, '</think>') + 8) ELSE {_TAIL} END, '\\{{[^{{}}]*\\}}')"
_LABEL = lambda e: f"greatest(0, least(2, coalesce(trunc(try_cast({e} AS DOUBLE)), 0)))::INTEGER"
_SURE = "CASE WHEN lower(trim({0})) IN ('high', 'medium', 'low') THEN lower(trim({0})) ELSE 'low' END"


@query(f"""WITH a AS (SELECT p_partkey, {JUDGED} AS raw FROM part), o AS (SELECT p_partkey, {_FIRST} AS o FROM a)
SELECT p_partkey, o AS head, CASE WHEN o <> '' THEN {_LABEL("json_extract_string(o, '$.relevance_label')")} END AS relevance_label,
CASE WHEN o <> '' THEN lower(trim(json_extract_string(o, '$.constraint_violation'))) IN ('true', '1', 'yes', 'y') END AS violation,
CASE WHEN o <> '' THEN substr(json_extract_string(o, '$.reason'), 1, 400) END AS reason, CASE WHEN o <> '' THEN {_SURE.format("json_extract_string(o, '$.judge_confidence')")} END AS confidence FROM o""")
def judge_answers(spark, sf):
    """JSN-01, JSN-02, JSN-07."""
    raw = table(spark, sf, "part").select("p_partkey", F.expr(JUDGED).alias("raw"))
    v = F.col("v.value")
    rows = raw.select("p_partkey", A.first_objects("raw").alias("f"), A.judge_verdicts("raw").alias("v"))
    return rows.select("p_partkey", F.coalesce("f.value.head", F.lit("")).alias("head"), v["relevance_label"].alias("relevance_label"), v["constraint_violation"].alias("violation"), v["reason"].alias("reason"), v["judge_confidence"].alias("confidence"))


SUPPLIED = """CASE p_partkey % 4
WHEN 0 THEN 'so {"positive": ' || (p_size - 20) || ', "violations": {"red": "Yes", "blue": false, "ring": " 是 "}, "reason": "' || p_type || '"} done'
WHEN 1 THEN '{"positive": 1} or {"positive": 2}'
WHEN 2 THEN '{"positive": "' || (p_size % 4) || '", "violations": ["red"], "confidence": " HIGH"}'
ELSE '{"violations": {"' || split_part(p_name, ' ', 2) || '": 1}, "reason": ""}' END"""
_GREEDY = "regexp_extract(raw, '(?s)\\{.*\\}')"


@query(f"""WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS n, {SUPPLIED} AS raw FROM part), o AS (SELECT p_partkey, n, CASE WHEN json_valid({_GREEDY}) THEN {_GREEDY} END AS o FROM a)
SELECT p_partkey, greatest(0, least(2, coalesce(json_extract_string(o, '$.positive')::INTEGER, 0))) + CASE WHEN o IS NULL THEN NULL ELSE 0 END AS positive,
CASE WHEN o IS NOT NULL THEN array_to_string(list_sort(list_distinct([x FOR x IN n IF lower(trim(coalesce(json_extract_string(o, '$.violations.' || x), ''))) IN ('true', 'yes', '是', '1')])), ' ') END AS violated,
CASE WHEN o IS NOT NULL THEN {_SURE.format("coalesce(json_extract_string(o, '$.confidence'), 'low')")} END AS confidence, CASE WHEN o IS NOT NULL THEN coalesce(json_extract_string(o, '$.reason'), '') END AS reason FROM o""")
def supply_answers(spark, sf):
    """JSN-06."""
    raw = table(spark, sf, "part").select("p_partkey", A.supply_verdicts(F.expr(SUPPLIED), F.split("p_name", " ")).alias("v"))
    v = F.col("v.value")
    violated = F.array_join(F.array_sort(F.map_keys(F.map_filter(v["violations"], lambda _, said: said))), " ")
    return raw.select("p_partkey", v["positive"].alias("positive"), violated.alias("violated"), v["confidence"].alias("confidence"), v["reason"].alias("reason"))


ENDED = """CASE p_partkey % 4
WHEN 0 THEN '{"a": 1} then {"steps": {"n": ' || p_size || '}} {broken ' || p_name
WHEN 1 THEN '{"steps": {"n": ' || p_size || '}} <think>{"steps": {"n": 0}}</think> {' || p_name || '}'
WHEN 2 THEN p_name || ' } {'
ELSE '{"steps": {"n": 1}}{"steps": {"n": "' || p_name || '"}}' END"""


@query(f"""WITH a AS (SELECT p_partkey, {ENDED} AS raw FROM part)
SELECT p_partkey, list_filter(regexp_extract_all({_TAIL}, '\\{{(?:[^{{}}]|\\{{[^{{}}]*\\}})*\\}}'), lambda x: json_valid(x))[-1]->>'$.steps.n' AS n FROM a""")
def trailing_answers(spark, sf):
    """JSN-03: the last object that parses."""
    return table(spark, sf, "part").select("p_partkey", A.last_objects(F.expr(ENDED))["value"].alias("o")).select("p_partkey", F.get_json_object("o", "$.steps.n").alias("n"))


LISTED = """CASE p_partkey % 6
WHEN 0 THEN '[{"novel_id": "' || p_size || '"}, {"novel_id": "x"}]' WHEN 1 THEN '' WHEN 2 THEN p_name WHEN 3 THEN '[{"novel_id": "' || p_name || '"}, ' || p_size || ', "y"]' WHEN 4 THEN '{"novel_id": 1}' ELSE NULL END"""


@query(f"""WITH a AS (SELECT p_partkey, coalesce({LISTED}, '') AS raw FROM part), l AS (SELECT *, CASE WHEN json_valid(raw) AND json_type(raw) = 'ARRAY' THEN json_extract(raw, '$[*]') END AS l FROM a),
o AS (SELECT p_partkey, raw, l, [x FOR x IN l IF json_type(x) = 'OBJECT'] AS o FROM l)
SELECT p_partkey, raw <> '' AND (l IS NULL OR len(o) < len(l)) AS refused, CASE WHEN raw = '' THEN 0 WHEN len(o) = len(l) THEN len(o) END::INTEGER AS strict, coalesce(len(o), 0)::INTEGER AS lenient, o[1]->>'$.novel_id' AS first FROM o""")
def recommendation_answers(spark, sf):
    """JSN-04, JSN-05."""
    raw = table(spark, sf, "part").select("p_partkey", F.expr(LISTED).alias("raw"))
    rows = raw.select("p_partkey", A.recommendation_lists("raw").alias("s"), A.recommendation_lists("raw", strict=False).alias("l"))
    return rows.select("p_partkey", F.col("s.error").isNotNull().alias("refused"), F.size("s.value").alias("strict"), F.size("l.value").alias("lenient"), F.get_json_object(F.get("l.value", F.lit(0)), "$.novel_id").alias("first")).withColumn("strict", F.when(~F.col("refused"), F.col("strict")))


TROPES = """CASE p_partkey % 4
WHEN 0 THEN '{"verdict": " ' || CASE p_size % 2 WHEN 0 THEN 'YES' ELSE 'Unclear' END || '", "quotes": ["' || repeat(p_name || ' ', 30) || '", "b", "c", "d"], "confidence": "high"}'
WHEN 1 THEN '{"verdict": "no", "quotes": "' || p_name || '", "reason": "' || repeat(p_type, 80) || '"}' WHEN 2 THEN '{"verdict": "' || p_name || '"}' ELSE p_name END"""


@query(f"""WITH a AS (SELECT p_partkey, {TROPES} AS raw FROM part), o AS (SELECT p_partkey, CASE WHEN json_valid(raw) AND lower(trim(raw->>'$.verdict')) IN ('yes', 'no', 'unclear') THEN raw END AS o FROM a),
q AS (SELECT p_partkey, o, CASE WHEN json_type(o, '$.quotes') = 'ARRAY' THEN o->>'$.quotes[*]' WHEN o IS NOT NULL THEN [o->>'$.quotes'] END AS q FROM o)
SELECT p_partkey, lower(trim(o->>'$.verdict')) AS verdict, array_to_string([substr(x, 1, 120) FOR x IN q[1:3]], '|') AS quotes, CASE WHEN o IS NOT NULL THEN coalesce(o->>'$.confidence', 'low') END AS confidence,
CASE WHEN o IS NOT NULL THEN substr(coalesce(o->>'$.reason', ''), 1, 200) END AS reason, o IS NULL AS refused FROM q""")
def trope_answers(spark, sf):
    """JSN-15."""
    rows = table(spark, sf, "part").select("p_partkey", A.trope_verdicts(F.expr(TROPES)).alias("t"))
    v = F.col("t.value")
    return rows.select("p_partkey", v["verdict"].alias("verdict"), F.array_join(v["quotes"], "|").alias("quotes"), v["confidence"].alias("confidence"), v["reason"].alias("reason"), F.col("t.error").isNotNull().alias("refused"))


#: A small vocabulary for names of parts: what isn't in it is dropped from a card.
WORDS = Vocabulary(genres={"metal": ("ECONOMY", "SMALL"), "wood": ("LARGE",)}, elements=("red", "small", "ring", "bolt"), styles={"size": ("big", "little")}, subgenre_aliases={"MEDIUM": "LARGE"}, element_aliases={"tiny": "small"}, element_styles={"green": ("size", "big")}, element_groups={"all": {"red": "a colour", "ring": "a round thing"}}, unknown="other")
CARDS = """'{"subgenre": "' || p_type || '", "elements": {"' || split_part(p_name, ' ', 1) || '": "named ' || p_name || ' here", "things": [{"' || split_part(p_name, ' ', 2) || '": "' || CASE p_size % 3 WHEN 0 THEN 'not there' ELSE split_part(p_name, ' ', 2) || ' here' END || '"}]}, "style": {"size": "' || CASE p_size % 4 WHEN 0 THEN 'little' WHEN 1 THEN 'huge' ELSE '' END || '"}, "tone": "' || repeat(p_name, 5) || '"}'"""


@query("""WITH p AS (SELECT p_partkey, p_size, p_name, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, CASE WHEN p_type = 'MEDIUM' THEN 'LARGE' ELSE p_type END AS t FROM part),
c AS (SELECT *, CASE WHEN t IN ('ECONOMY', 'SMALL') THEN 'metal' WHEN t = 'LARGE' THEN 'wood' ELSE 'other' END AS genre, CASE WHEN t IN ('ECONOMY', 'SMALL', 'LARGE') THEN t ELSE '' END AS subgenre,
 w1 IN ('red', 'small', 'ring', 'bolt') AS e1, w2 IN ('red', 'small', 'ring', 'bolt') AS known, p_size % 3 > 0 AS borne FROM p)
SELECT p_partkey::VARCHAR AS novel_id, genre, subgenre, array_to_string(list_distinct_in_order, ' ') AS elements, coalesce(size, '') AS size, substr(repeat(p_name, 5), 1, 30) AS tone, dropped,
 '题材：' || genre || CASE WHEN subgenre <> '' THEN '·' || subgenre ELSE '' END || CASE WHEN len(list_distinct_in_order) > 0 THEN chr(10) || '元素：' || array_to_string(list_distinct_in_order, '、') ELSE '' END || CASE WHEN size <> '' THEN chr(10) || '风格：size ' || size ELSE '' END || chr(10) || '气质：' || substr(repeat(p_name, 5), 1, 30) AS card_text
FROM (SELECT *, [x FOR x IN [CASE WHEN e1 THEN w1 END, CASE WHEN known AND borne THEN w2 END] IF x IS NOT NULL] AS list_distinct_in_order,
 CASE WHEN p_size % 4 = 0 THEN 'little' WHEN p_size % 4 = 1 THEN '' WHEN w1 = 'green' OR w2 = 'green' THEN 'big' ELSE '' END AS size,
 array_to_string([x FOR x IN [CASE WHEN subgenre = '' THEN 'subgenre:' || t END, CASE WHEN NOT e1 AND w1 <> 'green' THEN 'element:' || w1 END, CASE WHEN NOT known AND w2 <> 'green' THEN 'element:' || w2 WHEN known AND NOT borne THEN 'element_unsupported:' || w2 || '=not there' END, CASE WHEN p_size % 4 = 1 THEN 'style:size=huge' END] IF x IS NOT NULL], ',') AS dropped FROM c)""")
def card_answers(spark, sf):
    """JSN-11 to JSN-13, JSN-16, SRC-22, SRC-23: cards parsed from answers with their books, made flat, and read back."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("novel_id"), F.expr(CARDS).alias("text"), F.concat(F.lit("a thing named "), "p_name", F.lit(" here and now")).alias("book"))
    flat = A.flat_cards(A.cards(p, WORDS, source="book"))
    rows = A.nested_cards(flat.withColumnRenamed("card_text", "kept")).withColumnRenamed("kept", "card_text")  # answers are parsed once
    return rows.select("novel_id", "genre", "subgenre", F.array_join("elements", " ").alias("elements"), F.element_at("style", F.lit("size")).alias("size"), "tone", F.array_join("dropped", ",").alias("dropped"), "card_text")
