"""Chat formatting: tool calls and results linked by identifier, ordered, validated and written as canonical JSON.

A conversation is never gathered: calls and results meet by a hash join on conversation and identifier. Calls of one
message are ordered topologically where the message is parsed; a reference to another message's call must point to an
earlier turn, which a second join checks, so turn and rank together are a topological order of the conversation.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Tools by name with the schemas of their arguments. A user's turn of a plain dialogue counts as a call of ``reply``.
SCHEMAS: dict[str, dict] = {
    "reply": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False},
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "additionalProperties": False},
}

_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


#: Values nested deeper are not read as JSON, far below the depth at which the interpreter gives up.
MAX_DEPTH = 100


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def _finite(digits: str) -> float:
    value = float(digits)
    if math.isinf(value):
        raise ValueError("a number beyond what floats hold")
    return value


def too_deep(value) -> bool:
    """Is a value nested more than :data:`MAX_DEPTH` levels? Level by level, so without recursion."""
    level = [value]
    for _ in range(MAX_DEPTH + 1):
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
        if not level:
            return False
    return True


def read(text: str):
    """A JSON value by the letter of the standard: no NaN or infinities, of equal keys the last; none too deep, and no
    numbers beyond what floats hold."""
    try:
        value = json.loads(text, parse_constant=_no_number, parse_float=_finite)
    except RecursionError:
        raise ValueError("nested too deep") from None
    if too_deep(value):
        raise ValueError("nested too deep")
    return value


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and characters as they are, but for halves of surrogate pairs, which no encoding
    has: they are escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return text if text.isascii() else _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


_HALF = re.compile("[\ud800-\udfff]")


def shown(text: str | None) -> str | None:
    """A text that UTF-8 can hold: halves of surrogate pairs give way to their escapes."""
    return None if text is None else _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value: types, enumerations, required and unknown keys, lengths, bounds and items. It goes as
    deep as the schema and the value both do."""
    kinds = schema.get("type")
    if kinds and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not an allowed value")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list):
        out += [p for i, v in enumerate(value) for p in problems(v, schema.get("items", {}), f"{at}[{i}]")]
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: out of bounds")
    return out


def references(value) -> list[str]:
    """Identifiers that a value refers to: strings of the form ``$call:identifier`` anywhere in it."""
    if isinstance(value, str):
        return [value[6:]] if value.startswith("$call:") else []
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return [r for v in inner for r in references(v)]


def ranks(calls: list[dict]) -> list[int | None]:
    """Topological ranks of a message's calls among themselves, earlier place first; null in or behind a circle."""
    at = {c["id"]: i for i, c in reversed(list(enumerate(calls))) if c["id"] is not None}
    needs = [{at[r] for r in c["refs"] if r in at} for c in calls]
    out: list[int | None] = [None] * len(calls)
    done: set[int] = set()
    while len(done) < len(calls):
        ready = [i for i in range(len(calls)) if i not in done and needs[i] <= done]
        if not ready:
            break
        for i in ready:
            out[i] = len(done)
            done.add(i)
    return out


def parse(conv_id, turn, role: str | None, text: str | None, schemas: dict[str, dict], plain: bool) -> tuple[list[dict], list[dict]]:
    """Calls and results of one message.

    A message of role ``assistant`` that is a JSON object with ``tool_calls`` makes calls; one of role ``tool`` with
    ``tool_call_id`` is a result. With ``plain``, a user's text is a call of ``reply`` under ``conversation:turn`` and
    the assistant's text of the next turn its result. Anything else makes neither: null or empty texts, JSON that does not
    parse, holds NaN or an infinity, or is nested more than :data:`MAX_DEPTH` levels. Arguments given as text that is no
    such JSON stay text. Very long texts are read whole.
    """
    data = None
    if text and text.lstrip()[:1] == "{":
        try:
            data = read(text)
        except ValueError:
            data = None
    calls: list[dict] = []
    results: list[dict] = []
    if role == "assistant" and isinstance(data, dict) and isinstance(data.get("tool_calls"), list):
        for c in data["tool_calls"]:
            c = c if isinstance(c, dict) else {}
            arguments = c.get("arguments")
            if isinstance(arguments, str):
                try:
                    arguments = read(arguments)
                except ValueError:
                    pass
            name = lambda x: shown(x) if isinstance(x, str) else None
            calls.append({"id": name(c.get("id")), "name": name(c.get("name")), "value": arguments})
    elif role == "tool" and isinstance(data, dict) and isinstance(data.get("tool_call_id"), str):
        content = data.get("content")
        results.append({"id": shown(data["tool_call_id"]), "content": shown(content) if isinstance(content, str) else canonical(content)})
    elif plain and text and conv_id is not None and turn is not None:
        if role == "user":
            calls.append({"id": f"{conv_id}:{turn}", "name": "reply", "value": {"text": text}})
        elif role == "assistant":
            results.append({"id": f"{conv_id}:{turn - 1}", "content": text})
    for c in calls:
        c["refs"] = [shown(r) for r in references(c["value"])]
        c["problem"] = shown("; ".join(problems(c["value"], schemas[c["name"]]))) if c["name"] in schemas else "unknown tool"
        c["arguments"] = canonical(c.pop("value"))
    for c, r in zip(calls, ranks(calls)):
        c["rank"] = r
    return calls, results


def link(messages: DataFrame, schemas: dict[str, dict] | None = None, plain: bool = True) -> DataFrame:
    """One row per call and per result without a call.

    ``conv_id, turn, call_id, rank, name, status, problem, result_turn, message``; ``message`` is the canonical JSON of
    the call with its result. ``status`` is the first that holds of ``unidentified`` (no id or conversation),
    ``duplicate`` (an earlier call, or result, has the id), ``orphan`` (a result without call), ``circular``,
    ``forward`` (refers to a call that is not earlier, or to none), ``invalid``, ``unanswered``, ``early`` (the result
    stands before the call) and ``linked``. Earlier is by turn (null first), then place and content. Equal calls of equal
    place, which repeated rows give, are told apart by number: one is the first, the others duplicates, and so with results.
    Null and empty texts and an empty table give nothing; extra columns are not read, so their names do not matter.
    """
    schemas = SCHEMAS if schemas is None else schemas

    def fn(columns):
        for row in zip(*columns):
            yield parse(*row, schemas, plain)

    out = "calls array<struct<id:string,name:string,refs:array<string>,problem:string,arguments:string,rank:int>>, results array<struct<id:string,content:string>>"
    m = map_rows(messages, ["conv_id", "turn", "role", "text"], fn, out, keep=["conv_id", "turn"])
    calls = m.select("conv_id", "turn", F.posexplode("calls").alias("k", "c")).select("conv_id", "turn", "k", "c.*")
    results = m.select("conv_id", F.col("turn").alias("result_turn"), F.inline("results"))
    key = ["conv_id", "id"]
    named = F.col("conv_id").isNotNull() & F.col("id").isNotNull()

    # The first call and the first result of an identifier; the least is taken before the shuffle.
    place = F.struct("turn", "k", "arguments", "name")
    first = calls.where(named).groupBy(*key).agg(F.min(F.struct("turn", "k", "arguments", "name", "problem", "rank", "refs")).alias("c"), F.count("*").alias("n"))
    answer = results.where(named).groupBy(*key).agg(F.min(F.struct("result_turn", "content")).alias("r"), F.count("*").alias("m"))
    met = first.join(answer, key, "full_outer")
    # References must be to calls of the same conversation that stand earlier, by turn or by rank within the message.
    refs = first.select("conv_id", "id", F.col("c.turn").alias("turn"), F.col("c.rank").alias("rank"), F.explode("c.refs").alias("ref"))
    told = first.select("conv_id", F.col("id").alias("ref"), F.col("c.turn").alias("ref_turn"), F.col("c.rank").alias("ref_rank"))
    late = refs.join(told, ["conv_id", "ref"], "left")
    earlier = (F.col("ref_turn") < F.col("turn")) | ((F.col("ref_turn") == F.col("turn")) & (F.col("ref_rank") < F.col("rank")))
    wrong = late.where(~F.coalesce(earlier, F.lit(False))).select(*key, F.lit(True).alias("forward")).distinct()
    met = met.join(wrong, key, "left")
    status = (
        F.when(F.col("c").isNull(), "orphan").when(F.col("c.rank").isNull(), "circular").when(F.col("forward"), "forward").when(F.col("c.problem") != "", "invalid")
        .when(F.col("r").isNull(), "unanswered").when(F.col("r.result_turn") <= F.col("c.turn"), "early").otherwise("linked")
    )
    linked = met.select("conv_id", F.col("c.turn").alias("turn"), F.col("id").alias("call_id"), "c.rank", "c.name", status.alias("status"), "c.problem", "r.result_turn", "c.arguments", "r.content")
    # Later calls and results under the same identifier are told, and linked with nothing. Of rows equal to the first, all
    # but one are later.
    def later(rows: DataFrame, is_first) -> DataFrame:
        names = [c for c in rows.columns if c != "f"]
        counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("same")).withColumn("same", F.col("same") - is_first.cast("long"))
        return counted.where("same > 0").select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "same"))).drop("col")

    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    told = [F.col("id").alias("call_id"), "rank", "name"]
    again = later(calls.join(first.where("n > 1").select(*key, F.struct("c.turn", "c.k", "c.arguments", "c.name").alias("f")), key), place.eqNullSafe(F.col("f")))
    again = again.select("conv_id", "turn", *told, F.lit("duplicate").alias("status"), "problem", null("long", "result_turn"), "arguments", null("string", "content"))
    more = later(results.join(answer.where("m > 1").select(*key, F.col("r").alias("f")), key), F.struct("result_turn", "content").eqNullSafe(F.col("f")))
    more = more.select("conv_id", null("long", "turn"), F.col("id").alias("call_id"), null("int", "rank"), null("string", "name"), F.lit("duplicate").alias("status"), null("string", "problem"), "result_turn", null("string", "arguments"), "content")
    lost = calls.where(~named).select("conv_id", "turn", *told, F.lit("unidentified").alias("status"), "problem", null("long", "result_turn"), "arguments", null("string", "content"))
    rows = linked.unionByName(again).unionByName(more).unionByName(lost)

    def write(columns):
        for i, n, a, c in zip(*columns):
            # The arguments are canonical already, and their key sorts first.
            rest = canonical({"id": i, "name": n, "result": c})
            yield (f'{{"arguments":{"null" if a is None else a},{rest[1:]}',)

    done = map_rows(rows, ["call_id", "name", "arguments", "content"], write, "message string")
    return done.select("conv_id", "turn", "call_id", "rank", "name", "status", "problem", "result_turn", "message")


ORACLE_SQL = """
WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND text <> ''),
r AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND text <> ''),
j AS (SELECT c.conv_id AS cc, r.conv_id AS rc, c.turn AS ct, r.turn AS rt, c.text AS cx, r.text AS rx
      FROM c FULL OUTER JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn - 1)
SELECT coalesce(cc, rc) AS conv_id, ct AS turn, coalesce(cc, rc) || ':' || coalesce(ct, rt - 1) AS call_id,
       CASE WHEN cc IS NOT NULL THEN 0::INTEGER END AS rank, CASE WHEN cc IS NOT NULL THEN 'reply' END AS name,
       CASE WHEN cc IS NULL THEN 'orphan' WHEN rc IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       CASE WHEN cc IS NOT NULL THEN '' END AS problem, rt AS result_turn,
       '{"arguments":' || CASE WHEN cc IS NULL THEN 'null' ELSE '{"text":' || to_json(cx)::VARCHAR || '}' END
         || ',"id":"' || coalesce(cc, rc) || ':' || coalesce(ct, rt - 1) || '","name":' || CASE WHEN cc IS NULL THEN 'null' ELSE '"reply"' END
         || ',"result":' || CASE WHEN rc IS NULL THEN 'null' ELSE to_json(rx)::VARCHAR END || '}' AS message
FROM j
"""
