"""Digests, chunks, evidence, state and JSON queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import LATIN as L
from ..operators import digest as D
from ..operators import state as M
from .base import query, table


def docs(spark, sf):
    return table(spark, sf, "documents")


_HEAD = L.chapter_heading.removeprefix("^").removesuffix("$")
_STRIP = lambda e: f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE {_STRIP('text')} <> ''),
h AS (SELECT *, regexp_full_match(line, '{_HEAD}') AS head FROM l),
c AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY n) AS chapter, bool_or(head) OVER (PARTITION BY doc_id) AS has FROM h)
SELECT doc_id, CASE WHEN has THEN chapter ELSE 1 END::INTEGER AS index, coalesce(max({_STRIP('line')}) FILTER (head), '') AS title,
  length({_STRIP("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head), '')")})::INTEGER AS n_chars
FROM c WHERE NOT has OR chapter > 0 GROUP BY doc_id, has, chapter""")
def chapters(spark, sf):
    """TXT-15, FLT-20, FLT-21."""
    return D.chapters_table(docs(spark, sf), "doc_id", "text", L).select("doc_id", "index", "title", F.char_length("body").alias("n_chars"))


@query()
def sections_exploded(spark, sf):
    """SRC-18, SRC-19, ARR-07 to ARR-09, ARR-15."""
    return D.digests(docs(spark, sf), "doc_id", "text", L).select("doc_id", "ending_status", F.posexplode("sections").alias("ordinal", "s")).select("doc_id", "ending_status", "ordinal", "s.kind", F.md5("s.text").alias("text"))


@query()
def chunked_sections(spark, sf):
    """ARR-01 to ARR-04, ARR-18."""
    d = D.digests(docs(spark, sf), "doc_id", "text", L)
    return D.section_table(d, "doc_id", 1500, L).select("doc_id", "kind", "ordinal", F.char_length("text").alias("n_chars"), F.md5("text").alias("text"))


@query("""WITH s AS (SELECT doc_id, 'body' AS kind, 0 AS ordinal, md5(text) AS text FROM documents UNION ALL SELECT doc_id, 'body', 1, md5(lang) FROM documents WHERE lang = 'en')
SELECT doc_id, kind, ordinal::INTEGER AS ordinal, text FROM s UNION ALL SELECT doc_id, 'card', (m + 1)::INTEGER, source FROM documents JOIN (SELECT doc_id, max(ordinal) AS m FROM s GROUP BY 1) USING (doc_id)""")
def append_cards(spark, sf):
    """ARR-05, VEC-08."""
    d = docs(spark, sf)
    s = d.select("doc_id", F.lit("body").alias("kind"), F.lit(0).alias("ordinal"), F.md5("text").alias("text")).unionByName(d.where("lang = 'en'").select("doc_id", F.lit("body").alias("kind"), F.lit(1).alias("ordinal"), F.md5("lang").alias("text")))
    return D.append_cards(s, d.select("doc_id", F.col("source").alias("card_text")), "doc_id")


@query("""WITH s AS (SELECT (doc_id % 50) AS book, lang AS kind, doc_id AS ordinal, text FROM documents), h AS (SELECT *, substr(regexp_replace(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[1], '\\s+$', ''), 1, 60) AS head FROM s)
SELECT book, kind, count(*) AS n, arg_min(head, ordinal) AS first, arg_max(head, ordinal) AS last FROM h GROUP BY 1, 2""")
def coverage(spark, sf):
    """ARR-19, VEC-25."""
    return D.coverage(docs(spark, sf).select((F.col("doc_id") % 50).alias("book"), F.col("lang").alias("kind"), F.col("doc_id").alias("ordinal"), "text"), "book")


@query()
def evidence_windows(spark, sf):
    """HSH-08, HSH-12, UDF-12, ARR-11."""
    return D.evidence(docs(spark, sf), "doc_id", "text", L).select("doc_id", F.char_length("evidence").alias("n_chars"), F.md5("evidence").alias("evidence"))


@query("SELECT doc_id, md5(source || chr(10) || chr(10) || text) AS t2, md5(source) AS t1 FROM documents")
def tiered_evidence(spark, sf):
    """UDF-10."""
    d = docs(spark, sf).select("doc_id", F.col("source").alias("card_text"), F.col("text").alias("blurb"), F.lit("").alias("evidence"))
    return d.select("doc_id", F.md5(D.tiered_evidence(2)).alias("t2"), F.md5(D.tiered_evidence(1)).alias("t1"))


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY 1, 2")
def labels_latest(spark, sf):
    """STR-01, STR-03, STR-05."""
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", F.round("value", 6).alias("value"))
    return M.latest(e, ["user_id", "event_type"], ["ts", "event_id"])


_LOG = "log AS (SELECT user_id AS owner, event_type AS kind, floor(value / 10)::INTEGER::VARCHAR AS value, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'forget' ELSE 'write' END AS action, event_id % 3 = 0 AS persistent FROM events)"
_MEM = "gone AS (SELECT owner, kind, value, max(seq) AS gone FROM log WHERE action = 'forget' GROUP BY 1, 2, 3), mem AS (SELECT owner, kind, value, max(seq) AS seq, arg_max(persistent, seq) AS persistent FROM log LEFT JOIN gone USING (owner, kind, value) WHERE action = 'write' AND (gone IS NULL OR seq > gone) GROUP BY 1, 2, 3)"


def memory(spark, sf):
    e = table(spark, sf, "events")
    log = e.select(F.col("user_id").alias("owner"), F.col("event_type").alias("kind"), F.floor(F.col("value") / 10).cast("int").cast("string").alias("value"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 == 0, "forget").otherwise("write").alias("action"), (F.col("event_id") % 3 == 0).alias("persistent"))
    return M.memory_latest(log)


@query(f"WITH {_LOG}, {_MEM} SELECT owner, kind, value, seq, persistent FROM mem")
def memory_latest(spark, sf):
    """STR-12, STR-13."""
    return memory(spark, sf).select("owner", "kind", "value", "seq", "persistent")


@query(f"WITH {_LOG}, {_MEM} SELECT owner, kind, value, seq FROM mem WHERE persistent AND kind IN (SELECT DISTINCT event_type FROM events WHERE event_type < 'm')")
def memory_saved(spark, sf):
    """STR-14, STR-15."""
    kinds = [r[0] for r in table(spark, sf, "events").where("event_type < 'm'").select("event_type").distinct().collect()]
    return M.persistent_only(memory(spark, sf), kinds).select("owner", "kind", "value", "seq")


@query(f"WITH {_LOG}, {_MEM} SELECT owner, kind, right(string_agg(value, ', ' ORDER BY seq, value), 40) AS summary FROM mem GROUP BY 1, 2")
def memory_summary(spark, sf):
    """STR-16."""
    return M.memory_summary(memory(spark, sf), 40)


@query(f"""WITH {_LOG}, {_MEM}, h AS (SELECT owner, string_agg(value, chr(10)) AS held FROM mem WHERE persistent GROUP BY 1), x AS (SELECT DISTINCT owner, o.ordinal, o.text, o.must FROM mem, (VALUES (0, '7', true), (1, '99', true), (2, '1', false)) o(ordinal, text, must)),
w AS (SELECT owner, ordinal, CASE WHEN must THEN 'missing' ELSE 'must_not_persist' END AS label, text FROM x LEFT JOIN h USING (owner) WHERE contains(coalesce(held, ''), text) <> must) SELECT owner, arg_min(label, ordinal) AS label, arg_min(text, ordinal) AS text FROM w GROUP BY 1""")
def memory_labels(spark, sf):
    """EVL-04."""
    m = memory(spark, sf)
    wish = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("text"), F.lit(b).alias("must")) for i, (t, b) in enumerate([("7", True), ("99", True), ("1", False)])])
    return M.memory_labels(m.select("owner").distinct().select("owner", F.inline(wish)), m)


_SES = "shown AS (SELECT user_id AS session, floor(value)::BIGINT AS item, event_id AS seq FROM events WHERE event_type = (SELECT min(event_type) FROM events)), excl AS (SELECT user_id AS session, floor(value)::BIGINT AS item, event_id AS seq FROM events WHERE event_type = (SELECT max(event_type) FROM events))"


def sessions(spark, sf):
    e = table(spark, sf, "events")
    low, high = e.agg(F.min("event_type"), F.max("event_type")).first()
    pick = lambda t: e.where(F.col("event_type") == t).select(F.col("user_id").alias("session"), F.floor("value").cast("long").alias("item"), F.col("event_id").alias("seq"))
    return pick(low), pick(high)


@query(f"WITH {_SES} SELECT session, item FROM shown UNION SELECT session, item FROM excl")
def session_avoid(spark, sf):
    """SET-02."""
    return M.session_avoid(*sessions(spark, sf))


@query(f"WITH {_SES} SELECT DISTINCT session, item FROM excl EXCEPT SELECT session, item FROM shown")
def newly_excluded(spark, sf):
    """SET-03, TOOL-07."""
    shown, excl = sessions(spark, sf)
    return M.newly_excluded(excl, shown)


@query(f"WITH {_SES}, l AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC, item DESC) AS b FROM shown), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq, item) AS n FROM l WHERE b <= 12) SELECT session, string_agg(n || '.' || item, ' ' ORDER BY n) AS summary FROM k GROUP BY 1")
def session_summary(spark, sf):
    """STR-18."""
    return M.session_summary(sessions(spark, sf)[0])


@query(f"WITH {_SES} SELECT session, item, min(seq) AS seq FROM shown GROUP BY 1, 2")
def first_shown(spark, sf):
    """STR-17, WIN-07."""
    return M.first_seen(sessions(spark, sf)[0], ["session", "item"], ["seq"])


@query("SELECT doc_id, 'v1|m|' || doc_id || '|' || lang AS key FROM documents")
def cache_keys(spark, sf):
    """STR-09, STR-10."""
    return docs(spark, sf).select("doc_id", M.cache_key(F.lit("v1"), F.lit("m"), F.col("doc_id").cast("string"), "lang").alias("key"))


@query("""WITH e AS (SELECT event_id, value, event_type, props FROM events) SELECT event_id, greatest(0, least(2, trunc(value)::INTEGER))::INTEGER AS label, lower(trim(event_type)) IN ('true', '1', 'yes', 'y', 'click', '是') AS truthy,
CASE WHEN lower(event_type) IN ('high', 'medium', 'low') THEN lower(event_type) ELSE 'low' END AS confidence FROM e""")
def coerce_values(spark, sf):
    """JSN-08 to JSN-10, SRC-30."""
    from ..functions import jsons as J

    return table(spark, sf, "events").select("event_id", J.clamp_label(F.col("value").cast("string")).alias("label"), J.coerce_bool("event_type", extra=("click", "是")).alias("truthy"), J.normalize_confidence("event_type").alias("confidence"))


@query("""WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a' || (1 + p_partkey % 3) WHEN 1 THEN 'genre_b:b1' WHEN 2 THEN 'a2(genre_a)' ELSE 'genre_a' END AS raw FROM part)
SELECT p_partkey, CASE WHEN raw IN ('a1', 'a2') THEN raw WHEN raw = 'genre_b:b1' THEN 'b1' WHEN raw = 'a2(genre_a)' THEN 'a2' ELSE '' END AS subgenre,
 CASE WHEN raw IN ('a1', 'a2', 'a2(genre_a)', 'genre_a') THEN 'genre_a' WHEN raw = 'genre_b:b1' THEN 'genre_b' ELSE 'other' END AS genre FROM v""")
def normalise_subgenre(spark, sf):
    """JSN-13, JSN-19."""
    from ..functions import jsons as J
    from ..operators.cards import Vocabulary

    v = Vocabulary(genres={"genre_a": ("a1", "a2"), "genre_b": ("b1",)}, subgenre_aliases={}, unknown="other")
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("a"), (1 + k % 3).cast("string"))).when(k % 4 == 1, "genre_b:b1").when(k % 4 == 2, "a2(genre_a)").otherwise("genre_a")
    s = J.normalise_subgenre("raw", v)
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", s["subgenre"].alias("subgenre"), s["genre"].alias("genre"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, len(list_distinct([x FOR x IN string_split(props, ',') IF trim(x) <> '']))::BIGINT AS parts FROM events")
def json_fields(spark, sf):
    """JSN-14."""
    from ..functions import jsons as J

    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(J.strings(F.split("props", ","), 1000, 1000)).cast("long").alias("parts"))


@query("SELECT conv_id, min(turn) AS created, max(turn) AS updated, count(*) AS turns FROM conversations WHERE role = 'user' GROUP BY 1")
def session_list(spark, sf):
    """SVC-03."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("role").alias("owner"), F.col("turn").alias("ts"))
    return M.sessions_of(c, "user").withColumnRenamed("session", "conv_id")


@query("SELECT doc_id, text AS blurb FROM documents WHERE length(text) >= 50 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def load_profiles(spark, sf):
    """SRC-15, SRC-17, FLT-15: required columns, short texts out, ids restricted."""
    from ..sources import tables as T

    return T.load_profiles(docs(spark, sf), "doc_id", "text", ids=table(spark, sf, "labels").where("quality = 1").select("doc_id")).select("doc_id", F.col("text").alias("blurb"))


@query("SELECT lang, CASE WHEN count(DISTINCT source) = 1 THEN max(source) END AS version, count(*) AS n, round(avg(length(text)), 4) AS mean_chars FROM documents GROUP BY 1")
def table_version(spark, sf):
    """SRC-43, AGG-29."""
    from ..sources import tables as T

    return docs(spark, sf).groupBy("lang").agg(T.single_version("source").alias("version"), F.count("*").alias("n"), F.round(F.avg(F.char_length("text")), 4).alias("mean_chars"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row, lang || ' ' || source AS title, substr(text, 1, 300) AS preview FROM documents")
def id_map(spark, sf):
    """VEC-26, VEC-27."""
    from ..sources import tables as T

    return T.id_map(docs(spark, sf).withColumn("title", F.concat_ws(" ", "lang", "source")), "doc_id", "title", "text").select("doc_id", "row", "title", "preview")


@query("SELECT item_id, quality, text FROM benchmark LEFT JOIN (SELECT doc_id AS item_id, max(quality) AS quality FROM labels GROUP BY 1) USING (item_id)")
def filled_sheet(spark, sf):
    """A sheet joined with labels; the file itself is `filled_sheet_file`."""
    lab = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("item_id")).agg(F.max("quality").alias("quality"))
    return table(spark, sf, "benchmark").join(lab, "item_id", "left").select("item_id", "quality", "text")


@query(f"""WITH b AS (SELECT doc_id, text, regexp_extract(substr(text, 1, 6000), '(?s)(?:(?m)^[ ]*(?:The|Die|Le|La) +)(.*)$', 1) AS x FROM documents),
c AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, regexp_replace(regexp_replace(x, '(?m)\\n{L.chapter_heading}[\\s\\S]*\\z', ''), '^\\s+|\\s+$', '', 'g') AS x FROM b)
SELECT doc_id, CASE WHEN length(x) <= 100 THEN x WHEN length(regexp_extract(substr(x, 1, 100), '(?s)^(.*[.!?])', 1)) >= 52 THEN regexp_extract(substr(x, 1, 100), '(?s)^(.*[.!?])', 1) ELSE regexp_replace(substr(x, 1, 100), '\\s+$', '') END AS blurb,
  CASE WHEN contains(t, 'the') THEN substr(concat_ws(chr(10), [l FOR l IN string_split(split_part(t, 'the', 1), chr(10)) IF starts_with(l, 'A')][1],
    regexp_replace(split_part(substr(t, strpos(t, 'the') + 3), chr(10) || chr(10), 1), '^\\s+|\\s+$', '', 'g')), 1, 80) ELSE substr(t, 1, 80) END AS preview FROM c""")
def blurbs(spark, sf):
    """TXT-17, TXT-28."""
    from ..functions import text as X

    return docs(spark, sf).select("doc_id", X.blurb("text", 100, 6000, L).alias("blurb"), X.synopsis_preview("text", 80, "the", "\n\n", "A").alias("preview"))


@query("""WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w, lower(p_type) AS t FROM part) SELECT p_partkey, len([x FOR x IN w IF contains(x, substr(t, 1, 2)) OR contains(substr(t, 1, 2), x)]) > 0 AS covered FROM t""")
def covered_terms(spark, sf):
    """FLT-23, FLT-24."""
    from ..operators import supply as P

    return table(spark, sf, "part").select("p_partkey", P.covers(F.split("p_name", " "), F.substring(F.lower("p_type"), 1, 2)).alias("covered"))


@query("""WITH t AS (SELECT doc_id, [x FOR x IN [regexp_replace(y, '^\\s+|\\s+$', '', 'g') FOR y IN string_split(replace(text, chr(10), ' / '), ' / ')] IF x <> ''] AS t FROM documents)
SELECT doc_id, t[1] AS first, len(t)::BIGINT AS n, md5(array_to_string(t, '|')) AS titles FROM t""")
def sampled_titles(spark, sf):
    """ARR-16: the titles section split back."""
    listed = F.concat(F.lit("titles\n"), F.replace("text", F.lit("\n"), F.lit(" / ")))
    s = docs(spark, sf).select("doc_id", D.sampled_titles(F.array(F.struct(F.lit("titles").alias("kind"), listed.alias("text")))).alias("t"))
    return s.select("doc_id", F.get("t", F.lit(0)).alias("first"), F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|")).alias("titles"))


@query("""WITH p AS (SELECT doc_id, '标题：' || source AS head, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, lang FROM documents)
SELECT doc_id, 0 AS ordinal, 'blurb' AS kind, md5(head) AS text FROM p UNION ALL SELECT doc_id, 1, 'excerpt', md5(head || chr(10) || flat) FROM p UNION ALL SELECT doc_id, 2, 'excerpt', md5(head || chr(10) || lang) FROM p""")
def split_profiles(spark, sf):
    """ARR-06: profiles split at their marks."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    d = docs(spark, sf).select("doc_id", F.concat(F.lit("标题："), "source", F.lit("\n\n正文节选：\n节选1：\n"), flat, F.lit("\n\n节选2：\n"), "lang").alias("p"))
    rows = D.over_texts(d, ["doc_id"], "p", lambda k, t: [(i, *s) for i, s in enumerate(D.split_profile(t))], "ordinal int, kind string, text string")
    return rows.select("doc_id", "ordinal", "kind", F.md5("text").alias("text"))


@query("""WITH s AS (SELECT doc_id % 50 AS book, doc_id, CASE lang WHEN 'en' THEN 'opening' WHEN 'de' THEN 'middle' WHEN 'fr' THEN 'titles' ELSE 'blurb' END AS kind,
  substr(regexp_replace(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[1], '\\s+$', ''), 1, 60) AS head FROM documents),
k AS (SELECT book, kind, list(head ORDER BY doc_id) AS h FROM s GROUP BY 1, 2),
p AS (SELECT book, CASE kind WHEN 'opening' THEN 0 WHEN 'middle' THEN 1 WHEN 'titles' THEN 2 ELSE 3 END AS place, CASE kind WHEN 'titles' THEN '章节目录' WHEN 'blurb' THEN '简介' ELSE
  CASE kind WHEN 'opening' THEN '开头章节 ' ELSE '中段章节 ' END || len(h) || ' 章（' || h[1] || CASE WHEN len(h) > 1 THEN '…' || h[-1] ELSE '' END || '）' END AS part FROM k)
SELECT book, string_agg(part, '、' ORDER BY place) AS coverage FROM p GROUP BY 1""")
def coverage_lines(spark, sf):
    """ARR-19, VEC-25: the line that tells what was searched."""
    kind = F.when(F.col("lang") == "en", "opening").when(F.col("lang") == "de", "middle").when(F.col("lang") == "fr", "titles").otherwise("blurb")
    # Headings are gathered, not texts; a mark after one of full length keeps a blank at its end.
    head = X.heading_of("text")
    text = F.when(F.char_length(head) == 60, F.concat(head, F.lit("."))).otherwise(head)
    s = docs(spark, sf).select((F.col("doc_id") % 50).alias("book"), F.struct("doc_id", kind.alias("kind"), text.alias("text")).alias("s"))
    return s.groupBy("book").agg(F.array_sort(F.collect_list("s")).alias("s")).select("book", D.coverage_text("s").alias("coverage"))


@query("SELECT c.c_custkey AS task_id, o_orderkey AS session, 'p' || (row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1) AS positive FROM customer c JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) <= 3")
def session_positives(spark, sf):
    """JON-07: the n-th order of a customer goes with the n-th positive."""
    from ..operators import trajectories as R

    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("task_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    tasks = o.select("task_id", "keys", F.transform("keys", lambda k: F.lit("request")).alias("sessions"), F.array(F.lit("p0"), F.lit("p1"), F.lit("p2")).alias("positives"))
    pairs = R.session_positives(tasks).join(tasks.select("task_id", "keys"), "task_id")
    return pairs.select("task_id", F.get("keys", F.col("session")).alias("session"), "positive")


@query("SELECT item_id || '~' || row_number() OVER (PARTITION BY item_id ORDER BY conv_id, turn) AS query_id, md5(c.text) AS query FROM conversations c JOIN benchmark ON item_id = conv_id % 60 WHERE role = 'user' AND trim(c.text) <> ''")
def rewritten_queries(spark, sf):
    """JON-04."""
    from ..operators import trajectories as R

    c = table(spark, sf, "conversations").where("role = 'user'")
    rw = c.select((F.col("conv_id") % 60).cast("string").alias("task_id"), F.struct("conv_id", "turn").alias("ordinal"), F.col("text").alias("query"), F.lit(None).cast("string").alias("variant"))
    return R.rewritten_queries(rw, table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("task_id"))).select("query_id", F.md5("query").alias("query"))


@query("SELECT l_orderkey AS task_id FROM (SELECT l_orderkey, CASE WHEN p_size >= 40 THEN true WHEN p_size <= 10 THEN false END AS v FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1 HAVING bool_or(v) AND bool_or(NOT v)")
def precheck_pool(spark, sf):
    """GEN-06."""
    from ..operators import trajectories as R

    p = table(spark, sf, "part").select(F.col("p_partkey").alias("novel_id"), F.when(F.col("p_size") >= 40, True).when(F.col("p_size") <= 10, False).alias("violation"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("novel_id"), F.lit(1).alias("rank"))
    return R.precheck(li, p)


@query("SELECT p_partkey::VARCHAR AS query_id, p_name AS query, array_to_string(string_split(p_name, ' '), ' ') AS positives FROM part")
def task_queries(spark, sf):
    """EVL-15, EVL-16."""
    from ..operators import trajectories as R

    p = table(spark, sf, "part")
    q = R.task_queries(p.select(F.col("p_partkey").cast("string").alias("task_id"), F.split("p_name", " ").alias("positives")))
    old = R.legacy_queries(p.select(F.col("p_partkey").cast("string").alias("query_id"), F.col("p_name").alias("query"), F.split("p_name", " ").alias("positives")), L)
    return q.join(old.select("query_id", F.array_join("positives", " ").alias("positives")), "query_id")


@query("""SELECT p_partkey AS novel_id, to_json(string_split(p_name, ' '))::VARCHAR AS elements, p_type AS genre, md5(d.text) AS opening FROM part LEFT JOIN documents d ON d.doc_id = p_partkey""")
def profiles(spark, sf):
    """JSN-17: cards with a JSON field beside the openings of their books."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("novel_id"), F.to_json(F.split("p_name", " ")).alias("elements"), F.col("p_type").alias("genre"))
    return p.join(docs(spark, sf).select(F.col("doc_id").alias("novel_id"), F.md5("text").alias("opening")), "novel_id", "left")


@query("""WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, greatest(1, floor(n * 0.95))::INTEGER AS usable FROM n),
h AS (SELECT doc_id, usable, least(4, usable) AS head, least(10, usable) - least(4, usable) AS rest FROM u)
SELECT doc_id, unnest(CASE WHEN usable - head <= rest THEN range(0, usable)::INTEGER[] ELSE list_sort(list_distinct(list_concat([0, 1, 2, 3], [round_even(head + k * ((usable - 1 - head)::DOUBLE / rest), 0)::INTEGER FOR k IN range(1, rest + 1)]))) END) AS idx FROM h""")
def profile_indices(spark, sf):
    """ARR-12: the places that a profile samples, of every document's lines."""
    d = docs(spark, sf).where("text is not null").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    return d.select("doc_id", F.explode(D.profile_places("n")).alias("idx"))


@query("""WITH s AS (SELECT conv_id::VARCHAR AS task_id, 'b' || (conv_id % 30) AS found, 'b' || ((conv_id + turn) % 30) AS given, (conv_id + turn) % 30 < 5 AS violation FROM conversations WHERE role = 'user'),
l AS (SELECT task_id, CASE WHEN given <> found THEN 'ungrounded' END AS label FROM s UNION ALL SELECT task_id, CASE WHEN violation THEN 'violation' END FROM s UNION ALL SELECT task_id, 'unchecked' FROM s)
SELECT task_id, count(label) = 0 AS passed, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels FROM l GROUP BY 1""")
def trajectories(spark, sf):
    """JON-05, JON-06, EVL-01, EVL-03, EVL-07 to EVL-10, SET-05 to SET-10: conversations as trajectories, scored by task."""
    from ..operators import trajectories as R

    c = table(spark, sf, "conversations")
    hits = F.to_json(F.array(F.struct(F.concat(F.lit("b"), (F.col("conv_id") % 30).cast("string")).alias("novel_id"), F.lit("t").alias("title"))))
    obs = F.array(F.struct(F.lit("search_books").alias("tool"), F.create_map(F.lit("query"), F.substring("text", 1, 20)).alias("arguments"), hits.alias("result"), F.lit(None).cast("string").alias("error")))
    rec = F.array(F.struct(F.concat(F.lit("b"), ((F.col("conv_id") + F.col("turn")) % 30).cast("string")).alias("novel_id"), F.lit("t").alias("title")))
    tr = c.where("role = 'user'").select(F.col("conv_id").cast("string").alias("task_id"), F.col("turn").cast("int").alias("session"), F.array(F.struct(obs.alias("observations"))).alias("steps"), rec.alias("recommendations"), F.col("text").alias("final_answer"))
    v = spark.range(30).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("novel_id"), F.when(F.col("id") < 5, True).when(F.col("id") < 20, False).alias("violation"))
    return R.score_tasks(R.score_sessions(tr, v)).select("task_id", "passed", F.array_join("labels", ",").alias("labels"))
