"""Queries over ``documents`` for the text scalars, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import LATIN as L
from .base import query, table

WS = r"[ \t\n\r\f\v]"
STRIP = lambda e: f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"
NORM = lambda e: STRIP(
    f"regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(replace(replace({e}, chr(65279), ''), chr(0), ''), '\\r\\n?', chr(10), 'g'), chr(9), ' '), '[ \\x{{3000}}]{{2,}}', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
)
TERMS = {k: v for k, v in L.term_forms.items()}


def docs(spark, sf):
    return table(spark, sf, "documents")


@query(f"SELECT doc_id, md5({NORM('text')}) AS normalized FROM documents")
def normalize_whitespace(spark, sf):
    """TXT-01."""
    return docs(spark, sf).select("doc_id", F.md5(X.normalize_whitespace("text")).alias("normalized"))


@query(f"""
WITH a AS (SELECT doc_id, string_split({NORM('text')}, chr(10)) AS l FROM documents),
m AS (SELECT doc_id, l, len(l) AS n, [regexp_matches(l[i], CASE WHEN i <= {L.edge_lines} OR i > len(l) - {L.edge_lines} THEN '{L.boilerplate_edge}' ELSE '{L.boilerplate_inner}' END) FOR i IN range(1, len(l) + 1)] AS hit FROM a),
k AS (SELECT doc_id, n, hit, [l[i] FOR i IN range(1, n + 1) IF NOT (hit[i] OR (regexp_matches(l[i], '{L.ruler}') AND (
   (coalesce(hit[i - 1], false) AND i > 1 AND (i - 1 <= {L.edge_lines} OR i - 1 > n - {L.edge_lines})) OR (coalesce(hit[i + 1], false) AND (i + 1 <= {L.edge_lines} OR i + 1 > n - {L.edge_lines})))))] AS kept FROM m)
SELECT doc_id, md5({NORM("array_to_string([x FOR x IN string_split(array_to_string(kept, chr(10)), chr(10)) IF NOT regexp_matches(x, '" + L.ad_line + "')], chr(10))")}) AS cleaned,
       list_bool_or(hit) AS detected, (n - len(kept))::BIGINT AS removed,
       len([x FOR x IN string_split(regexp_replace(text_, '\\r\\n?', chr(10), 'g'), chr(10)) IF regexp_matches(x, '{L.boilerplate_edge}')]) > 0 AS contains_mark
FROM k JOIN (SELECT doc_id, text AS text_ FROM documents) USING (doc_id)
""")
def clean_text(spark, sf):
    """TXT-02 to TXT-07."""
    c = X.clean_text("text", L)
    return docs(spark, sf).withColumn("c", c).select(
        "doc_id", F.md5("c.text").alias("cleaned"), F.col("c.detected").alias("detected"), F.col("c.removed").cast("long").alias("removed"), X.contains_boilerplate("text", L).alias("contains_mark")
    )


@query("""
SELECT o_orderkey, CASE WHEN t = '' THEN stem ELSE t END AS title, author FROM (
  SELECT o_orderkey, stem, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '\\s*[bB][yY]\\s+[^_()\\[\\]]+', '', 'g'), '\\s*[tT][xX][tT]$', '', 'g'), '\\(\\s*\\)', '', 'g'), '\\s+', ' ', 'g'), '^[ _-]+|[ _-]+$', '', 'g') AS t,
         nullif(regexp_replace(regexp_extract(stem, '(?i)\\bby\\s+([^_()\\[\\]]+)', 1), '^[ _-]+|[ _-]+$', '', 'g'), '') AS author
  FROM (SELECT o_orderkey, '[' || o_orderpriority || '] ' || o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN ' by Clerk ' || o_custkey ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN '().txt' ELSE '' END AS stem FROM orders))
""")
def title_and_author(spark, sf):
    """TXT-08, TXT-09 over made-up file stems."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    stem = F.concat(F.lit("["), "o_orderpriority", F.lit("] "), "o_orderstatus", F.when(k % 3 == 0, F.concat(F.lit(" by Clerk "), "o_custkey")).otherwise(""), F.when(k % 2 == 0, "().txt").otherwise(""))
    return o.select("o_orderkey", stem.alias("s")).select("o_orderkey", X.title_from_stem("s").alias("title"), X.author_of("s").alias("author"))


@query(f"""
SELECT doc_id, len(list_distinct(list_concat(list_transform(regexp_extract_all(text, '{L.chapter_counts[0]}'), lambda x: trim(x)), list_transform(regexp_extract_all(text, '{L.chapter_counts[1]}'), lambda x: trim(x)))))::BIGINT AS chapters,
  md5({STRIP("regexp_replace(regexp_replace(replace(text, chr(0), ''), '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS compact FROM documents
""")
def chapter_count(spark, sf):
    """TXT-10, TXT-11."""
    return docs(spark, sf).select("doc_id", X.chapter_count("text", L).alias("chapters"), F.md5(X.compact_whitespace("text")).alias("compact"))


_MARK = "chr(10) || chr(10) || '[...]' || chr(10) || chr(10)"


@query(f"""
SELECT doc_id, md5(CASE WHEN length(t) <= 4500 THEN t ELSE {STRIP('substr(t, 1, 1500)')} || {_MARK} || {STRIP('substr(t, greatest(length(t) // 2 - 750, 0) + 1, 1500)')} || {_MARK} || {STRIP('right(t, 1500)')} END) AS sample
FROM (SELECT doc_id, {STRIP("regexp_replace(regexp_replace(replace(text, chr(0), ''), '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM documents)
""")
def sample_text(spark, sf):
    """TXT-12."""
    return docs(spark, sf).select("doc_id", F.md5(X.sample_text("text")).alias("sample"))


@query(f"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?m){L.chapter_heading}'), lambda x: trim(x)), '|') AS titles,
       substr({STRIP(f"string_split({STRIP('text')}, chr(10))[1]")}, 1, 60) AS heading FROM documents
""")
def chapter_titles(spark, sf):
    """TXT-14, TXT-27."""
    return docs(spark, sf).select("doc_id", F.array_join(X.chapter_titles("text", L), "|").alias("titles"), X.heading_of("text").alias("heading"))


def _trim(e: str, n: str) -> str:
    return f"(CASE WHEN length({e}) <= {n} THEN {e} WHEN length(regexp_extract(substr({e}, 1, {n}), '(?s)^(.*[.!?])', 1)) >= {n} // 2 + 2 THEN regexp_extract(substr({e}, 1, {n}), '(?s)^(.*[.!?])', 1) ELSE {STRIP(f'substr({e}, 1, {n})')} END)"


@query(f"SELECT doc_id, {_trim('t', '200')} AS short, md5({_trim('t', '600')}) AS longer FROM (SELECT doc_id, {STRIP('text')} AS t FROM documents)")
def trim_to_sentence(spark, sf):
    """TXT-16."""
    return docs(spark, sf).select("doc_id", X.trim_to_sentence("text", 200, L).alias("short"), F.md5(X.trim_to_sentence("text", 600, L)).alias("longer"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(right(text, 3000), 'in\\.$|en\\.$') THEN 'finished' ELSE 'unknown' END AS ending,
  md5(regexp_replace(substr(text, greatest(0, least(500, length(text) - 1))::INTEGER + 1, 300), '^\\s+|\\s+$', '', 'g')) AS slice,
  CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 75) || '[cut]' END AS shortened,
  sha256(text) AS sha256, length(text)::BIGINT AS length FROM documents
""")
def ending_and_cuts(spark, sf):
    """TXT-18, TXT-19, TXT-29, TXT-45."""
    r = X.fingerprint_redacted("text")
    return docs(spark, sf).select(
        "doc_id", X.ending_status("text", 3000, L).alias("ending"), F.md5(X.window_slice("text", F.lit(500), 300)).alias("slice"), X.truncate("text", 80, "[cut]").alias("shortened"), r["sha256"].alias("sha256"), r["length"].alias("length")
    )


_DENS = lambda f: f"CASE WHEN length(text) > 0 THEN (length(text) - length(replace(text, '{f}', '')))::DOUBLE / {len(f)} / length(text) * 100000.0 ELSE 0 END"


@query("SELECT doc_id, " + ", ".join(f"round({' + '.join(_DENS(f) for f in v)}, 6) AS d_{k}" for k, v in TERMS.items()) + " FROM documents")
def term_density(spark, sf):
    """TXT-20, TXT-21, AGG-25: one projection for all terms."""
    return docs(spark, sf).select("doc_id", *[F.round(X.merged_density("text", v), 6).alias(f"d_{k}") for k, v in TERMS.items()])


@query("""
SELECT p_partkey, lower(regexp_replace(p_name || ' [' || p_brand || ']', '[《》〈〉「」『』\\[\\]【】\\s_-]+', '', 'g')) AS normalized,
  regexp_replace('<' || p_name || '>', '[\\s《》〈〉<>「」『』]', '', 'g') AS key, regexp_replace(regexp_replace('<' || p_name || ' >', '^[《》〈〉<>]+|[《》〈〉<>]+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS peeled,
  regexp_replace(p_type, '\\s+', '', 'g') AS squashed, regexp_replace(p_brand || ', ' || p_type || '!', '[\\s，。！？、：；“”‘’"''（）()《》【】…—,.!?:;-]+', '', 'g') AS bare FROM part
""")
def titles(spark, sf):
    """TXT-22 to TXT-24, TXT-41, TXT-42."""
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", X.normalize_title(F.concat("p_name", F.lit(" ["), "p_brand", F.lit("]"))).alias("normalized"), X.title_key(F.concat(F.lit("<"), "p_name", F.lit(">"))).alias("key"), X.peel_title(F.concat(F.lit("<"), "p_name", F.lit(" >"))).alias("peeled"),
        X.squash("p_type").alias("squashed"), X.bare(F.concat("p_brand", F.lit(", "), "p_type", F.lit("!"))).alias("bare"),
    )


@query("""
SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents)
""")
def tokenize(spark, sf):
    """TXT-30."""
    return docs(spark, sf).select("doc_id", X.tokens("text").alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query("""
WITH RECURSIVE q AS (SELECT item_id, text, [x FOR x IN regexp_split_to_array(text, '[\\s,;/|]+') IF x <> ''] AS t FROM benchmark),
f AS (
  SELECT item_id, text, t, 0 AS i, []::VARCHAR[] AS pos, []::VARCHAR[] AS neg, false AS flag FROM q
  UNION ALL
  SELECT item_id, text, t, i + 1,
    CASE WHEN n IS NOT NULL OR flag THEN pos ELSE list_concat(pos, [x FOR x IN CASE WHEN ends_with(w, 'tion') AND length(w) > 4 THEN [substr(w, 1, length(w) - 4), 'tion'] ELSE [w] END IF x <> '' AND NOT list_contains(pos, x)]) END,
    CASE WHEN n <> '' THEN list_concat(neg, [x FOR x IN [n] IF NOT list_contains(neg, x)]) WHEN n IS NULL AND flag THEN list_concat(neg, [x FOR x IN [w] IF NOT list_contains(neg, x)]) ELSE neg END,
    coalesce(n = '', false)
  FROM (SELECT *, t[i + 1] AS w, CASE WHEN starts_with(t[i + 1], 'not') THEN substr(t[i + 1], 4) WHEN starts_with(t[i + 1], 'un') THEN substr(t[i + 1], 3) WHEN starts_with(t[i + 1], 'de') THEN substr(t[i + 1], 3) END AS n FROM f WHERE i < len(t))
)
SELECT item_id, md5(array_to_string(pos, ' ')) AS positive, array_to_string(neg, ' ') AS negative, len(t)::BIGINT AS n_terms,
       md5(CASE WHEN len(pos) = 0 THEN trim(text) ELSE array_to_string(pos, ' ') END) AS retrieval FROM f WHERE i = len(t)
""")
def query_parse(spark, sf):
    """TXT-31 to TXT-35, SET-04."""
    b = table(spark, sf, "benchmark").withColumn("p", X.parse_query("text", L))
    return b.select(
        "item_id", F.md5(F.array_join("p.positive", " ")).alias("positive"), F.array_join("p.negative", " ").alias("negative"), F.size(X.query_terms("text", L)).cast("long").alias("n_terms"), F.md5(X.retrieval_query("text", L)).alias("retrieval")
    )


@query("""
SELECT item_id, len(c)::BIGINT AS n_clauses, md5(array_to_string(c, '|')) AS clauses,
  array_to_string([x FOR x IN ['system', 'travel', 'school', 'love', 'robot'] IF contains(regexp_replace(array_to_string(c, chr(10)), 'boring|harem', ' ', 'g'), x)], ',') AS required
FROM (SELECT item_id, [x FOR x IN regexp_split_to_array(text, '[,.;!?\\n]+') IF regexp_matches(x, 'no |not |pas |nicht ')] AS c FROM benchmark)
""")
def negative_clauses(spark, sf):
    """TXT-36, TXT-37."""
    b = table(spark, sf, "benchmark").withColumn("c", X.negative_clauses("text", L))
    return b.select("item_id", F.size("c").cast("long").alias("n_clauses"), F.md5(F.array_join("c", "|")).alias("clauses"), F.array_join(X.required_negatives("text", L), ",").alias("required"))


@query("""
SELECT item_id, len(list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))))::BIGINT AS n_bigrams,
  md5(array_to_string(list_sort(list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)))), '')) AS bigrams,
  nullif(regexp_replace(regexp_extract('She said "' || text || '"', '["]([^"]{6,})["]', 1), '^\\s+|\\s+$', '', 'g'), '') AS quoted
FROM (SELECT item_id, text, regexp_replace(text, '[^a-z]', '', 'g') AS t FROM benchmark)
""")
def char_bigrams(spark, sf):
    """TXT-38, TXT-39."""
    b = table(spark, sf, "benchmark").withColumn("b", X.bigrams("text", "[^a-z]"))
    return b.select("item_id", F.size("b").cast("long").alias("n_bigrams"), F.md5(F.array_join(F.array_sort("b"), "")).alias("bigrams"), X.quoted_line(F.concat(F.lit('She said "'), "text", F.lit('"')), '""').alias("quoted"))


@query("""
WITH p AS (SELECT d.doc_id, regexp_replace(substr(d.text, 11, 40), '[\\s，。！？、：；“”‘’"''（）()《》【】…—,.!?:;-]+', '', 'g') AS q, regexp_replace(CASE WHEN d.doc_id % 2 = 0 THEN d.text ELSE n.text END, '[\\s，。！？、：；“”‘’"''（）()《》【】…—,.!?:;-]+', '', 'g') AS s
  FROM documents d JOIN documents n ON n.doc_id = (d.doc_id + 1) % (SELECT count(*) FROM documents))
SELECT doc_id, CASE WHEN length(q) < 4 THEN false WHEN contains(s, q) THEN true WHEN length(q) >= 8 THEN
  len([i FOR i IN range(1, length(q) - 4) IF contains(s, substr(q, i, 6))]) > 0 ELSE false END AS supported FROM p
""")
def quote_supported(spark, sf):
    """TXT-43: a quote against its own text, or the next one's."""
    d = docs(spark, sf)
    n = d.count()
    other = d.select(F.col("doc_id").alias("n_id"), F.col("text").alias("n_text"))
    j = d.join(other, F.col("n_id") == (F.col("doc_id") + 1) % n)
    return j.select("doc_id", X.quote_supported(F.substring("text", 11, 40), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("n_text"))).alias("supported"))
