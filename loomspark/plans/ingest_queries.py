"""Inventory, duplicates, hashes and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import ingest as I
from .base import query, table

SALT = "loom-2026"
UNIT = lambda e: f"(('0x' || substr({e}, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
FP = "sha256(regexp_replace(text, '\\s+', '', 'g'))"
INV = f"""inv AS (SELECT sha1(source || '/' || doc_id || '.txt') AS novel_id, source || '/' || lpad(doc_id::VARCHAR, 9, '0') AS relative_path, {FP} AS content_sha256,
  CASE WHEN doc_id % 50 = 7 THEN 'failed' ELSE 'ok' END AS read_status, lang || ' ' || (n_chars // 400) AS title_guess, CASE WHEN doc_id % 5 > 0 THEN source END AS author_guess, n_chars AS char_count FROM documents)"""
MARK = """can AS (SELECT content_sha256, arg_min(novel_id, relative_path) AS canonical FROM inv WHERE read_status = 'ok' GROUP BY 1),
mark AS (SELECT inv.*, read_status = 'ok' AND novel_id <> canonical AS is_duplicate, CASE WHEN read_status = 'ok' AND novel_id <> canonical THEN canonical END AS duplicate_of FROM inv JOIN can USING (content_sha256))"""
MARK = MARK.replace("FROM inv JOIN can", "FROM inv LEFT JOIN can").replace("read_status = 'ok' AND novel_id <> canonical AS", "coalesce(read_status = 'ok' AND novel_id <> canonical, false) AS")
NEAR = """best AS (SELECT title_guess, author_guess, arg_min(novel_id, (-char_count, relative_path)) AS bid, max(char_count) AS bc FROM mark WHERE read_status = 'ok' AND NOT is_duplicate AND author_guess IS NOT NULL GROUP BY 1, 2),
near AS (SELECT novel_id, bid AS near_duplicate_of FROM mark JOIN best USING (title_guess, author_guess) WHERE read_status = 'ok' AND NOT is_duplicate AND novel_id <> bid AND bc > 0 AND (bc - char_count) / bc <= 0.05)"""


def inventory(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        H.novel_id(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt"))).alias("novel_id"), F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("relative_path"),
        H.content_fingerprint("text").alias("content_sha256"), F.when(F.col("doc_id") % 50 == 7, "failed").otherwise("ok").alias("read_status"),
        F.concat("lang", F.lit(" "), F.floor(F.col("n_chars") / 400)).alias("title_guess"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("author_guess"), F.col("n_chars").alias("char_count"),
    )


@query(f"WITH {INV} SELECT novel_id, relative_path, content_sha256, {UNIT(f"sha256('{SALT}:' || content_sha256)")} AS bucket, {UNIT('sha1(novel_id)')} AS unit FROM inv")
def identifiers(spark, sf):
    """HSH-01 to HSH-03, HSH-07."""
    return inventory(spark, sf).select("novel_id", "relative_path", "content_sha256", H.split_bucket("content_sha256", SALT).alias("bucket"), H.stable_unit_float("novel_id").alias("unit"))


@query(f"WITH {INV}, {MARK} SELECT novel_id, is_duplicate, duplicate_of FROM mark")
def exact_duplicates(spark, sf):
    """WIN-02."""
    return I.mark_content_duplicates(inventory(spark, sf)).select("novel_id", "is_duplicate", "duplicate_of")


@query(f"WITH {INV}, {MARK}, {NEAR} SELECT * FROM near")
def near_duplicates(spark, sf):
    """WIN-03."""
    return I.near_duplicates(I.mark_content_duplicates(inventory(spark, sf)))


@query(f"""WITH {INV}, {MARK}, {NEAR}, j AS (SELECT mark.*, near_duplicate_of FROM mark LEFT JOIN near USING (novel_id))
SELECT count(*) AS rows, count(*) FILTER (is_duplicate) AS exact, count(near_duplicate_of) AS near, count(DISTINCT coalesce(near_duplicate_of, duplicate_of)) AS groups,
  (SELECT count(*) - count(DISTINCT title_guess) FROM j WHERE read_status = 'ok' AND NOT is_duplicate AND near_duplicate_of IS NULL) AS title_collisions FROM j""")
def duplicate_report(spark, sf):
    """AGG-17."""
    marked = I.mark_content_duplicates(inventory(spark, sf))
    return I.duplicate_report(marked, I.near_duplicates(marked))


@query(f"WITH {INV} SELECT read_status, count(*) AS files, sum(char_count)::BIGINT AS chars, round(avg(char_count), 4) AS mean_chars FROM inv GROUP BY 1")
def inventory_summary(spark, sf):
    """AGG-28."""
    return I.inventory_summary(inventory(spark, sf))


@query(f"WITH {INV}, {MARK} SELECT novel_id, CASE WHEN {UNIT(f"sha256('{SALT}:' || content_sha256)")} < 0.2 THEN 'eval' ELSE 'train' END AS fold FROM mark WHERE read_status = 'ok' AND NOT is_duplicate")
def fold_assign(spark, sf):
    """HSH-04 to HSH-06."""
    return H.build_splits(I.mark_content_duplicates(inventory(spark, sf)), 0.2, SALT).select("novel_id", "fold")


@query(f"WITH {INV}, {MARK} SELECT count(*) AS total, count(*) FILTER (read_status <> 'ok') AS unreadable, count(*) FILTER (read_status = 'ok' AND is_duplicate) AS duplicates, count(*) FILTER (read_status = 'ok' AND NOT is_duplicate) AS kept FROM mark")
def fold_report(spark, sf):
    """HSH-05."""
    return H.split_report(I.mark_content_duplicates(inventory(spark, sf)))


@query(f"""WITH {INV}, {MARK}, f AS (SELECT novel_id, char_count, CASE WHEN {UNIT(f"sha256('{SALT}:' || content_sha256)")} < 0.2 THEN 'eval' ELSE 'train' END AS fold FROM mark WHERE read_status = 'ok' AND NOT is_duplicate),
a AS (SELECT DISTINCT novel_id FROM inv WHERE char_count > 2000), b AS (SELECT DISTINCT novel_id FROM inv WHERE char_count < 3000)
SELECT 'overlap' AS what, count(*) AS n FROM a WHERE novel_id IN (FROM b) UNION ALL SELECT 'train_in_eval', count(*) FROM a WHERE novel_id IN (SELECT novel_id FROM f WHERE fold = 'eval')
UNION ALL SELECT 'eval_in_train', count(*) FROM b WHERE novel_id IN (SELECT novel_id FROM f WHERE fold = 'train')""")
def leakage_report(spark, sf):
    """HSH-19, FLT-15."""
    inv = inventory(spark, sf)
    folds = H.build_splits(I.mark_content_duplicates(inv), 0.2, SALT)
    return H.leakage_report(inv.where("char_count > 2000"), inv.where("char_count < 3000"), folds.select("novel_id", "fold"), "novel_id")


POOL = """pool AS (SELECT l_orderkey AS query_id, l_returnflag AS config, l_partkey AS novel_id, l_extendedprice AS score,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS rank FROM lineitem)"""


def pool(spark, sf, parts=None):
    """Candidate rows from line items, ranked within their query."""
    from pyspark.sql import Window

    from ..operators import supply as S

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag")
    li = S.spread(li, parts, "l_orderkey")
    return li.select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("config"), F.col("l_partkey").alias("novel_id"), F.col("l_extendedprice").alias("score"), F.row_number().over(w).cast("long").alias("rank"))


@query(f"""WITH {POOL}, once AS (SELECT query_id, novel_id, min(rank) AS rank FROM pool GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN rank BETWEEN 1 AND 3 THEN '1-3' WHEN rank BETWEEN 4 AND 10 THEN '4-10' ELSE 'other' END AS band, md5('7:' || query_id || ':' || novel_id) AS h FROM once),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, band ORDER BY h, novel_id) AS n FROM k)
SELECT query_id, novel_id, rank, band FROM n ORDER BY CASE WHEN n.n <= greatest(1, 200 // (SELECT count(*) FROM (SELECT DISTINCT query_id, band FROM k))) THEN 0 ELSE 1 END, h, query_id, novel_id LIMIT 200""")
def stratified_sample(spark, sf):
    """HSH-15, HSH-16: a sampling operator, so its size is the feature."""
    return H.stratified_sample(pool(spark, sf), "query_id", "novel_id", "rank", 200, "7")


@query("""WITH h AS (SELECT l.doc_id, quality, toxic, md5('7:' || l.doc_id) AS h FROM labels l),
t AS (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY h, doc_id) AS turn FROM h)
SELECT doc_id, quality, toxic, turn::INTEGER AS turn FROM t ORDER BY turn, quality, toxic, h LIMIT 100""")
def calibration_sample(spark, sf):
    """HSH-17."""
    return H.calibration_sample(table(spark, sf, "labels"), ["quality", "toxic"], ["doc_id"], 100, "7")


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 32, 1))::INTEGER % 2 = 0 THEN 'validate' ELSE 'heldout' END AS half FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 60")
def book_halves(spark, sf):
    """HSH-14, HSH-18."""
    d = table(spark, sf, "documents").select("doc_id")
    return H.sample_order(d, "doc_id", 60).select("doc_id", H.book_half(F.col("doc_id").cast("string")).alias("half"))


@query("WITH r AS (SELECT item_id, row_number() OVER (ORDER BY md5('0:' || item_id), item_id) AS n FROM benchmark) SELECT item_id, CASE WHEN n <= 10 THEN 'test' ELSE 'dev' END AS split FROM r WHERE n <= 25")
def assign_splits(spark, sf):
    """HSH-13, in hash order."""
    return H.assign_splits(table(spark, sf, "benchmark").select("item_id"), "item_id", 10, 15)


_F = H.judge_fractions(3, 10)


@query("SELECT doc_id, " + ", ".join(f"md5(regexp_replace(substr(text, least(floor(length(text) * {f}::DOUBLE)::BIGINT, greatest(length(text) - 200, 0)) + 1, 200), '^\\s+|\\s+$', '', 'g')) AS w{i}" for i, f in enumerate(_F)) + " FROM documents")
def judge_windows(spark, sf):
    """HSH-09, HSH-11, ARR-10."""
    return table(spark, sf, "documents").select("doc_id", *[F.md5(H.window_at("text", F.lit(f), 200)).alias(f"w{i}") for i, f in enumerate(_F)])


# Bands are so narrow that a fraction is near one of the three fixed points at most.
_U = lambda i: f"(({i + 0.15}::DOUBLE + {UNIT(f"sha1(doc_id || ':{i}')")} * 0.7::DOUBLE) / 7)"
_J = lambda i: f"round(CASE WHEN {_U(i)} < 0.08 THEN 0.12 WHEN abs({_U(i)} - 0.5) < 0.08 THEN 0.62 WHEN {_U(i)} > 0.92 THEN 0.97 ELSE {_U(i)} END, 4)"


@query("SELECT doc_id, " + ", ".join(f"{_J(i)} AS f{i}" for i in range(6)) + " FROM documents")
def judge_fractions(spark, sf):
    """HSH-10."""
    j = H.jittered(F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", *[j[i].alias(f"f{i}") for i in range(6)])


@query("SELECT title, doc_id FROM (SELECT lang || substr(text, 1, 12) AS title, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1) WHERE n = 1 AND length(title) >= 2")
def title_index(spark, sf):
    """WIN-06."""
    d = table(spark, sf, "documents").select("doc_id", F.concat("lang", F.substring("text", 1, 12)).alias("title"))
    return I.title_index(d, "title", "doc_id")


@query("""SELECT conv_id, turn, role, md5(text) AS text, dropped FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, greatest(count(*) OVER (PARTITION BY conv_id) - 3, 0) AS dropped FROM conversations) WHERE rn <= 3""")
def history_window(spark, sf):
    """WIN-08."""
    return I.last_turns(table(spark, sf, "conversations"), "conv_id", "turn", 3).withColumn("text", F.md5("text"))


@query("""SELECT conv_id, turn, role, md5(CASE WHEN role = 'assistant' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) > 2 THEN substr(text, 1, 40) || '...' ELSE text END) AS text FROM conversations""")
def compact_messages(spark, sf):
    """WIN-09, TOOL-16."""
    return I.compact_messages(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", "assistant", 2).withColumn("text", F.md5("text"))
