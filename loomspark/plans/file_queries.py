"""Queries that write files of the tables' rows and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import supply as S
from ..sources import files as R
from ..sources import folders, sinks
from .agreement_queries import _LABELS, judged, sheet
from .base import TASK_ROWS, query, table
from .supply_queries import P, dealt, rows


@query("""WITH f AS (SELECT doc_id // 16 AS shelf, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS t FROM documents GROUP BY 1)
SELECT shelf::BIGINT AS shelf, 'ok' AS read_status, 'utf-8' AS detected_encoding, length(t) AS char_count, octet_length(encode(t))::BIGINT AS file_size_bytes, 0::BIGINT AS decode_replacement_chars, sha256(t) AS text_sha256 FROM f""")
def file_inventory(spark, sf):
    """SRC-01, SRC-02, SRC-07 to SRC-09, SRC-12, SRC-13: sixteen documents a text file; found, decoded, listed, and their texts read."""
    path, kept = folders.work_folder(spark), folders.work_folder(spark)
    docs = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 16).alias("shelf"), "doc_id", "text")
    docs.repartition("shelf").sortWithinPartitions("shelf", "doc_id").select("shelf", "text").write.partitionBy("shelf").text(path)
    found = R.discover(spark, path)
    told = ["read_status", "detected_encoding", "char_count", "file_size_bytes", "decode_replacement_chars"]
    R.inventory(found).select("novel_id", "relative_path", "absolute_path", *told).write.parquet(kept)
    listed = spark.read.parquet(kept)
    few = F.broadcast(listed) if listed.count() <= TASK_ROWS else listed  # then contents stay where they are read
    seen = R.texts(few, found).select("novel_id", F.sha2("text", 256).alias("text_sha256"))
    shelf = F.regexp_extract("relative_path", r"shelf=(\d+)", 1).cast("long")
    return listed.join(seen, "novel_id").select(shelf.alias("shelf"), *told, "text_sha256")


@query(f"WITH {P} SELECT query_id, config, rank, novel_id, title, kind, task_id, CASE WHEN novel_id % 2 = 0 THEN title END AS note FROM rows")
def pool_files(spark, sf):
    """SRC-24 to SRC-26: the queries and the rows of a pool as two JSON sinks, read back and joined."""
    path, kept = folders.work_folder(spark), folders.work_folder(spark)
    rows(spark, sf).drop("score").write.parquet(kept)  # both sinks are made of it
    r = spark.read.parquet(kept)
    hits = r.select("query_id", "config", "rank", "novel_id", "title", F.when(F.col("novel_id") % 2 == 0, F.col("title")).alias("note"))
    sinks.write_pool(hits, r.select("query_id", "kind", "task_id").distinct(), path)
    back = R.read_jsonl(spark, f"{path}/pool.jsonl", "query_id long, config string, rank long, novel_id long, title string, note string", required=("query_id", "novel_id"))
    return back.join(R.read_jsonl(spark, f"{path}/queries.jsonl", "query_id long, kind string, task_id long", required=("query_id",)), "query_id")


@query("SELECT doc_id, md5(text) AS from_csv, md5(text) AS from_lines, lang = 'en' AS tagged FROM documents")
def result_files(spark, sf):
    """SRC-28, SRC-29: whole texts, with line ends and quotes, as CSV with a byte order mark and as JSON lines; both read back."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.array("lang", F.coalesce("source", F.lit(""))).alias("tags"))
    csv, lines = sinks.write_results(d, folders.work_folder(spark))
    a = sinks.read_csv(spark, csv).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("from_csv"), F.from_json("tags", "array<string>").alias("tags"))
    b = R.read_jsonl(spark, lines, "doc_id long, text string", required=("doc_id",)).select("doc_id", F.md5("text").alias("from_lines"))
    return a.join(b, "doc_id").select("doc_id", "from_csv", "from_lines", (F.get("tags", F.lit(0)) == "en").alias("tagged"))


@query(f"""WITH {P}, {_LABELS}, g AS (SELECT *, max_n FROM (SELECT query_id, novel_id, label, broken = 'True' AS broken FROM j1 WHERE label IS NOT NULL), (SELECT count(*) AS max_n FROM hs JOIN j1 USING (query_id, novel_id) WHERE j1.label IS NOT NULL))
SELECT query_id, novel_id, coalesce(g.label, 0)::INTEGER AS relevance_label, coalesce(g.broken, false) AS constraint_violation, CASE WHEN g.label IS NULL THEN '' ELSE 'by judge, "' || g.label || '"' END AS notes, (SELECT count(*) FROM hs JOIN j1 USING (query_id, novel_id) WHERE j1.label IS NOT NULL) AS filled FROM hs LEFT JOIN g USING (query_id, novel_id)""")
def filled_sheet_file(spark, sf):
    """SRC-30, SRC-32, SRC-35, SRC-36: labels filled into a sheet that is written as CSV and read as judged files are."""
    from ..operators import agreement as G

    one = G.one_per(judged(spark, sf), ["query_id", "novel_id"], ["config", "rank"]).where("judge_relevance_label is not null")
    labels = one.select("query_id", "novel_id", F.col("judge_relevance_label").alias("relevance_label"), F.col("judge_constraint_violation").alias("constraint_violation"), F.concat(F.lit('by judge, "'), F.col("judge_relevance_label"), F.lit('"')).alias("notes"))
    path = folders.work_folder(spark)
    labels = S.spread(labels, dealt(spark, sf), "query_id", "novel_id")
    filled = sinks.write_filled_sheet(sheet(spark, sf), labels, path)
    back = R.manual_judgements(spark, path)
    return back.select(*[F.col(c).cast("long").alias(c) for c in ("query_id", "novel_id")], "relevance_label", "constraint_violation", "notes", F.lit(filled).cast("long").alias("filled"))


@query("SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS kind, o_totalprice AS price FROM orders")
def task_files(spark, sf):
    """SRC-27, SRC-33: tasks in two files, of which the later one's records count."""
    path = folders.work_folder(spark)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), "o_orderstatus", "o_orderpriority", F.col("o_totalprice").alias("price"))
    o.select("task_id", F.col("o_orderpriority").alias("kind"), "price").write.json(f"{path}/one")
    o.where("task_id % 3 = 0").select("task_id", F.col("o_orderstatus").alias("kind"), "price").write.json(f"{path}/two")
    return R.task_records([R.read_jsonl(spark, f"{path}/{x}", "task_id long, kind string, price double", required=("task_id",)) for x in ("one", "two")])
