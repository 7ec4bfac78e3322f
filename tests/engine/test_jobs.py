from __future__ import annotations

import pytest
from loomspark.functions.lexicon import Lexicon
from loomspark.operators import jobs as J
from loomspark.sources import tables as ST
from pyspark.sql import functions as F

ZH = Lexicon()
BOOK = "\n".join(f"第{i + 1}章 题{i + 1}\n" + "这是正文。" * 80 for i in range(30))


def test_profiles(spark):
    inv = spark.createDataFrame([("a", "T", "A", 10, "ok", False), ("b", "U", None, 10, "ok", True), ("c", "V", None, 10, "failed", False)], "novel_id string, title_guess string, author_guess string, char_count long, read_status string, is_duplicate boolean")
    texts = spark.createDataFrame([("a", BOOK), ("b", BOOK), ("c", BOOK)], "novel_id string, text string")
    rows = J.build_profiles(inv, texts, ZH, 2000).collect()
    assert [r.novel_id for r in rows] == ["a"] and rows[0].profile_text.startswith("标题：T\n作者：A\n长度：约") and len(rows[0].profile_text) <= 2000
    assert len(J.excerpts(BOOK, ZH)) == 10 and len(J.excerpts("一句话。" * 2000, ZH)) == 10


def test_index_jobs(spark, tmp_path):
    rows = [("a", "blurb", 0, [1.0, 0.0]), ("a", "middle", 1, [0.0, 1.0]), ("b", "blurb", 0, [1.0, 0.0]), ("b", "middle", 1, [1.0, 0.0])]
    s = spark.createDataFrame(rows, "novel_id string, kind string, ordinal int, embedding array<float>")
    assert J.build_index(s, str(tmp_path / "multi")).count() == 4
    one = J.derive_single_index(spark, str(tmp_path / "multi"), str(tmp_path / "single"), {"blurb": 3.0})
    assert {r.novel_id: [round(x, 4) for x in r.embedding] for r in one.collect()} == {"a": [0.9487, 0.3162], "b": [1.0, 0.0]}
    assert set(J.searchers(spark, str(tmp_path))) == {"multi", "single"}
    with pytest.raises(ValueError):
        J.searchers(spark, str(tmp_path / "multi"))
    with pytest.raises(ValueError, match="one section"):
        J.build_index(s.where("ordinal = 0"), str(tmp_path / "x"))
    with pytest.raises(ValueError):
        J.vectors_in_order(s.limit(0), "ordinal")
    assert ST.load_index(spark, str(tmp_path / "multi")).columns == s.columns


def test_sheets_and_runs(spark):
    v = spark.createDataFrame([(f"q{i}", "n", i % 3, i % 2 == 0) for i in range(12)], "query_id string, novel_id string, positive int, violated boolean")
    pool = v.select("query_id", "novel_id").withColumn("title", F.lit("T"))
    sheet = J.calibration_sheet(v, pool, 6)
    assert sheet.count() == 6 and sheet.where("title = 'T' and label is null").count() == 6
    assert {(r.positive, r.violated) for r in sheet.drop("label").join(v, ["query_id", "novel_id"]).collect()} == {(a, b) for a in range(3) for b in (True, False)}
    filled = v.select("query_id", "novel_id", F.col("positive").alias("label"))
    assert J.score_sheet(filled, v).first().kappa == 1.0
    est = J.judging_estimate(spark.createDataFrame([("e" * 14, "q" * 14)], "e string, q string"), "e", "q", (1.0, 2.0)).first()
    assert est.prompt_tokens == 470 and est.cost == pytest.approx((470 + 120) / 1e6)


def test_bench_over_rankings(spark):
    docs = spark.createDataFrame([("a", "red dragon", "Red"), ("b", "blue sea", "Blue")], "novel_id string, text string, title string")
    q = spark.createDataFrame([("q", "dragon"), ("r", "nothing")], "query_id string, query string")
    ranks = J.build_pool(q, docs, 5).join(docs.select("novel_id", "title"), "novel_id").drop("config")
    anchors = spark.createDataFrame([("q", "red")], "query_id string, anchor string")
    m = J.run_bench({"one": ranks}, anchors, [1], 5).first()
    assert (m.config, m.anchors, m.hit_1, m.median_rank, m.unfound) == ("one", 1, 1.0, 1.0, 0)


def test_trope_sources(spark):
    c = spark.createDataFrame([("a", "G", "s", ["x"], {}), ("b", "G", "s", [], {})], "novel_id string, genre string, subgenre string, elements array<string>, style map<string,string>")
    cache = spark.createDataFrame([("b", "t", "no")], "novel_id string, trope string, verdict string")
    rows = {(r.novel_id, r.trope): (r.verdict, r.source) for r in J.check_trope(c, {"t": {"element": "x"}}, cache, ["t", "u"]).collect()}
    assert rows == {("a", "t"): ("yes", "card"), ("b", "t"): ("no", "cache"), ("a", "u"): (None, None), ("b", "u"): (None, None)}
    assert J.worker_count(99) == 32 and J.now().endswith("+00:00")


def test_entry_names_every_query_with_sql():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and "search_filtered_topk" in sql and len(queries) > 90


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["vec_id", "score", "rank"]
