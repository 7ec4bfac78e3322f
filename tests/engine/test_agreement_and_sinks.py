"""Labels side by side, and files for people."""

from __future__ import annotations

import csv
import json
from pathlib import Path

import pytest
from loomspark.operators import agreement as G
from loomspark.sources import files, sinks
from pyspark.sql import functions as F


def test_label_pairs(spark):
    human = spark.createDataFrame([("q", "a", "2", "yes"), ("q", "b", "", ""), ("q", "c", "1", "no"), ("q", "d", "9", "0"), ("r", "a", "1", "1")], "query_id string, novel_id string, relevance_label string, constraint_violation string")
    judged = spark.createDataFrame([("q", "a", "s2", 0, "True"), ("q", "a", "s1", 1, "False"), ("q", "c", "s1", None, None), ("q", "c", "s2", 1, "True"), ("q", "d", "s1", 2, None), ("q", "b", "s1", 1, "no")], "query_id string, novel_id string, system string, judge_relevance_label int, judge_constraint_violation string")
    got = {r.novel_id: r.asDict() for r in G.label_pairs(human, judged.repartition(5), ["system"]).collect()}
    # c goes: its first row has no label, and it is that row which counts
    assert set(got) == {"a", "d"}
    assert (got["a"]["judge_relevance_label"], got["a"]["judge_constraint_violation"], got["a"]["constraint_violation"]) == (1, False, True)
    assert (got["d"]["relevance_label"], got["d"]["judge_relevance_label"], got["d"]["judge_constraint_violation"]) == (2, 2, False)
    report = G.agreement_report(G.label_pairs(human, judged, ["system"])).first()
    assert report.paired_items == 2 and report.relevance_exact_agreement == 0.5


def test_verdicts_of_queries(spark):
    queries = spark.createDataFrame([("q", True, ["harem"]), ("r", False, ["harem"]), ("s", True, []), ("t", True, ["harem", "dark"]), ("u", True, ["dark"]), ("v", None, None)], "query_id string, constraint_checkable boolean, unwanted array<string>")
    rows = [(q, n, s, v) for q in "qrstuv" for n, s, v in (("a", 1, "True"), ("a", 2, "False"), ("b", 1, None), ("c", 1, ""))]
    results = spark.createDataFrame(rows, "query_id string, novel_id string, system int, judge_constraint_violation string").repartition(4)
    got = {(r.query_id, r.novel_id): r.judge for r in G.checkable_verdicts(results, queries, ["system"]).collect()}
    assert got == {(q, n): v for q in "qtu" for n, v in (("a", True), ("c", False))}
    labels = [tuple(r) for r in G.single_negative_labels(results, queries, ["harem"], ["system"]).orderBy("novel_id").collect()]
    assert labels == [("harem", "a", False)]  # the later verdict counts, a blank one is none


def test_kind_report(spark):
    rows = spark.createDataFrame([("x", "q", "a", 1, "card"), ("x", "q", "b", 2, ""), ("x", "q", "c", 3, "synopsis"), ("x", "q", "d", 4, "card"), ("y", "q", "c", 9, "card")], "config string, query_id string, novel_id string, rank int, section_kind string").withColumn("kind", F.lit("clash"))
    anchors = spark.createDataFrame([("q", "c")], "query_id string, anchor string")
    strong = spark.createDataFrame([("q", "a"), ("q", "a"), ("q", "d")], "query_id string, novel_id string")
    got = {tuple(r) for r in G.kind_report(rows, anchors, strong, 3, 5, F.col("novel_id") == F.col("anchor")).collect()}
    assert got == {("x", "anchor_hits_by_kind", "synopsis", 1), ("x", "strong_hits_by_kind", "card", 1), ("x", "top3_rows_by_kind", "card", 1), ("x", "top3_rows_by_kind", "synopsis", 1)}


TEXTS = ['plain', 'two\nlines, "quoted"', "", "back\\slash", "Größe 书"]


def test_results_as_csv_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([(i, t, ["a", t]) for i, t in enumerate(TEXTS)], "id long, text string, tags array<string>").coalesce(1)
    table, lines = sinks.write_results(rows, str(tmp_path))
    (part,) = Path(table).glob("part-*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,text,tags")
    with part.open(encoding="utf-8-sig", newline="") as f:  # another reader sees the same cells
        seen = list(csv.DictReader(f))
    assert [r["text"] for r in seen] == TEXTS and [json.loads(r["tags"])[1] for r in seen] == TEXTS
    back = sinks.read_csv(spark, table)
    assert back.columns == ["id", "text", "tags"] and [r.text or "" for r in back.orderBy(F.col("id").cast("int")).collect()] == TEXTS
    assert [r.text for r in files.read_jsonl(spark, lines, "id long, text string").orderBy("id").collect()] == TEXTS


def test_pool_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("q", "x", 1, "a", None)], "query_id string, config string, rank int, novel_id string, section_kind string")
    queries = spark.createDataFrame([("q", "text")], "query_id string, query string")
    for _ in range(2):  # the second pool takes the place of the first
        sinks.write_pool(rows, queries, str(tmp_path))
    assert [json.loads(x) for p in Path(tmp_path / "pool.jsonl").glob("part-*") for x in p.read_text().splitlines()] == [{"query_id": "q", "config": "x", "rank": 1, "novel_id": "a", "section_kind": None}]
    assert files.read_jsonl(spark, str(tmp_path / "queries.jsonl"), "query_id string, query string").count() == 1
    with pytest.raises(ValueError, match="novel_id"):
        sinks.write_pool(rows.drop("novel_id"), queries, str(tmp_path))


def test_filled_sheet(spark, tmp_path):
    sheet = spark.createDataFrame([("q", "a", "t1", "old", None), ("q", "b", "t2", "", "n"), (None, "c", "t3", "1", None)], "query_id string, novel_id string, title string, relevance_label string, notes string")
    labels = spark.createDataFrame([("q", "a", 2, True, 'he said "no",\nthen yes'), ("z", "a", 1, False, "")], "query_id string, novel_id string, relevance_label int, constraint_violation boolean, notes string")
    assert sinks.write_filled_sheet(sheet, labels, str(tmp_path / "sheet")) == 1
    back = {r.novel_id: r for r in files.manual_judgements(spark, str(tmp_path / "sheet")).collect()}
    assert (back["a"].relevance_label, back["a"].constraint_violation, back["a"].notes, back["a"].title) == (2, True, 'he said "no",\nthen yes', "t1")
    assert (back["b"].notes, back["c"].notes, back["c"].query_id) == ("", "", "")
    assert sinks.write_filled_sheet(sheet.limit(0), labels, str(tmp_path / "none")) == 0
