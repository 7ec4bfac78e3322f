"""Tables of a pool are dealt into parts by their rows."""

from __future__ import annotations

from loomspark.operators import supply as S
from pyspark.sql import functions as F


def test_parts_grow_with_rows(spark):
    from loomspark.plans import base

    few, many = spark.range(10), spark.range(base.TASK_ROWS * 9 + 1)
    assert base.parts_of(few) == 1 and base.parts_of(many) == 10
    assert "REPARTITION" not in S.spread(few, 1, "id")._jdf.queryExecution().toString().upper().replace("REPARTITIONBYEXPRESSION", "REPARTITION")
    assert S.spread(few, 10, "id").rdd.getNumPartitions() == 10


def test_anchor_ranks_need_one_join_and_keep_repeated_anchors(spark):
    rows = spark.createDataFrame([("a", 1, 2, "red ring"), ("a", 1, 1, "blue"), ("b", 1, 1, "blue"), (None, 1, 1, "red")], "config string, query_id int, rank long, title string")
    anchors = spark.createDataFrame([(1, "red"), (1, "red"), (2, "red")], "query_id int, anchor string")
    ranks = S.anchor_ranks(rows, anchors)
    assert sorted(map(str, ranks.collect())) == sorted(map(str, spark.createDataFrame([("a", 1, "red", 2), ("a", 1, "red", 2), ("b", 1, "red", None), ("b", 1, "red", None), (None, 1, "red", None), (None, 1, "red", None)], "config string, query_id int, anchor string, rank long").collect()))
    assert ranks._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    folds = spark.createDataFrame([("red", "x"), ("red", "y")], "anchor string, fold string")
    told = S.anchor_summary(ranks.where(F.col("config") == "a"), [1], folds).select("fold", "anchors").collect()
    assert sorted(map(tuple, told)) == [("*", 2), ("x", 2), ("y", 2)]
