"""Costly steps of a query are taken once for each row."""

from __future__ import annotations

from loomspark.functions import text as X
from loomspark.plans import catalog
from pyspark.sql import functions as F


def test_a_source_is_made_bare_once(spark):
    d = spark.createDataFrame([("one two three", "xx one, two! yy"), ("abc", "abc"), ("qwertyuiop", "nothing"), (None, "x")], "q string, s string")
    told = d.select(X.quote_supported("q", "s").alias("t"))
    assert [r.t for r in told.collect()] == [True, False, False, False]
    assert told._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(s") == 1


def test_answers_are_parsed_once(spark):
    plan = catalog.QUERIES["card_answers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
