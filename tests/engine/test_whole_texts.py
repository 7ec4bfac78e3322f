"""Registered queries over whole texts, against their SQL."""

from __future__ import annotations

import pytest
from loomspark.plans import catalog

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", ["split_negatives", "tiered_evidence", "split_profiles"])
def test_whole_texts_equal_sql(spark, tmp_path, name):
    texts = [(1, "robot " * 30 + "travel " + "x" * 90), (2, "  short\n\ntext "), (3, "no term " * 40 + "school")]
    spark.createDataFrame([(i, t, "en", "web") for i, t in texts], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.ORACLE_SQL[name]).fetchall())
    if name == "split_negatives":
        by = {r.item_id: r.in_text for r in got}
        assert by[1].endswith("robot,travel,system,love") and by[3].startswith("school")
