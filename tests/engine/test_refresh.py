"""Only stale partitions of a derived table are rewritten."""

from __future__ import annotations

from loomspark.operators import refresh as R
from pyspark.sql import functions as F


def parse(rows):
    fields = F.from_json("raw", "genre string, pace string")
    return F.when(fields["genre"].isNotNull(), F.struct(fields["genre"].alias("genre"), F.contains("text", fields["genre"]).alias("supported")))


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def partitions(path):
    return {p.name: sorted((f.name, f.stat().st_mtime_ns) for f in p.glob("*.parquet")) for p in path.glob("bucket=*")}


def run(spark, rows, path, version="1"):
    raw = spark.createDataFrame(rows, "id int, raw string, text string")
    return R.reparse(raw, str(path), "id", "raw", parse, version, buckets=8)


def cards(spark, path):
    return {r.id: (r.card.genre, r.card.supported, r.version) for r in R.derived(spark, str(path), "id", "int", "struct<genre:string,supported:boolean>").collect()}


def test_refresh(spark, tmp_path):
    path = tmp_path / "cards"
    rows = [(i, f'{{"genre":"g{i}"}}', f"a g{i} book") for i in range(40)] + [(40, "not json", "t"), (41, None, "t"), (None, '{"genre":"x"}', "t")]
    n, touched = run(spark, rows, path)
    assert n == 40 and len(touched) == 8
    assert cards(spark, path) == {i: (f"g{i}", True, "1") for i in range(40)}

    before = files(path)
    assert run(spark, rows, path) == (0, [])
    assert files(path) == before  # nothing is rewritten

    # One new answer: its partition alone is written, and its other rows are as they were.
    before = partitions(path)
    changed = [(i, '{"genre":"new"}', t) if i == 5 else (i, r, t) for i, r, t in rows]
    n, touched = run(spark, changed, path)
    assert n == 1 and len(touched) == 1
    after = partitions(path)
    assert {p for p in after if after[p] != before[p]} == {f"bucket={touched[0]}"}
    want = {i: (f"g{i}", True, "1") for i in range(40)} | {5: ("new", False, "1")}
    assert cards(spark, path) == want

    # An answer that no longer parses keeps the card that is there.
    broken = [(i, "{", t) if i == 6 else (i, r, t) for i, r, t in changed]
    assert run(spark, broken, path) == (0, [])
    assert cards(spark, path) == want

    # A new version makes exactly the rows that have an answer stale.
    some = [x for x in changed if x[0] is not None and x[0] < 10]
    n, touched = run(spark, some, path, "2")
    assert n == 10
    assert cards(spark, path) == {i: (*v[:2], "2" if i < 10 else "1") for i, v in want.items()}
    # A new key joins.
    assert run(spark, [(99, '{"genre":"late"}', "late")], path, "2")[0] == 1
    assert cards(spark, path)[99] == ("late", True, "2")


def test_no_raw_answers(spark, tmp_path):
    assert run(spark, [(1, None, "t")], tmp_path / "c") == (0, [])
