"""Line dedup with the production rules: near copies at two edits."""

from __future__ import annotations

from functools import reduce

from helpers import documents
from loomspark.llm import lines
from pyspark.sql import functions as F


def test_two_changed_characters_make_a_near_copy(spark):
    first = "on page 17 of this book stands a sentence of some length"
    texts = [(1, first), (2, first.replace("17", "23") + "\nand something else that nobody wrote before"), (3, first.replace("17", "4568"))]
    rows = {r.doc_id: r for r in lines.dedup(documents(spark, texts)).collect()}
    assert rows[1].text == first and rows[2].text == "and something else that nobody wrote before" and rows[2].n_near == 1
    assert rows[3].text == texts[2][1] and rows[3].n_near == 0


def test_no_piece_of_a_sketch_is_shared_by_all_lines(spark):
    for tau in (1, 2, 3):
        k = 2 * tau + 1
        full = (1 << 5 * len(lines.SKETCH)) - 1
        got = spark.range(1).select(*[lines.piece(F.lit(full), F.lit(j), tau).alias(f"p{j}") for j in range(k)]).first()
        assert all(x > 0 for x in got) and reduce(lambda a, b: a | b, got) == full and sum(got) == full
