"""Line dedup in any script: sketches, and how many candidates lines with a common half leave."""

from __future__ import annotations

import random

import pytest
from helpers import documents
from loomspark.llm import lines
from loomspark.llm.common import saved
from pyspark.sql import functions as F
from test_global_operators import distance, edited

ALPHABETS = {"han": [chr(c) for c in range(0x4E00, 0x4E00 + 3000)], "cyrillic": [chr(c) for c in range(0x430, 0x450)], "digits": list("0123456789"), "latin": list("abcdefghijklmnopqrstuvwxyz")}


@pytest.mark.parametrize("script", ALPHABETS)
def test_sketches_never_tell_near_lines_apart(spark, script):
    r = random.Random(4)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice(ALPHABETS[script]) for _ in range(r.choice((24, 31, 32, 33, 64, 100))))
        pairs.append((a, edited(a, r.randint(0, 2), r)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", lines.counts_near(lines.sketch("a"), lines.sketch("b"), 2).alias("near"), F.size(lines.sketch("a")).alias("n")).collect()
    assert all(x.near for x in got if distance(x.a, x.b) <= 2) and all(x.n == 1 + (len(x.a) - 1) // 32 for x in got)


@pytest.mark.parametrize("script", ALPHABETS)
def test_candidates_of_lines_with_a_common_half_stay_few(spark, script):
    r = random.Random(5)
    half = "".join(r.choice(ALPHABETS[script]) for _ in range(30))
    texts = [(i, half + "".join(r.choice(ALPHABETS[script]) for _ in range(30))) for i in range(400)]
    rules = lines.LineRules()
    occ = lines.occurrences(documents(spark, texts).select(F.col("doc_id").alias("d0"), F.col("text").alias("x")), "d0", "x", rules)
    met = saved(lines.met_entries(saved(lines.keyed(occ, rules)), rules))
    sketches = occ.select(lines.line_id(F.col("h")).alias("id"), lines.sketch("line").alias("s"))
    assert met.select(lines.line_id(F.col("v"))).distinct().count() == 400
    assert lines.near_pairs(met, saved(sketches), rules).count() < 800  # of 79,800


def test_near_copies_in_han(spark):
    r = random.Random(6)
    line = "".join(r.choice(ALPHABETS["han"]) for _ in range(40))
    rows = {x.doc_id: x.n_near for x in lines.dedup(documents(spark, [(1, line), (2, line[:20] + "龘" + line[21:]), (3, line[:5] + line[6:]), (4, line[::-1])])).collect()}
    assert rows == {1: 0, 2: 1, 3: 1, 4: 0}
