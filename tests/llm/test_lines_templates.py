"""Line dedup: many lines of one template, and segments that few lines hold and many look for."""

from __future__ import annotations

import random

import pytest
from helpers import documents
from loomspark.llm import lines
from loomspark.llm.common import saved
from pyspark.sql import functions as F
from test_global_operators import distance, edited


def candidates(spark, texts, rules):
    occ = lines.occurrences(documents(spark, [(k, t) for k, t in enumerate(texts)]), "doc_id", "text", rules)
    met = saved(lines.met_entries(saved(lines.keyed(occ, rules)), rules))
    known = saved(occ.select(lines.line_id(F.col("h")).alias("id"), "line"))
    entries = saved(lines.divided(met, known, rules))
    return entries, lines.near_pairs(entries, saved(known.select("id", lines.sketch("line").alias("s")).distinct()), rules).count()


def test_lines_of_a_template_meet_few_others(spark):
    r = random.Random(3)
    texts = [f"Invoice {r.randrange(10**8):08d} was issued to a customer on the first of the month" for _ in range(8_000)]
    few, many = (candidates(spark, texts[:n], lines.LineRules())[1] for n in (1_000, 8_000))
    # Each line meets a bounded number of others, not a share of all: 8,000 lines have 4,000 pairs a line.
    assert few < 8 * 1_000 and many < 8 * 8_000


def test_segments_that_many_look_for_are_divided(spark):
    r = random.Random(4)
    stem = "the same beginning of all these lines, "
    pick = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [stem + pick(41) for _ in range(3)] + [stem + pick(42) for _ in range(3_000)]
    entries, pairs = candidates(spark, [texts[9][:60] + texts[9][61:], *texts], lines.LineRules())
    assert entries.groupBy("key").count().agg(F.max("count")).first()[0] < 65 and 0 < pairs < 3_000


@pytest.mark.parametrize("tau,hot,rounds", [(1, 4, 3), (2, 4, 4), (2, 2, 1), (2, 3, 0)])
def test_templates_equal_brute_force(spark, tau, hot, rounds):
    r = random.Random(tau + hot)
    made = [f"No {r.randrange(300)} of {r.choice(['ä', 'b🙂', ''])} the list with {r.randrange(30)} items" for _ in range(150)]
    made += [f"{'ab' * r.randint(12, 14)}{r.choice('abc')}{'ab' * r.randint(0, 2)}" for _ in range(25)] + [edited(x, r.randint(1, 3), r) for x in made[:40]]
    made = list(dict.fromkeys(made))
    got = lines.dedup(documents(spark, list(enumerate(made))), rules=lines.LineRules(threshold=tau, hot=hot, rounds=rounds)).collect()
    want = {k for k, x in enumerate(made) if len(x) >= 24 and any(len(y) >= 24 and abs(len(x) - len(y)) <= tau and distance(x, y) <= tau for y in made[:k])}
    assert {x.doc_id for x in got if x.n_near} == want and 20 < len(want) < len(made) - 5
    assert {x.doc_id for x in got if x.text == ""} == want
