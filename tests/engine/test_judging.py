"""Calls under a cap, with a stub that sleeps."""

from __future__ import annotations

import time

import pytest
from loomspark.operators import judging as J
from pyspark.sql import functions as F


def asker(price=1.0):
    def ask(prompt):
        time.sleep(0.002 * (hash(prompt) % 3))
        if "dead" in prompt:
            raise ConnectionError("gone")
        return J.Answer("" if "mute" in prompt else f"re: {prompt}", price)

    return ask


def tasks(spark, n=60):
    rows = [(f"k{i}", "dead" if i % 10 == 3 else "mute" if i % 10 == 7 else f"q{i}") for i in range(n)] + [("k0", "q0"), (None, "no key")]
    return spark.createDataFrame(rows, "key string, prompt string")


def test_results_keep_the_order_of_items():
    seen = []

    def slow(i):
        time.sleep(0.01 if i % 4 == 0 else 0)
        seen.append(i)
        return i * i

    assert list(J.in_order(slow, range(40), 8)) == [i * i for i in range(40)]
    assert sorted(seen) == list(range(40))
    assert list(J.in_order(slow, iter(range(5)), 1)) == [0, 1, 4, 9, 16]


def test_no_more_than_a_window_is_taken_ahead():
    taken = []

    def items():
        for i in range(30):
            taken.append(i)
            yield i

    out = J.in_order(lambda i: i, items(), 3)
    for got in range(10):
        assert next(out) == got
        assert len(taken) <= got + 1 + 2 * 3


def test_counts_equal_a_sequential_run(spark, tmp_path):
    t, path = tasks(spark), str(tmp_path / "log")
    s = J.judge_within(t, path, "key", "prompt", asker(), F.lit(1.0), cap=1000.0, batch_rows=25, parts=3)
    assert s == J.RunSummary(60, 0, 48, 6, 6, 0, 54.0)
    got = {r.key: r.raw for r in J.answers(spark, path, "key", "string").collect()}
    assert got == {f"k{i}": f"re: q{i}" for i in range(60) if i % 10 not in (3, 7)}
    errors = {r.error for r in J.log_of(spark, path, "key", "string").where("status = 'failed'").collect()}
    assert errors == {"ConnectionError: gone"}
    # The next run asks again only what failed or did not parse.
    again = J.judge_within(t, path, "key", "prompt", lambda p: J.Answer("well", 0.5), F.lit(1.0), cap=1000.0)
    assert again == J.RunSummary(60, 48, 12, 0, 0, 0, 6.0)
    assert J.judge_within(t, path, "key", "prompt", asker(), F.lit(1.0), cap=0.0) == J.RunSummary(60, 60, 0, 0, 0, 0, 0.0)


@pytest.mark.parametrize("cap", [0.0, 1.0, 7.5, 20.0])
def test_spending_stops_at_the_cap_and_goes_on_later(spark, tmp_path, cap):
    t, path = tasks(spark).where("prompt like 'q%'"), str(tmp_path / "log")
    s = J.judge_within(t, path, "key", "prompt", asker(), F.lit(1.0), cap=cap, batch_rows=20, parts=4)
    assert s.spent == s.judged == int(cap)
    assert s.skipped_over_budget == 48 - int(cap) and s.stopped_early
    rest = J.judge_within(t, path, "key", "prompt", asker(), F.lit(1.0), cap=100.0, parts=2)
    assert (rest.cache_hits, rest.judged, rest.stopped_early) == (int(cap), 48 - int(cap), False)


def test_worst_prices_are_held_back(spark, tmp_path):
    # Calls cost a tenth of the worst price, so more of them fit than worst prices do, and never more than the cap.
    t = tasks(spark).where("prompt like 'q%'")
    s = J.judge_within(t, str(tmp_path / "log"), "key", "prompt", asker(0.1), F.lit(1.0), cap=3.0, batch_rows=16, parts=2, workers=8)
    assert s.spent <= 3.0 + 1e-9 and s.judged > 3
    with pytest.raises(ValueError, match="48 calls may cost"):
        J.judge_within(t, str(tmp_path / "other"), "key", "prompt", asker(), F.lit(1.0), cap=3.0, affordable=True)


def test_no_tasks(spark, tmp_path):
    assert J.judge_within(tasks(spark).where("false"), str(tmp_path / "log"), "key", "prompt", asker(), F.lit(1.0), cap=1.0) == J.RunSummary(0, 0, 0, 0, 0, 0, 0.0)
