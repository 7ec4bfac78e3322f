"""Turns as commits: the stream's keyed state, and a restart in the middle of a batch."""

from __future__ import annotations

import json
import random

import pytest
from loomspark.streaming import sessions as S


def turn(session, seq, number, text="hello", owner="o", shown=(), excluded=()):
    return {"session": session, "seq": seq, "turn": number, "owner": owner, "text": text, "shown": [{"item": i, "title": i.upper()} for i in shown], "excluded": list(excluded)}


def statuses(rows):
    return [r[3] for r in rows]


def test_what_is_committed_and_what_changes_nothing():
    rows, state = S.fold(
        [turn("s", 1, 2), turn("s", 2, 1, "  first words of all  ", shown=["a", "b"]), turn("s", 3, 1, "again"), turn("s", 4, 2, " "), turn("s", 5, 2, owner="other"), turn("s", 6, 2, shown=["b", "c"], excluded=["x", "x"]), turn("s", 7, None), turn("s", 8, 4)],
        S._NEW,
    )
    assert statuses(rows) == ["early", "committed", "repeated", "empty", "foreign", "committed", "repeated", "early"]
    assert [r[4] for r in rows] == [0, 1, 1, 1, 1, 2, 2, 2]
    assert rows[-1][5:] == ("first words of all", 3, 1, "1.A 2.B 3.C -x")
    assert state[0] == 2 and json.loads(state[3]) == {"a": "A", "b": "B", "c": "C"}


def test_folding_by_parts_equals_folding_at_once():
    r = random.Random(2)
    turns = [turn("s", i, r.randint(1, 12), shown=[str(r.randint(0, 30))], excluded=[str(r.randint(0, 9))] * r.randint(0, 2)) for i in range(60)]
    whole = S.fold(turns, S._NEW)
    state, rows = S._NEW, []
    for i in range(0, 60, 7):
        some, state = S.fold(turns[i : i + 7], state)
        rows += some
    assert (rows, state) == whole


def test_summary_numbers_the_last_items_anew():
    rows, _ = S.fold([turn("s", 1, 1, shown=[f"i{k}" for k in range(15)])], S._NEW)
    assert rows[0][8].split()[0] == "1.I3" and rows[0][8].split()[-1] == "12.I14"


def made(n=90):
    r = random.Random(5)
    out = []
    for i in range(n):
        out.append(turn(r.choice(["a", "b", "c", "d"]), i, r.randint(1, 9), r.choice(["hi", "", "more"]), r.choice(["o", "o", "p"]), [str(r.randint(0, 20))], [str(r.randint(0, 5))]))
    return out


def test_stream_equals_batch_after_a_forced_restart(spark, tmp_path):
    turns, source = made(), tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text("\n".join(json.dumps(t) for t in turns[30 * i : 30 * i + 30]))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def fail(number):
        if number == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        S.commit_files(spark, str(source), out, checkpoint, before_write=fail).awaitTermination(120)
    S.commit_files(spark, str(source), out, checkpoint).awaitTermination(120)
    columns = S._COLUMNS
    streamed = sorted(map(tuple, spark.read.parquet(out).select(*columns).collect()))
    whole = sorted(map(tuple, S.commits(spark.createDataFrame(turns, S.TURN)).select(*columns).collect()))
    assert len(streamed) == len(turns)
    assert {x[3] for x in whole} >= {"committed", "repeated", "early"}
    # Files come in the order of their names here, which is that of arrival; so the states met are the same.
    assert streamed == whole
