"""A session's turns as commits: keyed state in Structured Streaming, and the same fold over a table.

A turn is a row of ``TURN``. It is committed if it is the one after its session's last, comes from the session's owner and
says something; any other changes nothing, and its row says why. What a session holds (its last turn, title, what it has
shown first and where, what it must not show) is Spark's own state under the session's key: a batch that is run again after a
failure begins from the state before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: ``seq`` is the order of arrival.
TURN = "session string, seq long, turn int, owner string, text string, shown array<struct<item:string,title:string>>, excluded array<string>"

COMMIT = "session string, seq long, turn int, status string, last_turn int, title string, n_shown int, n_excluded int, summary string"

_STATE = "last int, owner string, title string, shown string, excluded string"

#: A title is the beginning of the first message; a summary lists so many of the items shown last.
TITLE_CHARS = 24
SUMMARY_ITEMS = 12

_NEW = (0, None, "", "{}", "[]")


def _status(turn: dict, last: int, owner: str | None) -> str:
    if turn["turn"] is None or turn["turn"] <= last:
        return "repeated"
    if turn["turn"] > last + 1:
        return "early"
    if last and owner is not None and turn["owner"] != owner:
        return "foreign"
    return "committed" if (turn["text"] or "").strip() else "empty"


def _summary(shown: dict[str, str], excluded: list[str]) -> str:
    """STR-18: the last items, numbered from 1, and what is excluded."""
    listed = " ".join(f"{i}.{title}" for i, title in enumerate(list(shown.values())[-SUMMARY_ITEMS:], 1))
    return listed + (f" -{','.join(excluded)}" if excluded else "")


def fold(turns: list[dict], state: tuple) -> tuple[list[tuple], tuple]:
    """STR-12, STR-17 to STR-19: the rows of a session's turns, in order of arrival, and the state after them."""
    last, owner, title, shown_text, excluded_text = state
    shown, excluded, out = json.loads(shown_text), json.loads(excluded_text), []
    for t in sorted(turns, key=lambda t: (t["seq"] is None, t["seq"] or 0)):
        status = _status(t, last, owner)
        if status == "committed":
            owner = t["owner"] if not last else owner
            last = t["turn"]
            title = title or t["text"].strip()[:TITLE_CHARS]
            for x in t["shown"] if t["shown"] is not None else ():
                shown.setdefault(x["item"], x["title"])
            excluded += [x for x in dict.fromkeys(t["excluded"] if t["excluded"] is not None else ()) if x not in excluded]
        out.append((t["session"], t["seq"], t["turn"], status, last, title, len(shown), len(excluded), _summary(shown, excluded)))
    return out, (last, owner, title, json.dumps(shown), json.dumps(excluded))


def _records(p: pd.DataFrame) -> list[dict]:
    return p.astype(object).where(p.notna(), None).to_dict("records")


_COLUMNS = [c.split()[0] for c in COMMIT.split(", ")]


def commits(turns: DataFrame) -> DataFrame:
    """STR-19 over a table: all turns of a session are folded together. Sessions without a name are left out."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold(_records(p), _NEW)[0], columns=_COLUMNS)

    return turns.where("session is not null").groupBy("session").applyInPandas(run, COMMIT)


def commit_stream(turns: DataFrame) -> DataFrame:
    """STR-19 over a stream: the rows of each batch's turns, from the state that its sessions have."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, after = fold([r for p in parts for r in _records(p)], state.get if state.exists else _NEW)
        state.update(after)
        yield pd.DataFrame(rows, columns=_COLUMNS)

    return turns.where("session is not null").groupBy("session").applyInPandasWithState(run, COMMIT, _STATE, "append", GroupStateTimeout.NoTimeout)


def commit_files(spark: SparkSession, source: str, out: str, checkpoint: str, files_per_trigger: int = 1, before_write=None) -> StreamingQuery:
    """Turns from a folder of JSON lines; each batch's rows go to a folder of its own number, so a batch that is run again
    takes the place of its first attempt. ``before_write`` is called with the batch's number, for tests of failures."""
    turns = spark.readStream.schema(TURN).option("maxFilesPerTrigger", files_per_trigger).json(source)

    def write(batch: DataFrame, number: int) -> None:
        if before_write is not None:
            before_write(number)
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return commit_stream(turns).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
