"""Dictionary segmentation: runs of letters without spaces are cut into the most likely sequence of dictionary words.

The words that begin at each place of a run form a graph. A word's weight is the logarithm of its share of all occurrences,
and a character that begins no word counts as a word that occurred once. The best path is found from the end of a run
backwards; of equal paths the one whose first word is longer is taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dictionary of up to so many words travels to the tasks; a larger one is joined.
DICTIONARY_ROWS = 1_000_000

#: Inside of a character class: what a run is made of.
HAN = r"\p{IsHan}"


def best_path(run: str, words_from: Callable[[int], Iterator[tuple[int, float]]]) -> list[str]:
    """The heaviest path through a run, given the ends and weights of the words that begin at each place."""
    best = [(0.0, 0)] * (len(run) + 1)
    for start in range(len(run) - 1, -1, -1):
        best[start] = max((weight + best[end][0], end) for end, weight in words_from(start))
    out, at = [], 0
    while at < len(run):
        out.append(run[at : best[at][1]])
        at = best[at][1]
    return out


class PrefixDictionary:
    """The weight of each word; proper prefixes of words are held too, without a weight, so a search knows when to stop."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values())
        self.least = -math.log(total) if total else 0.0
        self.weights: dict[str, float | None] = {}
        for word in counts:
            for end in range(1, len(word)):
                self.weights.setdefault(word[:end])
        self.weights.update((w, math.log(n) + self.least) for w, n in counts.items())

    def segment(self, run: str) -> list[str]:
        weights, least, n = self.weights, self.least, len(run)

        def words_from(start: int) -> Iterator[tuple[int, float]]:
            weight = weights.get(run[start])
            yield start + 1, least if weight is None else weight
            end = start + 1
            while end < n and run[start:end] in weights:
                end += 1
                weight = weights.get(run[start:end])
                if weight is not None:
                    yield end, weight

        return best_path(run, words_from)


def _counts(dictionary: DataFrame, word: str, count: str) -> DataFrame:
    """Words in lower case with the sum of their counts; nulls, empty words and counts under one are left out."""
    rows = dictionary.select(F.lower(word).alias("word"), F.col(count).cast("long").alias("n"))
    return rows.where("word is not null and word <> '' and n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def _pieces(c: str | Column, run: str) -> tuple[Column, Column]:
    """Words of a text in lower case, cut where a run begins or ends, and which of them are runs."""
    words = F.regexp_extract_all(F.lower(F.col(c) if isinstance(c, str) else c), F.lit(rf"[{run}]+|[\p{{L}}\p{{N}}_&&[^{run}]]+"), F.lit(0))
    return words, F.transform(words, lambda w: w.rlike(f"^[{run}]"))


def segmenter(dictionary: DataFrame, word: str = "word", count: str = "count", run: str = HAN, rows: int = DICTIONARY_ROWS) -> Callable[[str | Column], Column]:
    """TXT-30: a tokenizer that cuts runs by a dictionary table. Other words stay whole, all are in lower case, and what holds
    no word character is dropped.

    The dictionary is read once, after its size has been checked: one of more than ``rows`` words is refused here, and
    :func:`segmented` joins it instead. Null texts give null, and with an empty dictionary each character is a word. Words
    and runs of a text are found by expressions; only the cutting of runs is Python.
    """
    counts = _counts(dictionary, word, count)
    found = counts.limit(rows + 1).toPandas()
    if len(found) > rows:
        raise ValueError(f"the dictionary has more than {rows} words; segmented() joins one of any size")
    known = dictionary.sparkSession.sparkContext.broadcast(dict(zip(found["word"], found["n"].tolist())))

    @F.pandas_udf("array<string>")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        graph = PrefixDictionary(known.value)
        for words, runs in parts:
            yield pd.Series([None if w is None else [x for y, inside in zip(w, r) for x in (graph.segment(y) if inside else (y,))] for w, r in zip(words, runs)], index=words.index, dtype=object)

    return lambda c: cut(*_pieces(c, run))


def segmented(rows: DataFrame, key: str, text: str, dictionary: DataFrame, word: str = "word", count: str = "count", run: str = HAN) -> DataFrame:
    """TXT-30 for a dictionary of any size: ``(key, tokens)``, equal to those of :func:`segmenter`.

    Each distinct run meets the dictionary once: its stretches, up to the length of the longest word, are joined with the
    words, so neither side has to fit into one task. Keys name rows and are not null; texts without words have no tokens.
    """
    counts = _counts(dictionary, word, count)
    size = counts.agg(F.sum("n").alias("total"), F.max(F.char_length("word")).alias("longest")).first()
    total, longest = size["total"] or 1, size["longest"] or 1
    least = -math.log(total)
    words, runs = _pieces(text, run)
    listed = rows.select(key, F.explode(F.arrays_zip(words.alias("w"), runs.alias("r"), F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))).alias("i"))).alias("x")).where("x.w is not null").select(key, "x.*")
    distinct = listed.where("r").select("w").distinct()
    places = distinct.select("w", F.explode(F.sequence(F.lit(0), F.char_length("w") - 1)).alias("s"))
    stretches = places.select("w", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("w") - F.col("s")))).alias("l"))
    edges = stretches.withColumn("word", F.expr("substring(w, s + 1, l)")).join(counts, "word").groupBy("w").agg(F.collect_list(F.struct("s", "l", "n")).alias("edges"))

    @F.pandas_udf("array<string>")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in parts:
            out = []
            for t, found in zip(texts, lists):
                at: list[dict[int, float]] = [{i + 1: least} for i in range(len(t))]
                for e in found if found is not None else ():
                    at[e["s"]][e["s"] + e["l"]] = math.log(e["n"]) + least
                out.append(best_path(t, lambda start, at=at: at[start].items()))
            yield pd.Series(out, index=texts.index, dtype=object)

    parts = distinct.join(edges, "w", "left").select("w", F.lit(True).alias("r"), cut("w", "edges").alias("parts"))
    tokens = listed.join(parts, ["w", "r"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("parts", F.array("w")).alias("t")))).alias("x"))
    return rows.select(key).join(tokens, key, "left").select(key, F.coalesce(F.flatten(F.transform("x", lambda x: x["t"])), F.array().cast("array<string>")).alias("tokens"))
