"""Substring dedup by sliding sentence spans.

Every run of consecutive sentences that just reaches a number of words is hashed, from each sentence forwards and
backwards; runs that occur again anywhere in the corpus are found by one global join, and the sentences that any but
the first occurrence covers are removed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, P, map_rows, saved


@dataclass(frozen=True)
class SpanRules:
    """A run has at least ``min_sentences`` sentences and ``min_words`` words. A single sentence of ``alone`` words is a
    run too, so that a long passage without sentence marks is not missed. Runs that make up more than a thousandth of all,
    and occur more than about ``hot`` times, are never brought together in one task."""

    min_sentences: int = 2
    min_words: int = 20
    alone: int = 40
    hot: int = 1024


_LOOK = 8


#: A sentence ends after its marks, with closing quotes, before white space; or at a line's end.
_MARK = re.compile(r"[.!?]+[\"')\]]*(?=\s)|\n")


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of the sentences of a text, white space around them left out; parts without a word are none."""
    out, start = [], 0
    for m in _MARK.finditer(text):
        out.append((start, m.end()))
        start = m.end()
    out.append((start, len(text)))
    trimmed = []
    for a, b in out:
        part = text[a:b]
        left = part.lstrip()
        if left:
            a += len(part) - len(left)
            trimmed.append((a, a + len(left.rstrip())))
    return trimmed


def runs(text: str | None, rules: SpanRules = SpanRules()) -> list[tuple[int, int, int, int]]:
    """``(hash, second hash, first sentence, sentences)`` of each run of a text, each once."""
    if not text:
        return []
    places = sentences(text)
    words = [text[a:b].split() for a, b in places]
    size = [len(w) for w in words]
    marks = [xxhash.xxh3_128_digest(" ".join(w)) for w in words]
    n = len(size)
    spans: set[tuple[int, int]] = set()
    total, end = 0, 0
    for start in range(n):  # forwards: the shortest run from each sentence
        if end < start:
            total, end = 0, start
        while end < n and (total < rules.min_words or end - start < rules.min_sentences):
            total += size[end]
            end += 1
        if total >= rules.min_words and end - start >= rules.min_sentences:
            spans.add((start, end - start))
        total -= size[start]
    total, start = 0, 0
    for end in range(n):  # backwards: the shortest run to each sentence
        total += size[end]
        while total - size[start] >= rules.min_words and end - start >= rules.min_sentences:
            total -= size[start]
            start += 1
        if total >= rules.min_words and end + 1 - start >= rules.min_sentences:
            spans.add((start, end + 1 - start))
    spans |= {(i, 1) for i in range(n) if size[i] >= rules.alone}
    out = []
    for start, k in spans:
        d = xxhash.xxh3_128_digest(b"".join(marks[start : start + k]))
        out.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), start, k))
    return out


def cut(text: str | None, spans: list[tuple[int, int]] | None) -> tuple[str | None, int, list[tuple[int, int]]]:
    """The text without the sentences that the runs cover, their number, and the removed stretches of characters."""
    if not text or not spans:
        return text, 0, []
    places = sentences(text)
    gone = bytearray(len(places) + 1)
    for start, k in spans:
        gone[start : start + k] = b"\x01" * k
    stretches: list[tuple[int, int]] = []
    for i, (a, _) in enumerate(places):
        if gone[i]:
            # The white space up to the next sentence goes too.
            end = places[i + 1][0] if i + 1 < len(places) else len(text)
            if stretches and stretches[-1][1] >= a:
                stretches[-1] = (stretches[-1][0], end)
            else:
                stretches.append((a, end))
    out, at = [], 0
    for a, b in stretches:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]]), sum(gone), stretches


def hot_runs(listed: DataFrame, rules: SpanRules) -> list[int]:
    """Hashes of runs that many rows hold, fewer than ``HOT_SHARE``. One row in so many is looked at, whatever its text and id
    are, so copies are looked at in their share. That only decides how rows are dealt."""
    looked = listed.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_LOOK)) == 0)
    least = max(rules.hot // _LOOK, (looked.agg(F.sum(F.size("runs"))).first()[0] or 0) // HOT_SHARE)
    return [r.h for r in looked.select(F.inline("runs")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > least).collect()]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: SpanRules = SpanRules()) -> DataFrame:
    """All rows and columns, the text without repeated runs, and ``n_sentences``, ``n_removed`` and ``removed``, the
    stretches of the old text that are gone.

    First is the occurrence with the least id, then the least text hash, then the least place; null ids come first.
    Null and empty texts have no sentences and stay as they are; an empty table gives an empty result. Rows that repeat an
    id and a text are one document and keep the same sentences. Extra columns stay, but for those named like a new one.
    Texts are never held together: runs are made once and travel as numbers, and each document is cut by itself.
    """
    key = [F.col(doc_id).alias(f"{P}d"), F.xxhash64(F.col(text)).alias(f"{P}t")]

    def fn(columns):
        for t in columns[0]:
            yield ([{"h": h, "g": g, "a": a, "k": k} for h, g, a, k in runs(t, rules)],)

    listed = saved(map_rows(docs.select(*key, F.col(text).alias(f"{P}x")), [f"{P}x"], fn, "runs array<struct<h:bigint,g:bigint,a:int,k:int>>", keep=[f"{P}d", f"{P}t"]))
    spans = listed.select(f"{P}d", f"{P}t", F.inline("runs"))
    place = F.struct(f"{P}d", f"{P}t", "a")
    hot = hot_runs(listed, rules)
    # The firsts of hot runs are aggregated and come to their rows, which are dealt out; all other runs are brought
    # together once, where first and number are told to each row on the spot.
    first = saved(spans.where(F.col("h").isin(hot)).groupBy("h", "g").agg(F.min(place).alias("f")))
    marked = spans.join(F.broadcast(first) if len(hot) < HOT_SHARE else first, ["h", "g"], "left")
    # Rows of hot runs have their first already, so any dealing will do, and places are dealt out even where rows repeat.
    marked = marked.withColumn("deal", F.when(F.col("f").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(HOT_SHARE))).otherwise(F.lit(0)))
    same = Window.partitionBy("h", "g", "deal")
    told = marked.withColumns({"first": F.coalesce("f", F.min(place).over(same)), "n": F.count("*").over(same)})
    later = told.where((F.col("f").isNotNull() | (F.col("n") > 1)) & ~place.eqNullSafe(F.col("first")))
    spans_by_doc = saved(later.groupBy(f"{P}d", f"{P}t").agg(F.collect_list(F.struct("a", "k")).alias(f"{P}s")))
    sized = spans_by_doc.withColumnsRenamed({f"{P}d": f"{P}e", f"{P}t": f"{P}u"})
    tagged = docs.withColumns({f"{P}d": F.col(doc_id), f"{P}t": F.xxhash64(F.col(text))})
    joined = tagged.join(sized, F.col(f"{P}d").eqNullSafe(F.col(f"{P}e")) & (F.col(f"{P}t") == F.col(f"{P}u")), "left")

    def apply(columns):
        for t, s in zip(*columns):
            kept, n, gone = cut(t, [(x["a"], x["k"]) for x in s] if s else None)
            yield kept, len(sentences(t)) if t else 0, n, [{"start": a, "end": b} for a, b in gone]

    out = f"{P}out string, n_sentences long, n_removed long, removed array<struct<start:bigint,end:bigint>>"
    done = map_rows(joined, [text, f"{P}s"], apply, out, keep=[c for c in docs.columns if c != text])
    extra = ["n_sentences", "n_removed", "removed"]
    return done.select(*[F.col(f"{P}out").alias(c) if c == text else F.col(c) for c in docs.columns if c not in extra], *extra)
