"""Periodic runs of words, by names of power-of-two stretches.

Stretches of 1, 2, 4, ... words get a number each, equal for equal stretches: the name of a stretch is that of the pair of
names of its halves. How far two places agree is then read by going down the levels, whole arrays of pairs of places at a
time. A run of period ``q`` holds ``max(6 - q, 3 q)`` or more places in a row whose word comes again ``q`` later, so it
crosses a grid of that step, and it is enough to extend from the points of that grid.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

_WORD = re.compile("[^\x20\x09-\x0d]+")


@dataclass(frozen=True)
class RunRules:
    """A run has ``min_length`` words and ``min_exponent`` periods at least; ``block`` bounds the pairs looked at together."""

    min_length: int = 6
    min_exponent: int = 4
    block: int = 1 << 18


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def numbered(words: list[str]) -> np.ndarray:
    """Words as numbers, equal for equal words."""
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


class Names:
    """Names of the stretches of ``2 ** k`` words, for each level up to the first at which no stretch comes twice."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.levels = [ids.astype(np.int32)]
        width, many = 1, len(ids)
        while 2 * width <= self.n:
            halves = self.levels[-1]
            pairs = halves[:-width].astype(np.int64) * many + halves[width:]
            found, names = np.unique(pairs, return_inverse=True)
            if len(found) == len(pairs):
                break
            self.levels.append(names.astype(np.int32))
            width, many = 2 * width, len(found)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from ``i`` on and from ``j`` on, where every ``i < j``."""
        at, other = i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            names, step = self.levels[k], 1 << k
            last = len(names) - 1
            fits = (other <= last) & (names[np.minimum(at, last)] == names[np.minimum(other, last)])
            at += fits * step
            other += fits * step
        return at - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree up to ``i`` and up to ``j``, both left out, where every ``i < j``."""
        at, other = i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            names, step = self.levels[k], 1 << k
            last = len(names) - 1
            fits = (at >= step) & (names[np.clip(at - step, 0, last)] == names[np.clip(other - step, 0, last)])
            at -= fits * step
            other -= fits * step
        return i - at


def runs(ids: np.ndarray, rules: RunRules = RunRules()) -> list[tuple[int, int, int]]:
    """All maximal runs ``(start, length, least period)`` of a sequence of numbers, by start, then period."""
    n = len(ids)
    top = n // rules.min_exponent if n >= rules.min_length else 0
    if not top:
        return []
    periods = np.arange(1, top + 1)
    step = np.maximum(rules.min_length - periods, (rules.min_exponent - 1) * periods)
    ends = np.cumsum(-(-(n - periods) // step))
    names, found = None, {}
    for low in range(0, int(ends[-1]), rules.block):
        c = np.arange(low, min(low + rules.block, int(ends[-1])))
        which = np.searchsorted(ends, c, side="right")
        q = periods[which]
        i = (c - np.where(which > 0, ends[which - 1], 0)) * step[which]
        same = ids[i] == ids[i + q]
        if not same.any():
            continue
        i, q = i[same], q[same]
        names = names or Names(ids)
        back = names.behind(i, i + q)
        length = back + names.ahead(i, i + q) + q
        long = length >= np.maximum(rules.min_length, rules.min_exponent * q)
        start, length, q = (i - back)[long], length[long], q[long]
        # One stretch is found from many points, and with multiples of its least period.
        first = np.lexsort((q, length, start))
        for s, m, p in zip(start[first].tolist(), length[first].tolist(), q[first].tolist()):
            found[s, m] = min(p, found.get((s, m), p))
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda r: (r[0], r[2]))


def greatest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, compared as fractions; among equals that of least start, then least period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """Words without those that a run repeats: of each run the first period stays."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(depth).tolist()) if not d]


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with the periodic tail that the contract of ``op13_periods`` gives every tenth id, by its checksum. A null
    id has no checksum, and its words stay."""
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if not n or h is None or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def find_runs(docs: DataFrame, keep: list[str], text: str = "text", doc_id: str = "doc_id", rules: RunRules = RunRules(), prepare: Callable[[list[str], int | None], list[str]] | None = None, with_runs: bool = True) -> DataFrame:
    """Periodic runs of whole texts and what is left of the texts without their repetitions.

    ``runs array<struct<start,length,period>>`` and ``collapsed string`` come with ``with_runs``; their digests, the number
    of runs and the greatest run come always. ``prepare`` may change the words of a row before they are searched. Null and
    empty texts have no words and no runs, so four nulls and two digests of the empty text; very long texts are searched
    whole, in memory of some four bytes a word for each level at which stretches repeat; repeated rows have equal values;
    runs that tie go to the least start, then the least period. An empty table gives an empty result, and kept columns
    named like a result give way.
    """

    def fn(columns):
        for t, i in zip(*columns):
            words = words_of(t)
            if prepare is not None:
                words = prepare(words, i)
            found = runs(numbered(words), rules)
            best = greatest(found)
            left = " ".join(collapsed(words, found))
            listed = "".join(f"{s},{m},{p}\n" for s, m, p in found)
            yield (
                len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
                hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(),
                [dict(zip(("start", "length", "period"), r)) for r in found] if with_runs else None, left if with_runs else None,
            )

    out = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    made = map_rows(docs, [text, doc_id], fn, out, keep=keep)
    return made if with_runs else made.drop("runs", "collapsed")
