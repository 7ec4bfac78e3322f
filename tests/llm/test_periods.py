"""Periodic runs against a plain version that tries every stretch."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from helpers import ODD, documents, empty
from loomspark.llm import periods, registry


def plain_runs(w):
    """All runs by trying every period at every place, the least period of a stretch by trying all smaller ones."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(6, 4 * q):
                part = w[start : start + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.add((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w, word = [], ""
    for c in (text or "") + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            if word:
                w.append(word)
            word = ""
        else:
            word += c
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        n, g, old = len(w), h // 10, list(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = None
    for r in found:
        if best is None or Fraction(r[1], r[2]) > Fraction(best[1], best[2]):
            best = r
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_those_of_every_stretch(letters):
    r = random.Random(letters)
    for _ in range(400):
        w = [r.randrange(letters) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            unit = [r.randrange(letters) for _ in range(r.randint(1, 7))]
            at = r.randint(0, len(w))
            w[at:at] = unit * r.randint(2, 7) + unit[: r.randint(0, len(unit))]
        for block in (7, 1 << 18):
            assert periods.runs(np.array(w, dtype=np.int64), periods.RunRules(block=block)) == plain_runs(w)


def test_lengths_of_agreement():
    r = random.Random(3)
    for _ in range(100):
        w = [r.randrange(2) for _ in range(r.randint(2, 50))]
        names = periods.Names(np.array(w, dtype=np.int64))
        pairs = [(i, j) for i in range(len(w)) for j in range(i + 1, len(w))]
        i, j = (np.array(x) for x in zip(*pairs))
        ahead = [next((k for k in range(len(w)) if b + k >= len(w) or w[a + k] != w[b + k]), 0) for a, b in pairs]
        behind = [next((k for k in range(len(w)) if a - k < 1 or w[a - k - 1] != w[b - k - 1]), 0) for a, b in pairs]
        assert names.ahead(i, j).tolist() == ahead
        assert names.behind(i, j).tolist() == behind


def test_greatest_run_is_compared_exactly():
    m = 10**9
    assert periods.greatest([(0, 4 * m + 1, m), (5, 4 * (m + 1) + 1, m + 1)]) == (0, 4 * m + 1, m)
    assert periods.greatest([(9, 8, 2), (3, 4, 1), (3, 8, 2)]) == (3, 4, 1)
    assert periods.greatest([]) is None


def test_rows_of_odd_texts(spark):
    r = random.Random(5)
    texts = ODD + [(100 + i, " ".join(r.choice("ab") for _ in range(r.randint(0, 40)))) for i in range(150)]
    texts += [(i, " ".join(f"w{k}" for k in range(30))) for i in range(300, 360)]  # some of these ids get a periodic tail
    rows = periods.find_runs(documents(spark, texts), ["doc_id", "kept"], prepare=periods.planted, with_runs=False).collect()
    short = {(i, t): plain_row(i, t) for i, t in texts if len(t or "") < 1000}
    assert len(rows) == len(texts)
    for (i, t), row in zip(texts, rows):
        if (i, t) in short:
            assert tuple(row)[2:] == short[i, t]
    long = rows[len(ODD) - 1]
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 30_000, 1) or zlib.crc32(b"12") % 10 == 0
    assert periods.find_runs(empty(spark), ["doc_id"]).count() == 0


def test_runs_and_text_themselves(spark):
    row = periods.find_runs(documents(spark, [(1, "so on and on and on and on and on then")]), ["doc_id"]).first()
    assert [tuple(x) for x in row.runs] == [(1, 9, 2)]
    assert row.collapsed == "so on and then"


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = registry.QUERIES["op13_periods"](spark, d).collect()
    assert len(rows) == len(docs)
    few = [r for r in rows if len(docs[r.doc_id] or "") < 3000]
    assert len(few) > 100
    for r in few:
        assert tuple(r)[1:] == plain_row(r.doc_id, docs[r.doc_id])
