"""Operators that compare documents with each other, against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from helpers import ODD, documents, empty, words
from loomspark.llm import lines, near, substrings
from loomspark.llm.common import components


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


# ------------------------------------------------------------------ components


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(1, 1), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {x: x for e in edges for x in e if x is not None}
    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: find(parent, x) for x in linked}


# ------------------------------------------------------------------ near duplicates


def plain_components(texts):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if texts[i][0] is not None and texts[j][0] is not None and n and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[find(parent, i)].append(d)
    return [(d, len(sets[i]), min(least[find(parent, i)]) if d is not None else None) for i, (d, _) in enumerate(texts)]


def variants(n, base, edits, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 9999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("rules", [near.NearRules(), near.NearRules(large=3, block=4)])
def test_near_duplicates_equal_brute_force(spark, rules):
    texts = variants(60, words(120, 1), 6, 1) + variants(40, words(60, 2), 5, 2) + [" ".join(words(30, 100 + i)) for i in range(20)]
    texts += texts[:5] + ["One Two", "one two", "ONE", "one two three four five"]
    rows = list(enumerate(texts, start=20))
    random.Random(3).shuffle(rows)
    rows = [(None, texts[0]), (7, None), (8, ""), (9, " \n"), (10, "word"), (10, "word"), (12, "long " * 3000)] + rows
    got = near.near_duplicates(documents(spark, rows), rules=rules).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(plain_components(rows), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert near.near_duplicates(empty(spark)).count() == 0
    assert [r.kept for r in near.near_duplicates(documents(spark, [(1, "only one")])).collect()] == [True]


def test_estimates_are_near_the_truth(spark):
    rules = near.NearRules()
    base = words(400, 5)
    a = near.signature(near.shingles(" ".join(base)), rules)[1]
    other = variants(1, base, 20, 6)[0]
    b = near.signature(near.shingles(other), rules)[1]
    x, y = set(near.shingles(" ".join(base)).tolist()), set(near.shingles(other).tolist())
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    assert df.select(near.estimate("a", "b", rules)).first()[0] == pytest.approx(len(x & y) / len(x | y), abs=0.15)
    assert df.select(near.estimate("a", "a", rules)).first()[0] == pytest.approx(1.0)


# ------------------------------------------------------------------ substrings


def plain_sentences(text):
    """Sentences by one split: after marks with closing quotes before white space, and at line ends."""
    cuts = [m.end() for m in re.finditer(r"[.!?]+[\"')\]]*(?=\s)|\n", text)]
    parts = [(a, b, text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
    return [(a + len(p) - len(p.lstrip()), p.split()) for a, b, p in parts if p.strip()]


def plain_cut(texts, rules):
    """All spans of sentences whose words reach the number, none of whose ends could be left out, are looked up by their words."""
    every = []
    for _, t in texts:
        s = [w for _, w in plain_sentences(t or "")]
        spans = set()
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                words = sum(map(len, s[i:j]))
                fits = lambda a, b: b - a >= rules.min_sentences and sum(map(len, s[a:b])) >= rules.min_words
                if fits(i, j) and (not fits(i, j - 1) or not fits(i + 1, j)) or j - i == 1 and words >= rules.alone:
                    spans.add((i, j))
        every.append((s, spans))
    first = {}
    order = sorted(range(len(texts)), key=lambda i: (texts[i][0] is not None, texts[i][0] or 0))
    said = lambda s, i, j: tuple(" ".join(w) for w in s[i:j])
    for k in order:
        s, spans = every[k]
        for i, j in sorted(spans):
            first.setdefault(said(s, i, j), (texts[k], i))
    out = []
    for (d, t), (s, spans) in zip(texts, every):
        gone = {x for i, j in spans if first[said(s, i, j)] != ((d, t), i) for x in range(i, j)}
        at = [a for a, _ in plain_sentences(t or "")] + [len(t or "")]
        left = t if not gone else t[: at[0]] + "".join(t[at[x] : at[x + 1]] for x in range(len(s)) if x not in gone)
        out.append((left, len(gone)))
    return out


def passage(seed, n=5):
    return " ".join(" ".join(words(12, seed * 100 + i)).capitalize() + "." for i in range(n))


@pytest.mark.parametrize("hot", [1024, 8])
def test_substrings_equal_brute_force(spark, hot):
    shared = [passage(i) for i in range(4)]
    texts = [(20 + i, f"{passage(50 + i, 2)} {shared[i % 4]} {passage(80 + i, 2)}\n{shared[(i + 1) % 4] if i % 3 else ''}") for i in range(12)]
    texts += [(50, shared[0] + " " + shared[0]), (51, "short. short. short. short."), (52, "short. short."), *ODD]
    df = documents(spark, texts).withColumnRenamed("keys", "removed")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in substrings.dedup(df, rules=substrings.SpanRules(hot=hot)).collect()), key=str)
    want = sorted(((d, *x) for (d, _), x in zip(texts, plain_cut(texts, substrings.SpanRules()))), key=str)
    assert got == want
    by = {d: n for d, _, n in got}
    assert by[20] == 0 and by[24] >= 5 and by[51] == 0 and by[52] == 0 and by[50] >= 5
    assert substrings.dedup(empty(spark)).count() == 0


def test_a_passage_goes_wholly_and_its_neighbours_stay(spark):
    shared = passage(3)
    texts = [(1, f"{passage(10, 2)} {shared} {passage(11, 2)}"), (2, f"{passage(12, 2)} {shared} {passage(13, 2)}")]
    got = {r.doc_id: r.text for r in substrings.dedup(documents(spark, texts)).collect()}
    assert got[1] == texts[0][1] and got[2] == f"{passage(12, 2)} {passage(13, 2)}"


def test_sentences_cover_the_text():
    for t in ("A b. C d! E\nF? g", "no mark", "...", "a.b c. D", ""):
        assert "".join(t[a:b] for a, b in substrings.sentences(t)).split() == "".join(t.split()).split() or t == t.strip()
        places = substrings.sentences(t)
        assert all(a < b for a, b in places) and all(p[1] <= q[0] for p, q in zip(places, places[1:]))


# ------------------------------------------------------------------ lines


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(text, n, r):
    a = list(text)
    for _ in range(n):
        k = r.randrange(len(a))
        c = r.choice("abeté🙂")
        what = r.random()
        if what < 0.4:
            a.insert(k, c)
        elif what < 0.7 and len(a) > 1:
            a.pop(k)
        else:
            a[k] = c
    return "".join(a)


@pytest.mark.parametrize("tau", [1, 2])
def test_banded_distance(spark, tau):
    r = random.Random(tau)
    pairs = []
    for _ in range(1500):
        b = "".join(r.choice("ab🙂é") for _ in range(r.randint(1, 12)))
        pairs.append((edited(b, r.randint(0, tau + 2), r) or "a", b))
    got = spark.createDataFrame(pairs, "a string, b string").withColumn("w", lines.within("a", "b", tau)).collect()
    assert all(x.w == (distance(x.a, x.b) <= tau) for x in got)


@pytest.mark.parametrize("tau,hot", [(1, 64), (1, 2), (2, 3)])
def test_line_dedup_equals_brute_force(spark, tau, hot):
    r = random.Random(9)
    base = ["".join(r.choice("abcde tion") for _ in range(r.randint(10, 24))) for _ in range(12)]
    pool = base + [edited(x, r.randint(1, 3), r) for x in base for _ in range(6)]
    texts = [(20 + i, "\n".join(r.choice(pool) for _ in range(8)) + "\nshort\nshort") for i in range(25)] + ODD + [(60, "\n\n\n"), (61, pool[0] + "\r\n" + pool[0])]
    rules = lines.LineRules(threshold=tau, min_chars=8, hot=hot)
    first = {}
    for d, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        for i, x in enumerate((t or "").split("\n")):
            if len(x) >= 8:
                first.setdefault(x, (d is not None, d or 0, t, i))
    rank = {x: k for k, x in enumerate(sorted(first, key=lambda x: (first[x][0], first[x][1], first[x][3])))}
    close = {x for x in first for y in first if rank[y] < rank[x] and abs(len(x) - len(y)) <= tau and distance(x, y) <= tau}
    want = []
    for d, t in texts:
        keep = [x for i, x in enumerate((t or "").split("\n")) if len(x) < 8 or first[x] == (d is not None, d or 0, t, i) and x not in close]
        want.append((d, None if t is None else "\n".join(keep)))
    got = lines.dedup(documents(spark, texts).withColumnRenamed("keys", "n_near"), rules=rules).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted(want, key=str)
    assert lines.dedup(empty(spark)).count() == 0


def test_line_dedup_keeps_to_columns(spark):
    df = documents(spark, [(1, "a line that is certainly long enough"), (2, "a line that is certainly long enough\nand one more that stays here")])
    rows = {x.doc_id: x for x in lines.dedup(df).collect()}
    assert rows[2].text == "and one more that stays here" and rows[2].n_exact == 1 and rows[2].n_near == 0
    plan = lines.dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
