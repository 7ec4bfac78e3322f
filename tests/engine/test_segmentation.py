"""Dictionary segmentation against all segmentations of a run."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from loomspark.operators import lexical
from loomspark.operators import segmentation as S


def all_paths(run):
    if not run:
        yield ()
    for end in range(1, len(run) + 1):
        for rest in all_paths(run[end:]):
            yield (run[:end], *rest)


def likelihood(path, counts):
    """Exact; 0 for a path that no graph of words and lone characters holds."""
    total, out = sum(counts.values()) or 1, Fraction(1)
    for w in path:
        out *= Fraction(counts.get(w, 1 if len(w) == 1 else 0), total)
    return out


@pytest.mark.parametrize("letters", ["ab", "abc", "研究生命起源"])
def test_best_path_is_the_best_of_all(letters):
    r = random.Random(1)
    for _ in range(250):
        counts = {"".join(r.choice(letters) for _ in range(r.randint(1, 4))): r.randint(1, 60) for _ in range(r.randint(0, 9))}
        run = "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
        got = S.PrefixDictionary(counts).segment(run)
        assert "".join(got) == run
        assert likelihood(got, counts) == max(likelihood(p, counts) for p in all_paths(run))


def test_equal_paths_take_the_longer_first_word():
    assert S.PrefixDictionary({"ab": 4, "c": 4, "a": 4, "bc": 4}).segment("abc") == ["ab", "c"]
    assert S.PrefixDictionary({}).segment("abc") == ["a", "b", "c"]


WORDS = [("研究", 40), ("研究生", 12), ("生命", 30), ("命", 5), ("起源", 20), ("Reborn", 3), (None, 4), ("", 9), ("源", 0), ("研究", 2)]
TEXTS = [(1, "研究生命起源"), (2, "The 研究生，生命x2_研究!"), (3, None), (4, ""), (5, "。，"), (6, "研究" * 3000), (1, "生命 生命")]


def test_tokens_of_texts(spark):
    d = spark.createDataFrame(WORDS, "word string, count int")
    t = spark.createDataFrame(TEXTS, "id int, text string")
    cut = S.segmenter(d)
    got = [(r.id, r.t) for r in t.select("id", cut("text").alias("t")).collect()]
    assert got == [(1, ["研究", "生命", "起源"]), (2, ["the", "研究生", "生命", "x2_", "研究"]), (3, None), (4, []), (5, []), (6, ["研究"] * 3000), (1, ["生命", "生命"])]
    joined = {r.id: r.tokens for r in S.segmented(t.where("id > 1"), "id", "text", d).collect()}
    assert joined == {i: x or [] for i, x in got if i > 1}
    none = d.where("false")
    assert [r.tokens for r in S.segmented(t.where("id = 2"), "id", "text", none).collect()] == [t.where("id = 2").select(S.segmenter(none)("text")).first()[0]]


def test_both_ways_agree_on_random_texts(spark):
    r = random.Random(7)
    counts = {"".join(r.choice("甲乙丙") for _ in range(r.randint(1, 5))): r.randint(1, 40) for _ in range(30)}
    d = spark.createDataFrame(list(counts.items()), "word string, count int")
    t = spark.createDataFrame([(i, "".join(r.choice("甲乙丙丁a ") for _ in range(r.randint(0, 40)))) for i in range(120)], "id int, text string")
    one = {x.id: x.t for x in t.select("id", S.segmenter(d)("text").alias("t")).collect()}
    assert one == {x.id: x.tokens for x in S.segmented(t, "id", "text", d).collect()}


def test_a_dictionary_too_large_is_refused(spark):
    with pytest.raises(ValueError, match="more than 2 words"):
        S.segmenter(spark.createDataFrame(WORDS, "word string, count int"), rows=2)


def test_search_by_dictionary_words(spark):
    cut = S.segmenter(spark.createDataFrame(WORDS, "word string, count int"))
    docs = spark.createDataFrame([(1, "研究生命起源"), (2, "研究生的生"), (3, "起源")], "id int, text string")
    asked = spark.createDataFrame([(9, "生命")], "q int, text string")
    assert [r.id for r in lexical.search(asked, docs, 5, "q", "text", "id", "text", tokenizer=cut).collect()] == [1]
    # Bigrams also find the pair across the two words of another text.
    assert {r.id for r in lexical.search(spark.createDataFrame([(9, "究生")], "q int, text string"), docs, 5, "q", "text", "id", "text").collect()} == {1, 2}
