"""Alignment of two tokenizers against a plain version over all pairs of tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from helpers import ODD, documents, empty
from loomspark.llm import alignment, registry
from tokenizers import Tokenizer


def shown(token):
    """A byte-level entry's bytes, by the library's own decoder where it is plain text, else by the rule of its alphabet."""
    codes, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            codes[chr(b)] = b
        else:
            codes[chr(free)] = b
            free += 1
    return bytes(codes[c] for c in token)


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_tokens(both, text):
    if not text:
        return None
    a, b = both
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [shown(a.id_to_token(i)) for i in ids_a]
    bytes_b = []
    for i in ids_b:
        p = b.id_to_piece(i)
        bytes_b.append(bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None

    def spans(ids, parts):
        at = 0
        for i, p in zip(ids, parts):
            yield i, at, at + len(p)
            at += len(p)

    return list(spans(ids_a, bytes_a)), list(spans(ids_b, bytes_b))


def plain_rows(both, texts):
    made = [plain_tokens(both, t) for t in texts]
    links = [[(x, y) for x, s, e in m[0] for y, f, g in m[1] if s < g and f < e] if m else [] for m in made]
    held = Counter(pair for one in links for pair in set(one))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(n, best.get(x, 0))
    for m, one in zip(made, links):
        if not m:
            yield (0,) * 6 + ("",) + (0,)
            continue
        ends = sorted({e for _, _, e in m[0]} & {e for _, _, e in m[1]})
        groups = [";".join("|".join(",".join(str(i) for i, s, e in side if low < e <= high) for side in m) for low, high in zip([0, *ends], ends))]
        yield (
            len(m[0]), len(m[1]), len(ends), len(one), sum(held[p] == best[p[0]] for p in one), sum(held[p] for p in one),
            hashlib.sha256(groups[0].encode()).hexdigest(), len(groups),
        )


def texts():
    r = random.Random(2)
    some = ["the cat", "the cat sat", "the dog's  cat", "a <|endoftext|> b", "<s>x</s>", "<0x41>", "naïve 日本語 🙂🙂", "▁ mark", "tab\there\n\nlines", " lead", "x" * 300, "1234567", "é", "﻿bom"]
    return some + ["".join(r.choice(["the ", "cat", " ", "é", "🙂", "\n", "12", "sat on", "▁", "ing"]) for _ in range(r.randint(1, 30))) for _ in range(120)]


def test_rows_equal_those_of_all_pairs(spark, both):
    every = [t for _, t in ODD if len(t or "") < 1000] + texts()
    rows = alignment.alignment_table(documents(spark, list(enumerate(every))).repartition(5), ["doc_id", "kept", "keys"]).orderBy("doc_id").collect()
    got = [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]
    want = [w[:7] for w in plain_rows(both, every)]
    assert got == want
    assert any(w[0] for w in want) and sum(w[0] == 0 for w in want) > 3


def test_groups_and_pairs_themselves(spark):
    row = alignment.aligned(documents(spark, [(1, "the cat")]), ["doc_id"]).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert row.pairs == sorted(set(row.pairs)) and sum(row.times) == row.n_links
    assert [(k >> 32, k & 0xFFFFFFFF) for k in row.pairs] == sorted({(int(a), int(b)) for g in row.groups.split(";") for a in g.split("|")[0].split(",") for b in g.split("|")[1].split(",")})


def test_all_odd_rows_and_an_empty_table(spark):
    rows = alignment.alignment_table(documents(spark, ODD), ["doc_id"]).collect()
    assert len(rows) == len(ODD)
    assert max(r.n_a for r in rows) >= 30_000
    assert alignment.alignment_table(empty(spark), ["doc_id"]).collect() == []


def test_counts_by_shards_equal_a_counter(spark):
    r = random.Random(4)
    lists = [sorted({(r.randrange(40) << 32) | min(r.randrange(50), r.randrange(50)) for _ in range(r.randint(0, 60))}) for _ in range(200)] + [None]
    counts = alignment.count_pairs(spark.createDataFrame([(x,) for x in lists], "pairs array<long>").repartition(7), ranges=6)
    want = Counter(k for x in lists if x for k in x)
    keys = np.array(sorted(want), dtype=np.int64)
    assert len(counts.shards) > 1
    assert counts.lookup(keys).tolist() == [want[k] for k in keys.tolist()]
    assert counts.lookup(np.array([5, 7 << 40], dtype=np.int64)).tolist() == [want.get(5, 0), 0]
    found, best = counts.of(np.array([*keys[::-1], 99 << 33], dtype=np.int64))
    top = {}
    for k, n in want.items():
        top[k >> 32] = max(n, top.get(k >> 32, 0))
    assert best.tolist() == [want[k] == top[k >> 32] for k in keys[::-1].tolist()] + [False]


def test_run_lengths_and_partial_counts_over_batches():
    def batch(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])

    parts = [batch([1, 1, 2], [1, 2, 3]), batch([], []), batch([2], [1]), batch([2, 3], [5, 1]), batch([3], [1])]
    assert [(int(k), int(n)) for ks, ns in alignment._run_lengths(iter(parts)) for k, n in zip(ks, ns)] == [(1, 3), (2, 9), (3, 2)]
    lists = [pa.RecordBatch.from_arrays([pa.array([[1, 2], [2], []], pa.list_(pa.int64()))], ["p"]) for _ in range(5)]
    for hold in (1, 4, 100):
        total = Counter()
        for b in alignment._counted(iter(lists), hold):
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] += n
        assert total == {1: 5, 2: 10}


def test_query(spark, both):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in registry.QUERIES["op12_alignment"](spark, d).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    for i in [k for k, t in docs.items() if len(t or "") < 600]:
        m = plain_tokens(both, docs[i])
        assert (rows[i].n_a, rows[i].n_b) == ((len(m[0]), len(m[1])) if m else (0, 0))
        assert rows[i].n_links == (sum(s < g and f < e for _, s, e in m[0] for _, f, g in m[1]) if m else 0)


def test_both_libraries_give_the_same_ids():
    pair = alignment.tokenizers_of()
    assert pair.merging is not None
    r = random.Random(6)
    odd = [" ", "  ", "   ", "\n", " \n", "\n ", "\t", "\u00a0", "\x1c", "\x85", "\x00", "'s", " 's", "don't", "é", "ǅ", "²", "<s>", "<|endoftext|>", "12", "_", "--", "a", "The", "ing", "word", "ß", "\xad", "x" * 1999, "x" * 2001, " " * 499, " " * 501]
    for _ in range(3000):
        text = "".join(r.choice(odd) for _ in range(r.randint(1, 12)))
        assert pair.encode_bytes(text) == pair.tokenizer.encode(text, add_special_tokens=False).ids, text
    for c in range(0x250):
        text = f"a{chr(c)}b 1{chr(c)}{chr(c)} {chr(c)}"
        assert pair.encode_bytes(text) == pair.tokenizer.encode(text, add_special_tokens=False).ids, text
