"""The pipeline's near-dedup stage on tables with repeated or missing ids."""

from __future__ import annotations

import corpus_pipeline
from helpers import documents, words


def test_one_row_of_each_group(spark, tmp_path):
    body = [" ".join(words(150, s)) for s in range(6)]
    close = lambda s: body[s].replace(body[s].split()[5], "changed", 1)
    texts = [(1, body[0]), (1, body[0]), (2, close(0)), (None, body[0]), (3, body[1]), (3, close(1)), (None, body[2]), (None, body[2]), (None, close(2)), (4, body[3]), (None, close(3)), (5, body[4]), (5, body[5])]
    rows = corpus_pipeline.near_dedup(spark, documents(spark, texts), str(tmp_path)).collect()
    got = sorted((r.doc_id or 0, next(i for i in range(6) if r.text in (body[i], close(i)))) for r in rows)
    assert got == [(0, 2), (1, 0), (3, 1), (4, 3), (5, 4), (5, 5)]
    plain = documents(spark, [(1, body[0]), (2, close(0)), (3, body[1])])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, plain, str(tmp_path)).collect()) == [1, 3]
