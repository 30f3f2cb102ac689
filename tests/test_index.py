"""The stored index beside a search over the texts themselves, through refreshes and removals."""

from __future__ import annotations

import random

import pytest

from threadlake.operators import index as module
from threadlake.operators.index import LexicalIndex
from threadlake.operators.lexical import bm25_top

DOCS = "doc_id bigint, session string, text string, term string, v int"


def rows_of(state):
    return [(i, s, t, "x", 0) for s, docs in state.items() for i, t in docs.items()]


@pytest.mark.parametrize("bucket_rows", [2_000_000, 40])
def test_same_as_the_texts_after_every_refresh(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(module, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]

    def texts(n):
        return {rng.randrange(10**6): rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 12)))]) if rng.random() < 0.2 else " ".join(rng.choices(words, k=9)) for _ in range(n)}

    state = {f"s{i}": texts(rng.randint(1, 6)) for i in range(40)}
    queries = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(1, 3)))) for i in range(25)], "query_id bigint, query string")
    index = LexicalIndex(spark)
    for step in range(4):
        changed = dict(state) if not step else {f"s{i}": texts(3) for i in rng.sample(range(50), 5)}
        gone = [] if not step else [k for k in rng.sample(sorted(state), 2) if k not in changed]
        state |= changed
        for k in gone:
            del state[k]
        removed = spark.createDataFrame([(k,) for k in gone], "session string") if gone else None
        index.refresh(spark.createDataFrame(rows_of(changed), DOCS), "session", "doc_id", "text", removed)
        docs = spark.createDataFrame(rows_of(state), DOCS)
        for how in ({}, {"mode": "any", "by": "session"}):
            want = {tuple(r) for r in bm25_top(docs, queries, "doc_id", "text", 5, digits=9, **how).collect()}
            assert want
            assert {tuple(r) for r in bm25_top(index, queries, "doc_id", "text", 5, digits=9, **how).collect()} == want
        assert index.n_docs == docs.count()
    again = LexicalIndex.open(spark, index.path)
    assert {tuple(r) for r in bm25_top(again, queries, "", "", 5, mode="any", digits=9, by="session").collect()} == want
    assert all(sum(x.rows for x in index.layers[i + 1 :]) < layer.rows for i, layer in enumerate(index.layers[:-1]))


def test_empty(spark):
    index = LexicalIndex(spark)
    index.refresh(spark.createDataFrame([], DOCS), "session", "doc_id", "text")
    q = spark.createDataFrame([(1, "w1")], "query_id bigint, query string")
    assert bm25_top(index, q, "", "", 5).count() == 0
    index.refresh(spark.createDataFrame([(1, None, "w1 w2", "", 0), (2, None, None, "", 0)], DOCS), "session", "doc_id", "text")
    assert [(r.doc_id, r.rk) for r in bm25_top(index, q, "", "", 5).collect()] == [(1, 1)]
    assert bm25_top(index, q.limit(0), "", "", 5).count() == 0


def test_a_search_reads_no_text(spark):
    docs = spark.createDataFrame([(1, "a", "w1 w2", "", 0)], DOCS)
    index = LexicalIndex(spark)
    index.refresh(docs, "session", "doc_id", "text")
    plan = index.found(spark.createDataFrame([("w1",)], "term string"))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
