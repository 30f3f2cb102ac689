"""The best matches by blocks beside a plain loop; nulls, ties, repeats, empty tables."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadlake.operators import lexical

WORDS = [f"w{i}" for i in range(30)]


def brute(docs, queries, mode, k, banned=()):
    cut = {d: Counter((t or "").split()) for d, t in docs}
    n, avg = len(docs), sum(1 + sum(c.values()) for c in cut.values()) / len(docs)
    df = Counter(w for c in cut.values() for w in c)
    out = {}
    for q, text in queries:
        want, scores = Counter((text or "").split()), []
        for d, c in cut.items():
            have = [w for w in want if c[w]]
            if not have or mode == "all" and len(have) < len(want) or any(c[w] for w in banned):
                continue
            s = 0.0
            for w in have:
                idf = math.log((n - df[w] + 0.5) / (df[w] + 0.5))
                dl = 1 + sum(c.values())
                s += want[w] * (idf if idf > 0 else 1e-6) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * dl / avg))
            scores.append((round(-s, 9), d))
        out[q] = sorted(scores)[:k]
    return out


@pytest.fixture(scope="module")
def world():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(WORDS, weights=range(30, 0, -1), k=rnd.randint(1, 25))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate([*texts, texts[0], texts[0], "", None, "w1 " * 20_000])]
    queries = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 4)))) for i in range(40)] + [(40, ""), (41, None), (42, "unheard of"), (43, "w1 w1 w2"), (44, "w1 w1 w2")]
    return docs, queries


@pytest.mark.parametrize("mode", ["all", "any"])
def test_best_of_blocks(spark, world, mode):
    docs, queries = world
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("term", F.lit("x")).withColumn("rank", F.lit(1))
    q = spark.createDataFrame(queries, "query_id bigint, query string").withColumn("ask", F.lit("x"))
    want = {(q, d, r) for q, found in brute(docs, queries, mode, 5).items() for r, d in found}
    for size in (200_000, 300):  # one block and many
        rows = lexical.bm25_top(d, q, "doc_id", "text", 5, mode=mode, digits=9, postings_per_block=size, terms_per_block=size // 10).collect()
        assert {(r.query_id, r.doc_id, round(r["rank"], 9)) for r in rows} == want
    full = lexical.bm25(d, q, "doc_id", "text", mode=mode).collect()
    assert {(r.query_id, r.doc_id) for r in full} == {(q, d) for q, found in brute(docs, queries, mode, 1000).items() for _, d in found}


def test_excluded_terms_and_groups(spark, world):
    docs, queries = world
    d = spark.createDataFrame([(i, t, f"s{i % 7}") for i, t in docs], "doc_id bigint, text string, grp string")
    q = spark.createDataFrame(queries, "query_id bigint, query string")
    rows = lexical.bm25_top(d, q, "doc_id", "text", 5, digits=9, exclude=q.select("query_id", F.lit("w3").alias("term"))).collect()
    assert {(r.query_id, r.doc_id) for r in rows} == {(q, d) for q, found in brute(docs, queries, "all", 5, ("w3",)).items() for _, d in found}
    want = set()
    for q_id, found in brute(docs, queries, "any", 1000).items():
        best = {}
        for r, doc in found:
            best[f"s{doc % 7}"] = min(r, best.get(f"s{doc % 7}", 0))
        want |= {(q_id, g, r) for r, g in sorted((r, g) for g, r in best.items())[:3]}
    rows = lexical.bm25_top(d, q, "doc_id", "text", 3, mode="any", digits=9, by="grp", postings_per_block=300).collect()
    assert {(r.query_id, r.grp, round(r["rank"], 9)) for r in rows} == want


def test_many_terms_join_by_shuffle(spark, world, monkeypatch):
    docs, queries = world
    monkeypatch.setattr(lexical, "MAX_BROADCAST_TERMS", 0)
    rows = lexical.bm25_top(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, query string"), "doc_id", "text", 5, digits=9).collect()
    assert {(r.query_id, r.doc_id) for r in rows} == {(q, d) for q, found in brute(docs, queries, "all", 5).items() for _, d in found}


def test_empty_tables(spark, world):
    docs, queries = world
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, query string")
    assert lexical.bm25_top(d.limit(0), q, "doc_id", "text", 5).count() == 0
    assert lexical.bm25_top(d, q.limit(0), "doc_id", "text", 5).count() == 0


def test_snippets():
    assert lexical.snippet("x" * 500, {"hit"}) == "x" * 300
    assert lexical.snippet(None, {"hit"}) is None
    assert lexical.snippet("", {"hit"}) == ""
    one = lexical.snippet("a" * 200 + " hit " + "b" * 200, {"hit"})
    assert one == "…" + "a" * 149 + " <mark>hit</mark> " + "b" * 149 + "…"
    two = lexical.snippet("hit " + "b" * 500 + " Hit.", {"hit"})
    assert two == "<mark>hit</mark> " + "b" * 149 + "…" + lexical.GAP + "…" + "b" * 149 + " <mark>Hit</mark>."
    near = lexical.snippet("hit " + "b" * 250 + " hit", {"hit"})
    assert near == "<mark>hit</mark> " + "b" * 250 + " <mark>hit</mark>"
    assert lexical.snippet("a <b>hit</b> " * 3, {"hit"}).count("<b><mark>hit</mark></b>") == 3  # markup of the text itself is left alone
    assert lexical.mark_terms("Café, cafe", {"cafe"}) == "<mark>Café</mark>, <mark>cafe</mark>"


GRAMMAR = {
    "w1 AND w2": [({"w1", "w2"}, set())], "w1 w2": [({"w1", "w2"}, set())], "w1 OR w2": [({"w1"}, set()), ({"w2"}, set())], "w1 w2 OR w3 NOT w1": [({"w1", "w2"}, set()), ({"w3"}, {"w1"})],
    "w1 NOT w2 NOT w3": [({"w1"}, {"w2", "w3"})], "w1 or w2": [({"w1", "or", "w2"}, set())], "ORDER w1": [({"order", "w1"}, set())],
    "AND w1": [], "w1 OR": [], "NOT w1": [], "AND": [], "w1 AND OR w2": [], "w1 AND NOT w2": [], "w1-w2": [], "don't": [], "": [], "w1 NOT w1": [({"w1"}, {"w1"})],
}


def test_query_grammar(spark, world):
    docs, _ = world
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    texts = list(GRAMMAR)
    q = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")
    got = {}
    for r in lexical.bm25_top(d, q, "doc_id", "text", 1000, mode="grammar", postings_per_block=300).collect():
        got.setdefault(texts[r.query_id], set()).add(r.doc_id)
    for text, clauses in GRAMMAR.items():
        want = {i for i, t in docs if any(yes <= set((t or "").split()) and not no & set((t or "").split()) for yes, no in clauses)}
        assert got.get(text, set()) == want, text
