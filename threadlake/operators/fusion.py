"""Reciprocal-rank fusion of lexical and vector results, best chunk per session, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.operators.index import LexicalIndex
from threadlake.operators.lexical import bm25_top, highlight, query_terms, top_per_query
from threadlake.operators.transcripts import preview
from threadlake.operators.vectors import knn

RRF = 60


def reciprocal(rank: Column | str) -> Column:
    c = F.col(rank) if isinstance(rank, str) else rank
    return F.coalesce(1.0 / (RRF + c), F.lit(0.0))


def fuse(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """``query_id, doc_id, bm25_rk, knn_rk, score`` over both lists (each ``query_id, doc_id`` and its rank)."""
    both = lexical.select("query_id", "doc_id", "bm25_rk").join(vector.select("query_id", "doc_id", "knn_rk"), ["query_id", "doc_id"], "full_outer")
    return both.withColumn("score", reciprocal("bm25_rk") + reciprocal("knn_rk"))


def best_per_group(fused: DataFrame, groups: DataFrame, group_col: str) -> DataFrame:
    """The best document of each group for each query; of equal scores the one first seen (lexical order, then vector order)."""
    placed = fused.join(groups, "doc_id")
    order = F.struct("score", F.coalesce(-F.col("bm25_rk"), F.lit(-(1 << 30))), F.coalesce(-F.col("knn_rk"), F.lit(-(1 << 30))), -F.col("doc_id"))
    best = placed.groupBy("query_id", group_col).agg(F.max_by(F.struct("doc_id", "score"), order).alias("b"))
    return best.select("query_id", group_col, F.col("b.doc_id").alias("doc_id"), F.col("b.score").alias("score"))


def hybrid_search(
    docs: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    keep: DataFrame | None = None,
    prefilter: bool = False,
    compat: bool = True,
    group: str = "project",
    index: LexicalIndex | None = None,
    mode: str = "all",
) -> DataFrame:
    """Hybrid search of a batch: ``query_id, <group>, doc_id, score, place``, the best document of each group.

    ``docs`` has ``doc_id``, the group and ``text``; ``vectors`` ``vec_id, embedding``; ``queries`` ``query_id, query, embedding``. Each side gives 5 k candidates, the
    lexical one from ``index`` if there is one. ``keep`` (``doc_id``) filters after that, as the reference semantics want it, or before with
    ``prefilter`` (then the texts themselves are searched). Documents without a group are left out.
    """
    if keep is not None and prefilter:
        docs, vectors = docs.join(keep, "doc_id", "left_semi"), vectors.join(keep.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left_semi")
    source = docs if index is None or prefilter else index
    lexical = bm25_top(source, queries, "doc_id", "text", 5 * k, mode=mode, compat=compat, digits=9).withColumnRenamed("rk", "bm25_rk")
    vector = knn(vectors, queries, 5 * k).select("query_id", F.col("id").alias("doc_id"), F.col("rk").alias("knn_rk"))
    fused = fuse(lexical, vector)
    if keep is not None and not prefilter:
        fused = fused.join(keep, "doc_id", "left_semi")
    best = best_per_group(fused, docs.where(F.col(group).isNotNull()).select("doc_id", group), group)
    return top_per_query(best, [F.round("score", 12).desc(), F.col("doc_id")], k, "place")


def with_session(found: DataFrame, docs: DataFrame, sessions: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Results by session (``query_id, session_id, doc_id, ...``) with the session's fields and the best document's ``preview``; unknown sessions drop out.

    With ``queries`` (``query_id, query``) also ``snippet``: the surroundings of the terms, null where the document holds none of them.
    """
    fields = [c for c in ("project", "date", "indexed_at", "last_message_at", "title", "summary") if c in sessions.columns]
    rows = found.join(sessions.select(F.col("id").alias("session_id"), *fields), "session_id").join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id", "left")
    rows = rows.withColumn("preview", preview(F.coalesce("_text", F.lit(""))))
    if queries is None:
        return rows.drop("_text")
    terms = query_terms(queries).groupBy("query_id").agg(F.collect_set("term").alias("_terms"))  # terms of one query text
    marked = highlight(rows.join(terms, "query_id", "left"), "_text", "_terms")
    return marked.withColumn("snippet", F.when(F.col("highlighted").contains("<mark>"), F.col("snippet"))).drop("_text", "_terms", "highlighted")
