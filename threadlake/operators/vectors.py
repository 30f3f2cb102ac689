"""Exact cosine neighbours of a stated query set, in blocks.

Rows and queries are dealt into blocks of bounded size; each pair of blocks is one task-sized matrix product that keeps the best k per query, and
a second step keeps the best k over all blocks. No pair of rows is ever written out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators.lexical import top_per_query
from threadlake.session import in_tasks, staged


def knn(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", rows_per_block: int = 8192, queries_per_block: int = 512) -> DataFrame:
    """``query_id, id, distance, rk``: the k rows of least cosine distance to each query (``query_id`` and the vector column).

    Vectors are widened to doubles. Null vectors and vectors of length 0 have no distance and are left out; ties go to the lower id.
    """
    good = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)
    base = rows.where(good).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))
    ask = queries.where(good).select(F.col("query_id").cast("bigint"), F.col(vec_col).alias("q"))
    n_rows, n_queries = base.count(), ask.count()
    r, q = max(1, math.ceil(n_rows / rows_per_block)), max(1, math.ceil(n_queries / queries_per_block))
    left = base.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(r))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    right = ask.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(r - 1).cast("bigint"))))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []}, dtype="float64").astype({"query_id": "int64", "id": "int64"})
        a = a.sort_values("id", ignore_index=True)
        x, y = (np.array(c.tolist(), float) for c in (a["v"], b["q"]))  # widened here, not before the shuffle
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 1 - (y @ x.T) / np.outer(ny, nx)
        d = np.where(np.isfinite(d), d, np.inf)
        best = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), best.shape[1]), "id": a["id"].to_numpy()[best].ravel(), "distance": np.take_along_axis(d, best, 1).ravel()})
        return out[np.isfinite(out["distance"])]

    left, right = in_tasks(left, r * q, "rb", "qb"), in_tasks(right, r * q, "rb", "qb")
    near = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(nearest, "query_id bigint, id bigint, distance double")
    return top_per_query(near, [F.round("distance", 12), F.col("id")], k)


def hashed_embedding(docs: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """A deterministic embedding by feature hashing, for use where no model is at hand: ``id, embedding`` (unit length, or zeros)."""
    from threadlake.operators.lexical import tokens

    terms = docs.select(F.col(id_col).alias("id"), F.explode_outer(tokens(text_col)).alias("t"))
    signed = F.when(F.col("t").isNull(), 0).when(F.xxhash64("t", F.lit(1)) < 0, -1).otherwise(1)
    parts = terms.groupBy("id", F.pmod(F.xxhash64(F.coalesce("t", F.lit(""))), F.lit(dim)).cast("int").alias("d")).agg(F.sum(signed).cast("double").alias("x"))
    cells = parts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return cells.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.col("norm") > 0, F.coalesce(F.col("m")[i], F.lit(0.0)) / F.col("norm")).otherwise(F.lit(0.0)).cast("float")).alias("embedding"))


def stub_embedding(docs: DataFrame, id_col: str, dim: int = 64) -> DataFrame:
    """``id, embedding``: the same unit vector for every row, for tests of what lies around an embedding."""
    return docs.select(F.col(id_col).alias("id"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i == 0, 1.0).otherwise(0.0).cast("float")).alias("embedding"))


def cached_vectors(queries: DataFrame, cache: DataFrame, embed: Callable[[DataFrame, str, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Vectors of searches by way of a cache: (``query_id, embedding, hit`` of every search, the cache with what was missing).

    ``cache`` holds ``query_hash, embedding``, the hash being SHA-256 of the exact text. Only distinct texts without an entry are embedded, by
    ``embed(texts, id column, text column)``; a null text has no vector.
    """
    asked = queries.where("query IS NOT NULL").select("query_id", "query", F.sha2("query", 256).alias("query_hash"))
    missing = asked.select("query_hash", "query").distinct().join(cache.select("query_hash"), "query_hash", "left_anti")
    new = staged(embed(missing, "query_hash", "query").select(F.col("id").alias("query_hash"), "embedding"), "vectors")
    whole = cache.select("query_hash", "embedding", F.lit(True).alias("hit")).unionByName(new.withColumn("hit", F.lit(False)))
    return asked.join(whole, "query_hash").select("query_id", "embedding", "hit"), whole.select("query_hash", "embedding")


def embed_pending(chunks: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """Vectors (``id, embedding``) of the summary chunks (``seq`` -1) that have none; a null text gets none."""
    todo = chunks.where("seq = -1 AND text IS NOT NULL").select("id", "text").distinct().join(vectors.select("id"), "id", "left_anti")
    return embed(todo, "id", "text")
