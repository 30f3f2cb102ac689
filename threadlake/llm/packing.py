"""Filling fixed-capacity containers by vector best-fit.

Items are dealt by hash into shards of bounded size; each shard is packed on its own, largest item first. Every container
has three residual capacities (tokens, documents, attention cost) and an item goes where it fits under all of
them with the smallest weighted residual norm, or the largest weighted dot product. Attention runs over square tiles, so an item
costs the square of its size rounded up to whole tiles. A shard leaves about one container partly empty, so with some hundred containers a shard the
loss is well below one per cent. Only ids and sizes are moved, never texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions.text import utf8_size
from threadlake.session import in_tasks, staged


@dataclass(frozen=True)
class Limits:
    """What a container may hold.

    Defaults follow ``tokens``: tiles of a 64th of it (128 for 8,192), one document a tile and at least 16, and the cost of one item of ``tokens``.
    That cost binds where a long item's last tile is partly empty: what is free in it can't be used by another item.
    """

    tokens: int = 8192
    docs: int = 0
    cost: float = 0.0
    tile: int = 0

    def __post_init__(self):
        tile = self.tile or max(1, self.tokens // 64)
        whole = float(tile * math.ceil(self.tokens / tile)) ** 2
        for name, value in {"tile": tile, "docs": self.docs or max(16, self.tokens // 64), "cost": self.cost or whole}.items():
            object.__setattr__(self, name, value)
        if self.part < 1:
            raise ValueError("the cost limit is below the cost of one tile")

    @property
    def part(self) -> int:
        """The largest item that alone keeps every limit."""
        return min(self.tokens, self.tile * math.floor(math.sqrt(self.cost) / self.tile))

    @property
    def capacity(self) -> tuple[float, float, float]:
        return (self.tokens, self.docs, self.cost)


def best_fit(sizes: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str, tile: int = 1) -> np.ndarray:
    """Container number of each item; ``sizes`` must be in falling order. An item that alone breaks a limit is refused."""
    cap, w = np.array(capacity, float), np.array(weights, float)
    items = np.column_stack([sizes, np.ones(len(sizes)), np.square(tile * np.ceil(sizes / tile), dtype=float)]) / cap
    if (items > 1 + 1e-12).any():
        raise ValueError("an item alone breaks a limit")
    free = np.ones((3, max(16, len(sizes))))
    out, used, first = np.zeros(len(sizes), np.int64), 0, 0
    smallest = items[-1] if len(items) else None
    for i, item in enumerate(items):
        part = free[:, first:used]
        fits = (part >= item[:, None] - 1e-12).all(0)
        where = np.flatnonzero(fits)
        if len(where):
            left = part[:, where]
            score = w @ np.square(left - item[:, None]) if rule == "norm" else -((w * item) @ left)
            k = first + int(where[np.argmin(score)])
        else:
            k, used = used, used + 1
        free[:, k] -= item
        out[i] = k
        while first < used and (free[:, first] < smallest - 1e-12).any():
            first += 1  # full for good
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 8192,
    max_docs: int = 0,
    max_cost: float | None = None,
    tile: int = 0,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
    shard_containers: int = 512,
    shard_items: int = 16_384,
) -> DataFrame:
    """Containers for the texts: ``doc_id, item, part_no, n_parts, size, container``.

    ``capacity``, ``max_docs``, ``max_cost`` and ``tile`` are the ``Limits`` of a container. An item that alone is larger than one is divided:
    full parts first, then a rest that is packed like any other item (``size`` is the part's), so every part alone keeps every limit.
    ``item`` numbers the rows, ``container`` numbers are unique over all shards.

    Defined results: null and empty texts are items of size 0; repeated rows are items of their own; other columns
    are ignored; an empty table gives no rows.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule must be norm or dot")
    limits = Limits(capacity, max_docs, max_cost or 0.0, tile)
    # The row number keeps repeated and null ids from meeting in one shard.
    sized = staged(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), utf8_size(F.col(f"`{text_col}`")).alias("total")).withColumn("item", F.monotonically_increasing_id()), "sizes")
    tokens, items = sized.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    shards = max(1, math.ceil(tokens / (capacity * shard_containers)), math.ceil(items / shard_items))
    parts = (
        sized.withColumn("n_parts", F.greatest(F.lit(1), F.ceil(F.col("total") / limits.part)).cast("int"))
        .withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
        .withColumn("size", F.least(F.lit(limits.part).cast("bigint"), F.col("total") - F.col("part_no").cast("bigint") * limits.part))
        .withColumn("shard", F.pmod(F.xxhash64("item", "doc_id", "part_no", F.lit(17)), F.lit(shards)).cast("int"))
        .select("doc_id", "item", "part_no", "n_parts", "size", "shard")
    )
    # Few bytes, much work: the number of tasks is fixed, or the shards would meet in one.
    return in_tasks(parts, shards, "shard").groupBy("shard").applyInPandas(_shard_packer(limits, weights, rule), "doc_id bigint, item bigint, part_no int, n_parts int, size bigint, container bigint")


def _shard_packer(limits: Limits, weights: tuple, rule: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "item", "part_no"], ascending=[False, True, True], ignore_index=True)
        part["container"] = (int(part["shard"].iat[0]) << 32) + best_fit(part["size"].to_numpy(), limits.capacity, weights, rule, limits.tile)
        return part[["doc_id", "item", "part_no", "n_parts", "size", "container"]]

    return run


def divided(packed: DataFrame) -> DataFrame:
    """``doc_id`` of the items that lie in more than one container."""
    return packed.groupBy("item", "doc_id").agg(F.min("container").alias("lo"), F.max("container").alias("hi")).where("lo != hi").select("doc_id")


def container_report(packed: DataFrame, capacity: int = 8192, tile: int = 0) -> DataFrame:
    """Per container: tokens, items, attention cost and free space."""
    tile = Limits(capacity, tile=tile).tile
    side = F.ceil(F.col("size") / tile) * tile
    return packed.groupBy("container").agg(
        F.sum("size").alias("tokens"), F.count("*").alias("items"), F.sum(side * side).alias("cost"), (F.lit(capacity) - F.sum("size")).alias("free")
    )


def limits_report(packed: DataFrame, limits: Limits) -> DataFrame:
    """``limit_name, largest, allowed`` over all containers: tokens, documents, cost, and the number of containers beside what the tokens need."""
    got = container_report(packed, limits.tokens, limits.tile).agg(
        F.max("tokens").alias("tokens"), F.max("items").alias("docs"), F.max("cost").alias("cost"), F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")
    )
    rows = [("tokens", F.col("tokens"), F.lit(limits.tokens)), ("docs", F.col("docs"), F.lit(limits.docs)), ("cost", F.col("cost"), F.lit(limits.cost)), ("containers", F.col("n"), F.ceil(F.col("total") / limits.tokens))]
    each = F.array(*[F.struct(F.lit(n).alias("limit_name"), x.cast("bigint").alias("largest"), y.cast("bigint").alias("allowed")) for n, x, y in rows])
    return got.select(F.explode(each).alias("x")).select("x.*")
