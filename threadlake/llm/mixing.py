"""Mixing sources to target shares with a cap on repeats.

The total is divided into blocks of equal tokens. Sainte-Laguë apportionment (highest quotients w / (2 s + 1)) gives each
source an integer number of blocks, capped at what it can supply, and then, within a source, each shard its quota. A
shard lays its documents out in seeded order and gives its quota of blocks from there: whole rounds first, then a
seeded run of single blocks. Documents are never divided; one belongs to the block in which it begins.

A source that can't fill its share leaves a choice. With ``hold="targets"`` the total shrinks until every share can be filled, so the shares hold; with
``hold="total"`` the total stays and the other sources fill it up by the same quotients, so their shares grow.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import folded, utf8_size
from threadlake.session import staged


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients w / (2 s + 1), each at most its cap; ties go to the earlier entry.

    With a divisor d an entry holds as many seats as it has quotients of at least d; d is found by bisection, then the last few
    seats are dealt one by one, so the cost doesn't depend on the number of seats.
    """
    w = np.asarray(weights, float)
    top = np.full(len(w), seats, np.int64) if caps is None else np.minimum(np.asarray(caps, np.int64), seats)
    top = np.where(w > 0, top, 0)
    seats = int(min(seats, top.sum()))
    held = np.zeros(len(w), np.int64)
    if seats <= 0:
        return held

    def at(d: float) -> np.ndarray:
        return np.minimum(top, np.floor(np.minimum((w / d + 1) / 2, 2.0**62)).astype(np.int64))

    lo, hi = float(w[w > 0].min()) / (2 * seats + 3), float(w.max()) * 2  # all seats and more .. none
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        if at(mid).sum() > seats:
            lo = mid
        else:
            hi = mid
    held = at(hi)
    while held.sum() < seats:
        quotient = np.where(held < top, w / (2 * held + 1), -1.0)
        held[int(np.argmax(quotient))] += 1
    return held


def may_be_short(weights: np.ndarray, fair: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Which entries the apportionment leaves open to be short of their share, given their uncapped seats and their caps in seats.

    By the quotients an entry of n, with a share s of all weights, has more than s * (seats - n / 2) - 1 / 2 of its seats uncapped. So if its supply
    is below s of the whole, its cap, rounded up, is less than (n + 5) / 2 seats above its uncapped seats; comparing capped with uncapped seats alone
    would miss some, as an entry also gains the seats that others can't fill. ``weights`` are per cents; where they
    sum to more than 100 the bound grows with them.
    """
    w = np.asarray(weights, float)
    return (w > 0) & (caps <= max(1.0, w[w > 0].sum() / 100) * (fair + (len(w) + 5) / 2) + 1)


def _sources(docs: DataFrame, id_col: str, text_col: str, source_col: str, shards: int) -> DataFrame:
    """One row per document: source, id, size and shard."""
    return docs.select(
        folded(F.col(f"`{source_col}`")).alias("source"),
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        utf8_size(F.col(f"`{text_col}`")).alias("size"),
    ).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards)).cast("int"))


class Mixture:
    """Quotas, report and selection of the mixes in ``targets`` (``mix_name, source, target_pct, max_repeats``).

    ``size_of`` a mix is the sum of its sources' sizes unless ``total_tokens`` is given. ``report`` needs one pass over the
    documents; ``selection`` moves ids and sizes only. ``block_tokens`` is the largest block; a mix takes a ``BLOCKS_A_SOURCE``-th of its smallest
    quota where that is less. Sources without any document have no share that could hold: the others keep theirs in proportion.

    Defined results: sources are compared in lower case without outer white space; documents without a source, or of one that
    no mix names, are in no mix; null and empty texts have size 0; a target row that occurs twice counts once; a source without
    documents gets no block and is short; a source that can't fill its share gives all it may.
    """

    #: Blocks that the smallest quota of a mix has at least, as far as its tokens go.
    BLOCKS_A_SOURCE = 64

    def __init__(
        self,
        docs: DataFrame,
        targets: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
        block_tokens: int = 16_384,
        shard_docs: int = 200_000,
        total_tokens: int | None = None,
        seed: int = 11,
        hold: str = "targets",
    ):
        if hold not in ("targets", "total"):
            raise ValueError("hold must be targets or total")
        self.block, self.seed, self.total_tokens, self.hold = block_tokens, seed, total_tokens, hold
        self.targets = targets.select("mix_name", folded("source").alias("source"), F.col("target_pct").cast("bigint"), F.col("max_repeats").cast("bigint")).distinct()
        wanted = self.targets.where(F.col("source").isNotNull()).select("source").distinct()
        sized = _sources(docs, id_col, text_col, source_col, 1).drop("shard").join(wanted, "source", "left_semi")
        self.sized = staged(sized, "mix-sizes")
        self.shards = max(1, math.ceil(self.sized.count() / shard_docs))
        self.sized = self.sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(self.shards)).cast("int"))

    def report(self) -> DataFrame:
        """Per mix and source: what it has, what it may give, its blocks, and whether it is short of its share."""
        have = self.sized.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("n_docs"))
        total = F.lit(self.total_tokens) if self.total_tokens is not None else F.sum("tokens").over(Window.partitionBy("mix_name"))
        rows = (
            self.targets.join(have, "source", "left")
            .fillna(0, ["tokens", "n_docs"])
            .withColumn("mix_tokens", total.cast("bigint"))
            .withColumn("supply", F.col("tokens") * F.col("max_repeats"))
        )
        block, names = self.block, rows.columns

        def quotas(mix: pd.DataFrame) -> pd.DataFrame:
            mix = mix.sort_values(["source"], ignore_index=True)
            seats = int(mix["mix_tokens"].iat[0]) // block
            caps = (-(-mix["supply"] // block)).to_numpy()
            weight = mix["target_pct"].to_numpy(float)
            mix["fair_blocks"] = sainte_lague(weight, seats)
            mix["blocks"] = sainte_lague(weight, seats, caps)
            mix["open"] = may_be_short(weight, mix["fair_blocks"].to_numpy(), caps)
            return mix[[*names, "fair_blocks", "blocks", "open"]]

        dealt = rows.groupBy("mix_name").applyInPandas(quotas, rows.schema.simpleString()[7:-1] + ", fair_blocks bigint, blocks bigint, open boolean")
        # Blocks are rounded: those that the apportionment leaves open are settled in whole numbers.
        return dealt.withColumn("short", F.col("open") & (F.col("supply") * 100 < F.col("target_pct") * F.col("mix_tokens")))

    def quotas(self) -> DataFrame:
        """The report with what the selection aims at: ``aim`` tokens, ``block`` size of the mix, ``blocks`` of the source, ``all`` if it gives all it may."""
        report, most, least, held = self.report().drop("blocks", "fair_blocks", "open"), self.block, self.BLOCKS_A_SOURCE, self.hold

        def deal(mix: pd.DataFrame) -> pd.DataFrame:
            mix = mix.sort_values(["source"], ignore_index=True)
            supply, total = mix["supply"].to_numpy(float), float(mix["mix_tokens"].iat[0])
            weight = np.where(supply > 0, mix["target_pct"].to_numpy(float), 0.0)
            share = weight / max(weight.sum(), 1.0)
            used = share > 0
            if held == "targets" and used.any():
                total = min(total, float((supply[used] / share[used]).min()))
            mix["aim"] = np.floor(share * total).astype(np.int64)
            block = int(max(1, min(most, (share[used] * total).min() // least))) if used.any() else most
            mix["block"] = block
            caps = -(-mix["supply"].to_numpy() // block)
            mix["blocks"] = sainte_lague(weight, int(total) // block, caps)
            mix["all"] = used & (mix["blocks"].to_numpy() >= supply // block)
            return mix

        return report.groupBy("mix_name").applyInPandas(deal, report.schema.simpleString()[7:-1].replace(",", ", ") + ", aim bigint, block bigint, blocks bigint, all boolean")

    def selection(self) -> DataFrame:
        """``mix_name, source, doc_id, size, n_copies`` of every document that is used, 1 to ``max_repeats`` times."""
        seed = self.seed
        w = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        laid = self.sized.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
        shards = self.sized.groupBy("source", "shard").agg(F.sum("size").alias("shard_tokens"))
        quotas = self.quotas().where("blocks > 0 OR all").select("mix_name", "source", "max_repeats", "all", "block", "blocks").join(shards, "source")

        def deal(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("shard", ignore_index=True)
            n_blocks = np.maximum(1, -(-rows["shard_tokens"].to_numpy() // int(rows["block"].iat[0])))
            most = int(rows["max_repeats"].iat[0])
            rows["n_blocks"] = n_blocks
            rows["quota"] = n_blocks * most if bool(rows["all"].iat[0]) else sainte_lague(rows["shard_tokens"].to_numpy(), int(rows["blocks"].iat[0]), n_blocks * most)
            return rows[["mix_name", "source", "shard", "block", "n_blocks", "quota"]]

        dealt = quotas.groupBy("mix_name", "source").applyInPandas(deal, "mix_name string, source string, shard int, block bigint, n_blocks bigint, quota bigint")
        picked = laid.join(dealt, ["source", "shard"])
        # The seeded run of single blocks begins at another block in each mix.
        at = F.floor(F.col("before") / F.col("block"))
        place = F.pmod(at - F.pmod(F.xxhash64("mix_name", "source", "shard", F.lit(seed)), F.col("n_blocks")), F.col("n_blocks"))
        copies = F.floor(F.col("quota") / F.col("n_blocks")) + (place < F.pmod("quota", "n_blocks")).cast("bigint")
        return picked.withColumn("n_copies", copies).where("n_copies > 0").select("mix_name", "source", "doc_id", "size", "n_copies")

    def shares(self) -> DataFrame:
        """The real share of each source in the selection beside its target."""
        used = self.selection().groupBy("mix_name", "source").agg(
            F.sum(F.col("size") * F.col("n_copies")).alias("used_tokens"), F.max("n_copies").alias("most_copies")
        )
        got = self.quotas().join(used, ["mix_name", "source"], "left").fillna(0, ["used_tokens", "most_copies"])
        whole = F.sum("used_tokens").over(Window.partitionBy("mix_name"))
        return got.select(
            "mix_name", "source", "target_pct", "max_repeats", "tokens", "aim", "used_tokens", "most_copies", "short",
            F.when(whole > 0, F.round(100 * F.col("used_tokens") / whole, 4)).alias("actual_pct"),
        )

    def deviations(self) -> DataFrame:
        """``shares`` with ``off_tokens``, how far a source is from its aim, and ``allowed_off``: two of its largest documents and a block for each shard.

        A run of blocks takes the documents that begin in it, so it may be over by the document it ends in and short by the one it begins in.
        """
        largest = self.sized.groupBy("source").agg(F.max("size").alias("largest"), F.count_distinct("shard").alias("n_shards"))
        blocks = self.quotas().select("mix_name", "source", "block")
        got = self.shares().join(largest, "source", "left").join(blocks, ["mix_name", "source"]).fillna(0, ["largest", "n_shards"])
        return got.withColumn("off_tokens", F.abs(F.col("used_tokens") - F.col("aim"))).withColumn("allowed_off", F.col("n_shards") * F.col("max_repeats") * (2 * F.col("largest") + F.col("block"))).drop("largest", "n_shards", "block")
