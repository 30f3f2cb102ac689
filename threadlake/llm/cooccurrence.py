"""Items that appear together, kept as an incremental pair table.

Changed baskets are compared with what is stored of them; each emits signed deltas for its items (marginals) and for the pairs of a changed item
with all items of the basket. Deltas are summed map-side and appended as hash-bucketed layers of signed counts; a layer is merged into the one
before when it has grown to its size, so a batch writes about its own deltas and a count is written again only a logarithmic number of
times. Counts are the sums over the few layers there are. Associations follow from counts and marginals when they are read, for all pairs or for those
that the last batch affected.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from threadlake.functions.text import folded
from threadlake.session import in_tasks, new_path, staged

#: Items of a basket whose pairs one row expands to at a time; larger baskets are cut into squares of this side.
SIDE = 256
#: Rows of a layer that lie in one bucket.
BUCKET_ROWS = 1_000_000
#: Marginals that are broadcast when associations are read; beyond that Spark joins by shuffle and splits skewed items (their pairs are the large side).
MAX_BROADCAST_ITEMS = 500_000


def baskets_of(rows: DataFrame, id_col: str, kinds: dict[str, str]) -> DataFrame:
    """``id, kind, items`` from array columns (kind -> column): lower case, outer blanks off, blank ones dropped, each once.

    A basket without items stays, with an empty array, so that its removal is noticed.
    """
    def clean(col: str):
        return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(F.col(f"`{col}`"), F.array().cast("array<string>")), folded), lambda x: x.isNotNull() & (x != ""))))

    kind = F.array(*[F.struct(F.lit(k).alias("kind"), clean(c).alias("items")) for k, c in kinds.items()])
    return rows.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.explode(kind).alias("x")).select("id", "x.kind", "x.items")


def _signed_pairs(changed: DataFrame, salt_from: int = SIDE) -> DataFrame:
    """Signed pair deltas of changed baskets (``kind, old, new``), summed: ``kind, item_a, item_b, delta``.

    Only pairs of which an item came or went carry a sign, so only these are expanded: changed items with all items.
    """
    marks = F.transform(
        F.array_sort(F.array_union("old", "new")),
        lambda x: F.struct(x.alias("item"), F.array_contains("old", x).cast("int").alias("o"), F.array_contains("new", x).cast("int").alias("n")),
    )
    marked = changed.select("kind", marks.alias("m")).withColumn("c", F.filter("m", lambda x: x["o"] != x["n"])).where(F.size("c") > 0)
    large = F.size("c").cast("bigint") * F.size("m") > salt_from * salt_from
    small = marked.where(~large).select("kind", F.col("c").alias("left"), F.col("m").alias("right"))
    # A huge basket becomes squares (block of items x block of items), spread over the cluster before pairs come out.
    squares = (
        marked.where(large)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.ceil(F.size("c") / salt_from).cast("int") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.ceil(F.size("m") / salt_from).cast("int") - 1)))
        .select("kind", *[F.slice(of, F.col(x) * salt_from + 1, F.lit(salt_from)).alias(side) for of, x, side in (("c", "i", "left"), ("m", "j", "right"))])
        .repartition(F.rand(3))
    )
    sign = F.col("a.n") * F.col("b.n") - F.col("a.o") * F.col("b.o")
    once = (F.col("a.item") < F.col("b.item")) | (F.col("a.item") != F.col("b.item")) & (F.col("b.o") == F.col("b.n"))
    return (
        small.unionByName(squares)
        .withColumn("a", F.explode("left"))
        .withColumn("b", F.explode("right"))
        .where(once)
        .select("kind", F.least("a.item", "b.item").alias("item_a"), F.greatest("a.item", "b.item").alias("item_b"), sign.cast("bigint").alias("delta"))
        .where("delta != 0")
        .groupBy("kind", "item_a", "item_b")
        .agg(F.sum("delta").alias("delta"))
        .where("delta != 0")
    )


@dataclass(frozen=True)
class Layer:
    """Rows of a table that were written together, in ``buckets`` folders by the hash of their key."""

    name: str
    version: int
    rows: int
    buckets: int


class PairTable:
    """Persistent pair counts below ``path``: baskets, marginals and pairs, each a few layers of hash buckets.

    Each ``apply`` appends a layer of each and then a new manifest (layers, totals), which is held here and beside the data; a failed ``apply`` leaves the
    table as it was and may be repeated. ``open`` takes up a table where its last manifest left it, ``vacuum`` removes layers that
    no manifest needs any more. A layer has a bucket for each ``bucket_rows`` rows, unless ``buckets`` fixes their number. One writer at a time.
    """

    KEYS = {"baskets": ["id", "kind"], "marginals": ["kind", "item"], "pairs": ["kind", "item_a", "item_b"]}
    SCHEMAS = {
        "baskets": "id string, kind string, items array<string>, no bigint",
        "marginals": "kind string, item string, n bigint",
        "pairs": "kind string, item_a string, item_b string, n bigint",
    }
    MANIFEST = "name string, version int, rows bigint, buckets int, kind string, total bigint"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.buckets, self.bucket_rows = spark, buckets, bucket_rows
        self.path = path or new_path(spark, "pairs")
        self.layers: dict[str, list[Layer]] = {name: [] for name in self.SCHEMAS}
        self.totals: dict[str, int] = {}
        self.version = 0
        self.last: tuple[DataFrame, DataFrame] | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PairTable:
        """The table below ``path`` as of its newest manifest; raises where there is none."""
        every = spark.read.schema(f"{cls.MANIFEST}, v int").json(f"{path}/manifest")
        rows = every.where(F.col("v") == every.agg(F.max("v")).first()[0]).collect()  # a row per layer and kind
        table = cls(spark, path)
        for r in sorted(rows, key=lambda r: r.version or 0):
            table.version = r.v
            if r.name:
                table.layers[r.name].append(Layer(r.name, r.version, r.rows, r.buckets))
            elif r.kind is not None:
                table.totals[r.kind] = r.total
        return table

    def _save(self) -> None:
        rows = [{"name": x.name, "version": x.version, "rows": x.rows, "buckets": x.buckets} for some in self.layers.values() for x in some]
        rows += [{"kind": kind, "total": n} for kind, n in self.totals.items()] or [{}]
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/v={self.version}/layers.json")
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray("\n".join(map(json.dumps, rows)), "utf-8"))
        out.close()

    def _at(self, layer: Layer) -> str:
        return f"{self.path}/{layer.name}/v={layer.version}"

    def _bucket(self, name: str, buckets: int):
        return F.pmod(F.xxhash64(*self.KEYS[name]), F.lit(buckets)).cast("int")

    def _layer(self, layer: Layer) -> DataFrame:
        return self.spark.read.schema(f"{self.SCHEMAS[layer.name]}, part int").parquet(self._at(layer))

    def _write(self, name: str, rows: DataFrame, version: int, expected: int) -> Layer:
        """``rows`` as a layer; ``expected`` rows, or fewer, decide on its buckets."""
        buckets = self.buckets or max(1, math.ceil(expected / self.bucket_rows))
        layer = Layer(name, version, 0, buckets)
        in_tasks(rows.withColumn("part", self._bucket(name, buckets)), buckets, "part").write.mode("overwrite").partitionBy("part").parquet(self._at(layer))
        return Layer(name, version, self._layer(layer).count(), buckets)

    def _summed(self, name: str, layers: list[Layer], more: DataFrame | None = None) -> DataFrame:
        """One row per key over some layers, and more rows: the newest state of a basket, the sum of counts."""
        keys = self.KEYS[name]
        parts = [*[self._layer(layer).drop("part") for layer in layers], *([more] if more is not None else [])]
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        rows = reduce(DataFrame.unionByName, parts)
        if len(parts) == 1:
            return rows
        if name == "baskets":
            return rows.groupBy(*keys).agg(F.max_by("items", "no").alias("items"), F.max("no").alias("no"))
        return rows.groupBy(*keys).agg(F.sum("n").alias("n")).where("n != 0")

    def _append(self, name: str, rows: DataFrame, version: int, expected: int) -> list[Layer]:
        """The layers of a table with ``rows`` added: as one of their own, or merged with those before that aren't larger than what follows."""
        some = self.layers[name]
        first, size = len(some), expected
        while first > 0 and size >= some[first - 1].rows:
            first -= 1
            size += some[first].rows
        if first < len(some):
            rows = self._summed(name, some[first:], rows)
        if not first and name == "baskets":
            rows = rows.where(F.size("items") > 0)  # nothing older that a removal must hide
        new = self._write(name, rows, version, size)
        return [*some[:first], *([new] if new.rows else [])]

    def _stored(self, changed: DataFrame) -> DataFrame:
        """``id, kind, items, no`` of the changed baskets, from their buckets only."""
        found = self.spark.createDataFrame([], self.SCHEMAS["baskets"])
        for layer in self.layers["baskets"]:
            rows = self._layer(layer)
            if layer.buckets > 1:
                touched = [r[0] for r in changed.select(self._bucket("baskets", layer.buckets)).distinct().collect()]  # at most as many as buckets
                rows = rows.where(F.col("part").isin(touched))
            found = found.unionByName(rows.drop("part"))
        return found

    def apply(self, changed: DataFrame) -> None:
        """Take in the present state of changed baskets (``id, kind, items``; an empty array removes one).

        Of several rows for a basket in one batch, their items are united. A batch that changes nothing writes nothing.
        """
        none = F.array().cast("array<string>")
        new = changed.groupBy("id", "kind").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("new"))
        if self.layers["baskets"]:
            new = staged(new, "changed")
            old = self._stored(new).join(new.select(F.col("id").alias("i"), F.col("kind").alias("k")), F.col("id").eqNullSafe(F.col("i")) & (F.col("kind") == F.col("k")), "left_semi")
            old = old.groupBy("id", "kind").agg(F.max_by("items", "no").alias("old")).select(F.col("id").alias("i"), F.col("kind").alias("k"), "old")
            new = new.join(old, F.col("id").eqNullSafe(F.col("i")) & (F.col("kind") == F.col("k")), "left").select("id", "kind", "new", F.coalesce("old", none).alias("old"))
        else:
            new = new.withColumn("old", none)
        delta = staged(new.where("old != new"), "delta")
        gone, come = F.array_except("old", "new"), F.array_except("new", "old")
        moved = (F.size(gone) + F.size(come)).cast("bigint")
        per_kind = delta.groupBy("kind").agg(
            F.count("*").alias("n"), F.sum((F.size("new") > 0).cast("int") - (F.size("old") > 0).cast("int")).alias("d"),
            F.sum(moved).alias("items"), F.sum(moved * F.size(F.array_union("old", "new"))).alias("pairs"),
        ).collect()  # a row per kind
        if not per_kind:
            if not self.version:
                self._save()
            return
        at = self.version + 1
        signed = delta.select("kind", F.explode(come).alias("item"), F.lit(1).alias("d")).unionByName(delta.select("kind", F.explode(gone).alias("item"), F.lit(-1).alias("d")))
        d_items = signed.groupBy("kind", "item").agg(F.sum("d").alias("n")).where("n != 0")
        d_pairs = _signed_pairs(delta).withColumnRenamed("delta", "n")
        work = [
            ("pairs", d_pairs, at, sum(r.pairs for r in per_kind)),
            ("marginals", d_items, at, sum(r["items"] for r in per_kind)),
            ("baskets", delta.select("id", "kind", F.col("new").alias("items"), F.lit(at).cast("bigint").alias("no")), at, sum(r.n for r in per_kind)),
        ]
        with ThreadPoolExecutor(len(work)) as pool:  # three independent jobs
            done = [pool.submit(inheritable_thread_target(self.spark)(self._append), *x) for x in work]
            self.layers = {x[0]: d.result() for x, d in zip(work, done, strict=True)}
        self.last = (d_items.select("kind", "item"), d_pairs.select("kind", "item_a", "item_b"))
        for r in per_kind:
            self.totals[r.kind] = self.totals.get(r.kind, 0) + r.d
        self.version = at
        self._save()

    def _scored(self, counts: DataFrame) -> DataFrame:
        total = F.lit(None).cast("bigint")
        for kind, n in sorted(self.totals.items()):  # a handful of kinds
            total = F.when(F.col("kind") == kind, F.lit(n).cast("bigint")).otherwise(total)
        n = self._summed("marginals", self.layers["marginals"])
        if sum(x.rows for x in self.layers["marginals"]) <= MAX_BROADCAST_ITEMS:
            n = F.broadcast(n)
        for x in "ab":
            counts = counts.join(n.select("kind", F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}")), ["kind", f"item_{x}"])
        lift = F.col("n_ab") * total / (F.col("n_a").cast("double") * F.col("n_b"))
        return counts.select("kind", "item_a", "item_b", "n_ab", "n_a", "n_b", total.alias("n_baskets"), lift.alias("lift"))

    def pairs(self) -> DataFrame:
        """``kind, item_a, item_b, n_ab, n_a, n_b, n_baskets, lift`` of every pair that occurs."""
        return self._scored(self._summed("pairs", self.layers["pairs"]).withColumnRenamed("n", "n_ab"))

    def affected(self) -> DataFrame:
        """The same of the pairs that the last batch of this object changed, or of which it changed an item's count; pairs that went are left out."""
        counts = self._summed("pairs", self.layers["pairs"]).withColumnRenamed("n", "n_ab")
        if self.last is None:
            return self._scored(counts).limit(0)
        items, pairs = self.last
        found = pairs
        for x in "ab":
            found = found.unionByName(counts.join(items.withColumnRenamed("item", f"item_{x}"), ["kind", f"item_{x}"], "left_semi").select("kind", "item_a", "item_b"))
        return self._scored(counts.join(found, ["kind", "item_a", "item_b"], "left_semi"))

    def vacuum(self) -> None:
        """Remove layers and manifests that the newest manifest doesn't need; readers of older ones must have ended."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        needed = {self._at(x) for some in self.layers.values() for x in some} | {f"{self.path}/manifest/v={self.version}"}
        for name in [*self.SCHEMAS, "manifest"]:
            root = fs.Path(f"{self.path}/{name}")
            at = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for found in at.listStatus(root) if at.exists(root) else ():
                if f"{self.path}/{name}/{found.getPath().getName()}" not in needed:
                    at.delete(found.getPath(), True)


def associated(pairs: DataFrame, min_count: int = 3, min_share: int = 250, min_lift: int = 3) -> DataFrame:
    """Pairs with enough support and at least ``min_lift`` times the count that chance would give, in whole numbers."""
    wide = "decimal(38,0)"
    return pairs.where(
        (F.col("n_ab") >= min_count)
        & (F.col("n_ab") * min_share >= F.col("n_baskets"))
        & (F.col("n_ab").cast(wide) * F.col("n_baskets") >= F.col("n_a").cast(wide) * F.col("n_b") * min_lift)
    )
