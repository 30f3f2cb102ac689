"""A stored lexical index: postings that are kept current for changed keys and searched without reading any text.

Texts are cut into terms once, when their key (a session) is new or has changed. Postings lie in layers of hash buckets by term, sorted by term, so a search
reads the buckets of its terms and, within them, the row groups that can hold them. A refresh appends a layer with the postings of the changed keys; for
each key the newest layer stands. Layers are merged like the digits of a binary counter, which drops what no longer stands.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.lexical import MAX_BROADCAST_TERMS, tokens
from threadlake.session import in_tasks, new_path, spread, staged

#: Postings that lie in one bucket of a layer, and keys whose versions are broadcast.
BUCKET_ROWS = 2_000_000
MAX_BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Layer:
    """Postings written together: ``buckets`` folders of a version, ``rows`` postings, ``keys`` keys."""

    version: int
    buckets: int
    rows: int
    keys: int


class LexicalIndex:
    """Postings of documents below ``path``; ``refresh`` replaces whole keys, ``bm25_top`` searches it in place of documents.

    A manifest beside the data names the layers; ``open`` takes up the newest. One writer at a time; a failed refresh leaves the index as it was.
    """

    POSTINGS = "key string, doc_id {id}, dl int, term string, tf bigint, part int, v int"
    DOCS = "key string, doc_id {id}, dl int, v int"

    def __init__(self, spark: SparkSession, path: str | None = None, id_type: str = "bigint", extra_tokens: int = 1):
        self.spark, self.path, self.id_type, self.extra = spark, path or new_path(spark, "index"), id_type, extra_tokens
        self.layers: list[Layer] = []
        self.version = self.n_docs = self.total = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LexicalIndex:
        """The index below ``path`` as of its newest manifest; raises where there is none."""
        rows = spark.read.json(f"{path}/manifest/*.json")
        last = json.loads(rows.orderBy(F.col("version").desc()).select(F.col("state")).first()[0])
        index = cls(spark, path, last["id_type"], last["extra"])
        index.layers = [Layer(**x) for x in last["layers"]]
        index.version, index.n_docs, index.total = last["version"], last["n_docs"], last["total"]
        return index

    def _save(self) -> None:
        state = {"version": self.version, "n_docs": self.n_docs, "total": self.total, "id_type": self.id_type, "extra": self.extra, "layers": [asdict(x) for x in self.layers]}
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{self.version}.json")
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(json.dumps({"version": self.version, "state": json.dumps(state)}), "utf-8"))
        out.close()

    def _read(self, name: str, schema: str, layers: list[Layer]) -> DataFrame:
        paths = [f"{self.path}/{name}/v={x.version}" for x in layers]
        return self.spark.read.schema(schema.format(id=self.id_type)).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _standing(self, rows: DataFrame, layers: list[Layer]) -> DataFrame:
        """``rows`` (``key, v``) of the newest layer of their key."""
        if len(layers) == 1:
            return rows
        newest = self._read("keys", "key string, v int", layers).groupBy("key").agg(F.max("v").alias("v"))
        small = sum(x.keys for x in layers) <= MAX_BROADCAST_KEYS
        return rows.join(F.broadcast(newest) if small else newest, ["key", "v"], "left_semi")

    def _write(self, version: int, keys: DataFrame, docs: DataFrame, postings: DataFrame, expected: int, n_keys: int) -> Layer:
        """A layer of ``expected`` postings, or fewer. They are dealt by hash, as ranges would need to be found in a first pass over all counts."""
        buckets = max(1, math.ceil(expected / BUCKET_ROWS))
        keys.write.mode("overwrite").parquet(f"{self.path}/keys/v={version}")
        docs.write.mode("overwrite").parquet(f"{self.path}/docs/v={version}")
        dealt = postings.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        cores = self.spark.sparkContext.defaultParallelism
        dealt = in_tasks(dealt, buckets, "part") if buckets >= cores else in_tasks(dealt, cores, "part", "term")
        dealt.sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/postings/v={version}")
        layer = Layer(version, buckets, 0, n_keys)
        return replace(layer, rows=self._read("postings", self.POSTINGS, [layer]).count())

    def refresh(self, docs: DataFrame, key_col: str, id_col: str, text_col: str, removed: DataFrame | None = None) -> None:
        """Replace the documents of every key in ``docs``, and drop the keys in ``removed`` (a column of that name).

        Null texts are documents without terms; a null key is a key of its own, named ''; documents of equal key and id are one.
        """
        key = F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit(""))
        some = spread(docs.select(key.alias("key"), F.col(f"`{id_col}`").cast(self.id_type).alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "doc_id")
        cut = staged(some.select("key", "doc_id", F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("t")), "cut")
        lengths = cut.groupBy("key", "doc_id").agg((F.sum(F.size("t")) + self.extra).cast("int").alias("dl"))
        counts = cut.select("key", "doc_id", F.explode("t").alias("term")).groupBy("key", "doc_id", "term").agg(F.count("*").alias("tf"))
        keys = cut.select("key")
        if removed is not None:
            keys = keys.unionByName(removed.select(key.alias("key")))
        keys = staged(keys.distinct(), "keys")
        postings = counts.join(lengths, ["key", "doc_id"]).select("key", "doc_id", "dl", "term", "tf")
        rows, n_keys = cut.agg(F.coalesce(F.sum(F.size("t")), F.lit(0))).first()[0], keys.count()
        if not n_keys:
            return
        at = self.version + 1
        layers = [*self.layers, self._write(at, keys, lengths, postings, rows, n_keys)]
        first = len(layers) - 1
        while first > 0 and sum(x.rows for x in layers[first:]) >= layers[first - 1].rows:
            first -= 1
        if first < len(layers) - 1:
            gone, at = layers[first:], at + 1
            kept = self._standing(self._read("postings", self.POSTINGS, gone), gone).drop("part", "v")
            kept_keys = self._read("keys", "key string, v int", gone).select("key").distinct()
            kept_docs = self._standing(self._read("docs", self.DOCS, gone), gone).drop("v")
            layers = [*layers[:first], self._write(at, kept_keys, kept_docs, kept, sum(x.rows for x in gone), sum(x.keys for x in gone))]
        self.layers, self.version = layers, at
        n, total = self._standing(self._read("docs", self.DOCS, layers), layers).agg(F.count("*"), F.sum("dl")).first()
        self.n_docs, self.total = n, total or 0
        self._save()

    def postings(self) -> DataFrame:
        """``key, doc_id, dl, term, tf`` of everything that stands."""
        if not self.layers:
            return self.spark.createDataFrame([], "key string, doc_id " + self.id_type + ", dl int, term string, tf bigint")
        return self._standing(self._read("postings", self.POSTINGS, self.layers), self.layers).select("key", "doc_id", "dl", "term", "tf")

    def found(self, terms: DataFrame, by: str | None = None) -> tuple[DataFrame, int, float]:
        """As ``lexical.Texts.found``; ``by`` names the key."""
        small = terms.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS
        words = F.broadcast(terms) if small else terms
        keys, found = ["doc_id", *(["key"] if by else [])], self.postings().limit(0)
        for layer in self.layers:
            rows = self._read("postings", self.POSTINGS, [layer])
            if layer.buckets > 1:
                part = F.pmod(F.xxhash64("term"), F.lit(layer.buckets)).cast("int")
                rows = rows.where(F.col("part").isin([r[0] for r in terms.select(part).distinct().collect()]))  # at most as many as buckets
            rows = self._standing(rows.join(words, "term", "left_semi"), self.layers).select("key", "doc_id", "dl", "term", "tf")
            found = rows if layer is self.layers[0] else found.unionByName(rows)
        found = found.select(*keys, "dl", "term", "tf")
        return (found.withColumnRenamed("key", by) if by else found), self.n_docs, self.total / max(1, self.n_docs)
