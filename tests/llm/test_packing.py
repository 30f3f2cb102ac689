"""Containers: nothing lost, nothing overfull, little unused."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.llm.packing import Limits, best_fit, container_report, divided, limits_report, pack

SCHEMA = "doc_id bigint, text string, size int, container string"


def some(spark, seed=2):
    rng = random.Random(seed)
    rows = [(i, "é" * (rng.randrange(1, 40) if rng.random() < 0.9 else rng.randrange(40, 300)), 0, "x") for i in range(600)]
    rows += [(600, None, 0, ""), (601, "", 0, ""), (1, rows[1][1], 0, ""), (None, "abc", 0, "")]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_whole_and_tight(spark, rule):
    rows, df = some(spark)
    packed = pack(df, capacity=100, max_docs=9, rule=rule, shard_containers=64)
    total = sum(len((r[1] or "").encode()) for r in rows)
    parts = packed.collect()
    assert sum(p["size"] for p in parts) == total
    by_doc = {}
    for p in parts:
        by_doc.setdefault(p.doc_id, []).append(p["size"])
    for doc in by_doc:
        assert sum(by_doc[doc]) == sum(len((r[1] or "").encode()) for r in rows if r[0] == doc)
    for p in parts:  # only what alone is larger than a container is divided
        assert (p.n_parts > 1) == any(r[0] == p.doc_id and len((r[1] or "").encode()) > 100 for r in rows)
    bins = container_report(packed, 100).collect()
    assert max(b.tokens for b in bins) <= 100
    assert max(b["items"] for b in bins) <= 9
    assert total / (100 * len(bins)) > 0.93


def test_cost_binds_and_bad_rule(spark):
    df = spark.createDataFrame([(i, "x" * 50, 0, "") for i in range(8)], SCHEMA)
    assert pack(df, capacity=100, max_cost=2600.0).select("container").distinct().count() == 8
    assert pack(df, capacity=100).select("container").distinct().count() == 4
    with pytest.raises(ValueError, match="rule"):
        pack(df, rule="first")
    assert pack(df.limit(0)).count() == 0


def test_best_fit_takes_the_tightest():
    out = best_fit(np.array([70, 60, 40, 30]), (100, 10, 1e4), (1.0, 0.0, 0.0), "norm")
    assert out.tolist() == [0, 1, 1, 0]


def test_repeated_and_null_ids_dont_meet_in_one_shard(spark):
    """Two thirds of the rows hold one id or none: shards stay bounded all the same."""
    df = spark.createDataFrame([(7 if i % 3 else None if i % 2 else i, "x" * 9, 0, "") for i in range(3000)], SCHEMA)
    per_shard = [r["count"] for r in pack(df, capacity=100, shard_items=300).groupBy((F.col("container") / 2**32).cast("bigint")).count().collect()]
    assert sum(per_shard) == 3000
    assert max(per_shard) < 2 * 300


def test_an_item_that_breaks_a_limit_alone_is_refused():
    with pytest.raises(ValueError, match="alone"):
        best_fit(np.array([100, 90, 10]), (100, 10, 2000), (1.0, 0.0, 0.0), "norm")
    with pytest.raises(ValueError, match="tile"):
        Limits(100, cost=50.0, tile=10)


def test_parts_keep_every_limit(spark):
    """A cost limit below that of a full container: items are divided where they alone are over it."""
    df = spark.createDataFrame([(i, "x" * n, 0, "") for i, n in enumerate([300, 99, 41, 40, 39, 7, 1])], SCHEMA)
    packed = pack(df, capacity=100, max_cost=1600.0, tile=10)
    assert {r.doc_id: r.n_parts for r in packed.collect()} == {0: 8, 1: 3, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}
    assert max(r.cost for r in container_report(packed, 100, 10).collect()) <= 1600


def test_every_limit_binds_somewhere(spark):
    """Each limit alone decides in one of three collections, at the defaults."""
    limits = Limits()
    assert (limits.docs, limits.tile, limits.cost, limits.part) == (128, 128, 8192.0**2, 8192)
    made = {"tokens": [3000] * 40 + [2100] * 40, "docs": [3] * 2000, "cost": [8100] * 30 + [60] * 30}
    for name, sizes in made.items():
        packed = pack(spark.createDataFrame([(i, "x" * n, 0, "") for i, n in enumerate(sizes)], SCHEMA))
        report = {r.limit_name: (r.largest, r.allowed) for r in limits_report(packed, limits).collect()}
        assert all(report[x][0] <= report[x][1] for x in ("tokens", "docs", "cost"))
        bins = container_report(packed).collect()
        if name == "tokens":
            assert max(b.tokens for b in bins) > 8192 - 2100
        elif name == "docs":
            assert max(b["items"] for b in bins) == 128
        else:  # 8,100 and 60 would fit by tokens
            assert len(bins) == 31


def test_divided_comes_from_containers(spark):
    rows = [(1, "x" * 250, 0, ""), (2, "x" * 100, 0, ""), (1, "x" * 90, 0, ""), (None, "x" * 101, 0, ""), (3, None, 0, "")]
    assert sorted(r.doc_id or 0 for r in divided(pack(spark.createDataFrame(rows, SCHEMA), capacity=100)).collect()) == [0, 1]


def test_shards_keep_their_tasks(spark):
    """Shards of few bytes aren't packed in one task."""
    df = spark.createDataFrame([(i, "x" * 9, 0, "") for i in range(3000)], SCHEMA)
    assert pack(df, capacity=100, shard_items=300).rdd.getNumPartitions() == 10
