"""The incremental pair table against counting from scratch."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest

from threadlake.llm.cooccurrence import PairTable, _signed_pairs, associated, baskets_of
from threadlake.llm.queries import _session_batches
from threadlake.session import table as supplied

SCHEMA = "id string, tags array<string>, n int, bucket int"


def counted(state):
    sets = [s for s in ({i.strip().lower() for i in tags or [] if i and i.strip()} for tags in state.values()) if s]
    one = Counter(i for s in sets for i in s)
    two = Counter(p for s in sets for p in combinations(sorted(s), 2))
    return {(a, b, n, one[a], one[b], len(sets)) for (a, b), n in two.items()}


def held(table):
    rows = table.pairs().collect()
    for r in rows:
        assert r.lift == pytest.approx(r.n_ab * r.n_baskets / (r.n_a * r.n_b))
    return {(r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b, r.n_baskets) for r in rows}


def test_changes_add_up(spark):
    rng = random.Random(4)
    words = ["a", "B ", "b", " c", "d", "e", "f", None, "", "  "]
    state = {f"s{i}": rng.choice([None, [], rng.choices(words, k=rng.randrange(1, 6))]) for i in range(40)}
    table = PairTable(spark, buckets=4)
    for step in range(3):
        changed = dict(state) if not step else {f"s{i}": rng.choice([[], rng.choices(words, k=4)]) for i in rng.sample(range(45), 6)}
        state |= changed
        df = spark.createDataFrame([(k, v, 1, 9) for k, v in changed.items()] * 2, SCHEMA)  # each twice
        table.apply(baskets_of(df, "id", {"tag": "tags"}))
        assert held(table) == counted(state)
    table.apply(baskets_of(spark.createDataFrame([], SCHEMA), "id", {"tag": "tags"}))
    assert held(table) == counted(state)


def test_empty(spark):
    table = PairTable(spark)
    table.apply(baskets_of(spark.createDataFrame([], SCHEMA), "id", {"tag": "tags"}))
    assert associated(table.pairs()).count() == 0


def test_large_baskets_are_cut_into_squares(spark):
    items = [f"i{n:03}" for n in range(70)]
    df = spark.createDataFrame([("k", [], items), ("k", items[:30], items)], "kind string, old array<string>, new array<string>")
    got = {(r.item_a, r.item_b): r.delta for r in _signed_pairs(df, salt_from=16).collect()}
    want = Counter(combinations(items, 2))
    want.update(p for p in combinations(items, 2) if p[1] not in items[:30])
    assert got == dict(want)


def test_table_is_taken_up_again(spark):
    state = {str(i): [f"t{i % 3}", f"t{i % 4 + 2}", "all"] for i in range(30)}
    table = PairTable(spark, buckets=4)
    table.apply(baskets_of(spark.createDataFrame(list(state.items()), "id string, tags array<string>"), "id", {"tag": "tags"}))
    again = PairTable.open(spark, table.path)
    assert held(again) == counted(state)
    state["1"], state["new"] = [], ["t1", "t9"]
    again.apply(baskets_of(spark.createDataFrame([(k, state[k]) for k in ("1", "new")], "id string, tags array<string>"), "id", {"tag": "tags"}))
    assert held(PairTable.open(spark, table.path)) == counted(state)


def size_below(path):
    return sum(f.stat().st_size for f in Path(path.removeprefix("file://")).rglob("*.parquet"))


def test_a_small_batch_writes_little(spark, tmp_path):
    """Batches of one per cent of the baskets write a few per cent of the bytes at this size, and the result is that of a full count."""
    rng = random.Random(6)
    state = {f"s{i}": [f"t{int(rng.paretovariate(0.3)) % 3000}" for _ in range(6)] for i in range(30_000)}
    table = PairTable(spark, f"file://{tmp_path}/t")

    def apply(keys):
        table.apply(baskets_of(spark.createDataFrame([(k, state[k]) for k in keys], "id string, tags array<string>"), "id", {"tag": "tags"}))

    apply(list(state))
    whole = size_below(table.path)
    for _ in range(3):
        keys = rng.sample(sorted(state), 300)
        for k in keys:
            state[k] = [] if rng.random() < 0.2 else [*state[k][1:], f"t{rng.randrange(3000)}"]
        apply(keys)
    # Three batches, one merge of small layers; files have a kilobyte or two of their own, and frequent items are in every batch.
    assert size_below(table.path) - whole < 3 * 0.05 * whole
    assert len(table.layers["pairs"]) > 1
    want = counted(state)
    assert held(table) == want
    some = {(r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b, r.n_baskets) for r in table.affected().collect()}
    assert some
    assert some <= want
    before = size_below(table.path)
    apply(keys)  # nothing new
    assert size_below(table.path) == before
    table.vacuum()
    assert size_below(table.path) <= before
    assert held(PairTable.open(spark, table.path)) == want


def test_layers_merge_and_removals_stay_removed(spark):
    state = {}
    table = PairTable(spark, buckets=3)
    rng = random.Random(1)
    for step in range(7):
        changed = {f"s{i}": [] if rng.random() < 0.4 else [f"t{rng.randrange(6)}" for _ in range(3)] for i in rng.sample(range(20), 6 if step else 20)}
        state |= changed
        table.apply(baskets_of(spark.createDataFrame(list(changed.items()), "id string, tags array<string>"), "id", {"tag": "tags"}))
        assert held(table) == counted(state)
        assert all(b.rows < a.rows for some in table.layers.values() for a, b in zip(some, some[1:], strict=False))


def test_affected_pairs(spark):
    def apply(table, **baskets):
        table.apply(baskets_of(spark.createDataFrame(list(baskets.items()), "id string, tags array<string>"), "id", {"tag": "tags"}))

    table = PairTable(spark)
    apply(table, a=["x", "y"], b=["x", "y", "z"], c=["p", "q"])
    apply(table, b=["y", "z"], d=["q"])  # x and q move, y and z don't
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b) for r in table.affected().collect()}
    assert got == {("x", "y"): (1, 1, 2), ("p", "q"): (1, 1, 2)}


def test_batches_end_in_the_table(spark):
    """The registered batches hold removed and changed baskets and end in the sessions as they are."""
    sessions = supplied(spark, "/root/testdata/sf0.001", "sessions")
    first, second, third = (b.collect() for b in _session_batches(sessions))
    want = {r.id: (r.tags, r.entities) for r in sessions.collect()}
    state = {}
    for batch in (first, second, third):
        state |= {r.id: (r.tags, r.entities) for r in batch}
    assert {k: v for k, v in state.items() if k in want} == want
    assert len(third) > len(want) // 5
    assert {r.id for r in first} & {r.id for r in second}
    assert all(v == (None, None) for k, v in state.items() if k not in want)
