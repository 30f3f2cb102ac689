"""Runs of activity against a plain loop, and the defined results of odd inputs."""

from __future__ import annotations

import random
from itertools import groupby

import pytest

from threadlake.operators.sessionize import line_instants, sessionize

SCHEMA = "user string, at bigint, key string, start_ms int"


def brute(rows, gap):
    out = []
    some = [(r[0], r[1]) for r in rows if r[1] is not None]
    for user, mine in groupby(sorted(some, key=lambda r: (r[0] is not None, r[0] or "", r[1])), key=lambda r: r[0]):
        run = None
        for _, t in mine:
            if run and t - run[2] <= gap:
                run[2], run[4] = t, run[4] + 1
            else:
                run = [user, t, t, 0, 1]
                out.append(run)
            run[3] = run[2] - run[1]
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_loop_over_partition_edges(spark, fixed_partitions, seed):
    rng = random.Random(seed)
    users = ["a"] * 6 + ["b", "c", None]  # one user holds most rows
    rows = [(rng.choice(users), rng.choice([None, rng.randrange(20_000)]) if rng.random() < 0.1 else rng.randrange(20_000), "x", 1) for _ in range(600)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, SCHEMA)  # extra columns clash with the result's names
    for gap in (0, 30, 100_000):
        assert sorted(map(tuple, sessionize(df, "user", "at", gap).collect()), key=str) == brute(rows, gap)


def test_gap_itself_does_not_part(spark):
    df = spark.createDataFrame([("a", 0, "", 0), ("a", 900_000, "", 0), ("a", 1_800_001, "", 0)], SCHEMA)
    assert sorted(tuple(r)[1:] for r in sessionize(df, "user", "at").collect()) == [(0, 900_000, 900_000, 2), (1_800_001, 1_800_001, 0, 1)]


def test_empty_and_bad_gap(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sessionize(empty, "user", "at").count() == 0
    with pytest.raises(ValueError, match="negative"):
        sessionize(empty, "user", "at", -1)


def test_line_instants_of_repeats(spark):
    rows = [("s", 1, "1970-01-01T00:00:01Z"), ("s", 1, "1000"), ("s", 2, "no instant"), ("s", 3, None), ("s", 4, "1970-01-01T01:00:02+01:00")]
    df = spark.createDataFrame(rows, "session_id string, line_no int, timestamp string")
    assert sorted((r.line_no, r.ts_ms) for r in line_instants(df).collect()) == [(1, 1000), (4, 2000)]
