"""Sketches against exact ranks."""

from __future__ import annotations

import math

import numpy as np
import pytest

from threadlake.llm.quantiles import Sketch, bounds_kept, build_sketches, groups_above, merge_sketches, relative_error, sketch_quantiles
from threadlake.session import Staging


@pytest.mark.parametrize("shape", ["lognormal", "rising", "falling", "ties"])
def test_relative_rank_error_of_merged_sketches(shape):
    rng = np.random.default_rng(1)
    n = 200_000
    v = {"lognormal": rng.lognormal(5, 2, n), "rising": np.arange(n, dtype=float), "falling": np.arange(n, 0, -1.0), "ties": rng.integers(0, 50, n).astype(float)}[shape]
    merged = Sketch(64, 1)
    for i, part in enumerate(np.array_split(v, 23)):
        one = Sketch(64, i)
        for some in np.array_split(part, 7):
            one.add(some)
        merged.merge(one)
    assert merged.n == n
    assert sum(len(x) << h for h, x in enumerate(merged.levels)) == n  # no weight is lost
    assert sum(map(len, merged.levels)) < 12_000
    for p in (0.1, 0.5, 0.9, 0.95, 0.99, 0.999, 0.99999):
        at = np.sort(v)[math.ceil(p * n) - 1]
        true = int((v > at).sum())
        assert abs(merged.above(at) - true) <= relative_error(64) * true + 1
    assert merged.quantile(1.0) == v.max()


def test_small_groups_are_exact(spark):
    rows = [("a", float(x), 1) for x in range(100)] + [("b", None, 1), ("c", float("nan"), 1), (None, 7.0, 1), ("d", 3.0, 1), ("d", 3.0, 1)]
    df = spark.createDataFrame(rows, "day string, ms double, n int")
    got = {(r.grp, r.p): (r.n, r.value) for r in sketch_quantiles(build_sketches(df, "day", "ms"), [0.5, 0.95]).collect()}
    assert got == {("a", 0.5): (100, 49.0), ("a", 0.95): (100, 94.0), (None, 0.5): (1, 7.0), (None, 0.95): (1, 7.0), ("d", 0.5): (2, 3.0), ("d", 0.95): (2, 3.0)}
    assert build_sketches(df.limit(0), "day", "ms").count() == 0


def test_days_merge_to_weeks(spark):
    df = spark.range(20_000).selectExpr("concat('d', id % 7) AS day", "CAST(id AS double) AS ms")
    week = merge_sketches(build_sketches(df, "day", "ms").selectExpr("'w' AS grp", "n", "lowest", "highest", "levels", "states"))
    r = sketch_quantiles(week, [0.99]).first()
    assert r.n == 20_000
    assert abs(r.value - 19_799) <= relative_error(64) * 200 + 1


def test_groups_above_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(40):  # groups on either side of the limit and right on it
        n = int(rng.integers(1, 3000)) if g else 12_000
        need = n - math.ceil(0.95 * n)
        above = max(0, min(n, need + (g % 5) - 2))
        rows += [(f"g{g}", 5000.0)] * above + [(f"g{g}", float(x)) for x in rng.choice([2000.0, 1.0, 300.0], n - above)]
    df = spark.createDataFrame(rows, "day string, ms double").repartition(5)
    want = {g for g in {r[0] for r in rows} for v in [sorted(r[1] for r in rows if r[0] == g)] if v[math.ceil(0.95 * len(v)) - 1] > 2000}
    assert {r.grp for r in groups_above(df, "day", "ms", 0.95, 2000.0).collect()} == want
    assert groups_above(df.limit(0), "day", "ms", 0.95, 2000.0).count() == 0


def test_rows_are_read_again_for_near_groups_only(spark):
    """The plan of a result without near groups holds no scan of the rows; with some, they are joined before anything is counted."""
    far = spark.range(30_000).selectExpr("concat('g', id % 3) AS day", "CAST(IF(id % 3 = 0, 9000, 10) AS double) AS ms")
    with Staging(spark):
        got = groups_above(far, "day", "ms", 0.95, 2000.0)
        assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert {(r.grp, r.by) for r in got.collect()} == {("g0", "sketch")}
        near = spark.range(30_000).selectExpr("concat('g', id % 3) AS day", "CAST(IF(id % 3 = 1 AND id % 60 < 3, 9000, 10) AS double) AS ms")
        plan = groups_above(near, "day", "ms", 0.95, 2000.0)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Aggregate") < plan.index("Join") < plan.index("Range")


def test_bounds_are_checked_by_counting(spark):
    rows = spark.range(1000).selectExpr("IF(id < 900, 'a', null) AS day", "CAST(id AS double) AS ms")
    some = spark.createDataFrame([("a", 900, 0.5, 449.0, 449.0), ("a", 900, 0.9, 0.0, 808.0), (None, 100, 0.5, 949.0, 2000.0)], "grp string, n bigint, p double, value_low double, value_high double")
    assert {(r.grp, r.p, r.inside) for r in bounds_kept(rows, some, "day", "ms").collect()} == {("a", 0.5, True), ("a", 0.9, False), (None, 0.5, True)}
