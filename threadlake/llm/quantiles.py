"""Percentiles per group with a relative rank error, from mergeable sketches.

A sketch is a stack of compactors. Level h holds values of weight 2**h. When a level is over its capacity, its *low* values
are compacted: sorted, every other one is promoted, the rest dropped. The top values of a level are protected, more of them
the rarer a compaction reaches down, so ranks near the maximum are exact or nearly so and the error of an estimated
rank is proportional to the number of values above it. Sketches of partitions, days or files merge level by level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from threadlake.schema import struct
from threadlake.session import staged

SKETCH = struct(
    "grp string, n bigint, lowest double, highest double, levels array<array<double>>, states array<bigint>"
)
#: Sketches that one task holds before it hands some on; bounds its memory where groups are many.
HELD = 2_000
#: Partial sketches of a group that one task merges at a time.
FAN_IN = 64
#: Groups whose short rows are broadcast; beyond that Spark joins by shuffle.
MAX_BROADCAST_GROUPS = 100_000


class Sketch:
    """Relative-rank compactors for the upper tail; ``k`` (even) sets the error."""

    def __init__(self, k: int = 64, seed: int = 0):
        self.k, self.seed = k, seed
        self.n, self.low, self.high = 0, math.inf, -math.inf
        self.levels: list[np.ndarray] = []
        self.states: list[int] = []

    def sections(self, level: int) -> int:
        """Sections of a level: three, and one more for each doubling of its compactions."""
        return 3 + max(0, int(self.states[level]).bit_length() - 2)

    def _grow(self, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append(np.empty(0))
            self.states.append(0)

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
        self._grow(0)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._compress()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self._grow(len(other.levels) - 1)
        for h, (values, state) in enumerate(zip(other.levels, other.states, strict=True)):
            self.levels[h] = np.concatenate([self.levels[h], values])
            self.states[h] |= state  # the schedule of the one that compacted more often
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            parts = self.sections(h)
            if len(self.levels[h]) >= 2 * self.k * parts:
                values, state = np.sort(self.levels[h]), self.states[h]
                reach = min(parts, ((state ^ (state + 1)).bit_length()))  # 1 + trailing ones of the state
                keep = self.k * parts + self.k * (parts - reach)
                cut = (len(values) - keep) & ~1
                coin = (self.seed * 0x9E3779B97F4A7C15 + h * 0xBF58476D1CE4E5B9 + state * 0x94D049BB133111EB >> 17) & 1
                self.levels[h] = values[cut:]
                self.states[h] += 1
                self._grow(h + 1)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], values[coin:cut:2]])
            h += 1

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """All kept values in rising order and the summed weights up to each."""
        values = np.concatenate(self.levels or [np.empty(0)])
        weights = np.repeat([1 << h for h in range(len(self.levels))], [len(x) for x in self.levels]) if self.levels else np.empty(0, np.int64)
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def above(self, threshold: float) -> int:
        """Estimated number of values greater than ``threshold``."""
        values, upto = self.weighted()
        at = np.searchsorted(values, threshold, side="right")
        return int(self.n - (upto[at - 1] if at else 0)) if len(values) else 0

    def quantile(self, p: float) -> float | None:
        """Estimate of the value at rank ceil(p n)."""
        if not self.n:
            return None
        values, upto = self.weighted()
        at = np.searchsorted(upto, max(1, math.ceil(p * self.n - 1e-9)))
        return float(values[min(at, len(values) - 1)])

    def row(self, grp: str | None) -> dict:
        return {"grp": grp, "n": self.n, "lowest": self.low, "highest": self.high, "levels": [x.tolist() for x in self.levels], "states": list(self.states)}

    @classmethod
    def of(cls, row: dict, k: int, seed: int) -> Sketch:
        out = cls(k, seed)
        out.n, out.low, out.high = int(row["n"]), row["lowest"], row["highest"]
        out.levels = [np.asarray(x, float) for x in row["levels"]]
        out.states = [int(x) for x in row["states"]]
        return out


def relative_error(k: int) -> float:
    """Bound used for an estimated number of values above a point, relative to that number.

    Five standard deviations of the compactors' error, for which 0.14 / k holds with three or more sections (tests measure it).
    """
    return 5 * 0.14 / k


def build_sketches(rows: DataFrame, group: str, value: str, k: int = 64) -> DataFrame:
    """One merged sketch per group: ``grp, n, lowest, highest, levels, states``.

    Each task sketches its own rows, whatever their group; partial sketches are merged ``FAN_IN`` at a time, so a
    group that holds a third of all rows needs no large task.

    Defined results: null and NaN values are left out; a null group is a group of its own; groups without a value give
    no row; an empty table gives no rows.
    """
    arrow = to_arrow_schema(SKETCH)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Sketch] = {}
        for batch in batches:
            part = pd.DataFrame({"g": batch.column(0).to_pandas(), "v": batch.column(1).to_numpy(zero_copy_only=False)})
            for g, values in part.groupby("g", dropna=False, sort=True)["v"]:
                g = None if pd.isna(g) else g
                if g not in held:
                    held[g] = Sketch(k, len(held))
                held[g].add(values.to_numpy(float))
            if len(held) > HELD:
                yield pa.RecordBatch.from_pylist([s.row(g) for g, s in held.items()], schema=arrow)
                held = {}
        if held:
            yield pa.RecordBatch.from_pylist([s.row(g) for g, s in held.items()], schema=arrow)

    kept = rows.select(F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{value}`").cast("double").alias("v"))
    parts = kept.where(F.col("v").isNotNull() & ~F.isnan("v")).mapInArrow(sketch, SKETCH)
    first = parts.withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    return merge_sketches(merge_sketches(first, k, ["lot"]), k)


def merge_sketches(sketches: DataFrame, k: int = 64, lots: list[str] | None = None) -> DataFrame:
    """Merge the sketches of equal ``grp`` (and lot, if given): of partitions, days or files alike."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.to_dict("records"), key=lambda r: (r["n"], r["lowest"], r["highest"], len(r["levels"])))
        out = Sketch.of(rows[0], k, 1)
        for i, r in enumerate(rows[1:], 2):
            out.merge(Sketch.of(r, k, i))
        return pd.DataFrame([out.row(rows[0]["grp"])])

    return sketches.groupBy("grp", *(lots or [])).applyInPandas(merge, SKETCH)


def sketch_quantiles(sketches: DataFrame, ps: list[float], k: int = 64) -> DataFrame:
    """``grp, n, p, value, value_low, value_high``: estimates, and the values at the ranks of the error bound."""
    eps = relative_error(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                s = Sketch.of(r, k, 0)
                for p in ps:
                    slack = eps * (1 - p)
                    out.append((r["grp"], s.n, p, s.quantile(p), s.quantile(max(0.0, p - slack)), s.quantile(min(1.0, p + slack))))
            yield pd.DataFrame(out, columns=["grp", "n", "p", "value", "value_low", "value_high"])

    return sketches.mapInPandas(run, "grp string, n bigint, p double, value double, value_low double, value_high double")


def judged_groups(rows: DataFrame, group: str, value: str, p: float, threshold: float, k: int = 64) -> DataFrame:
    """``grp, n, need, above, verdict`` from the sketches: whether the value at rank ceil(p n) exceeds ``threshold``.

    ``need`` values may be above before it does, ``above`` is the estimate of how many are; ``near`` where the error bound leaves both open.
    """
    eps = relative_error(k)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                above = Sketch.of(r, k, 0).above(threshold)
                need = int(r["n"]) - math.ceil(p * int(r["n"]) - 1e-9)  # exceeded if more than so many are above
                slack = eps * max(above, need) + 1
                out.append((r["grp"], int(r["n"]), need, above, "yes" if above > need + slack else "no" if above <= need - slack else "near"))
            yield pd.DataFrame(out, columns=["grp", "n", "need", "above", "verdict"])

    return build_sketches(rows, group, value, k).mapInPandas(judge, "grp string, n bigint, need bigint, above bigint, verdict string")


def _beside(rows: DataFrame, few: DataFrame, n: int) -> DataFrame:
    """``rows`` (``grp, v``) joined to one short row or more per group; broadcast up to ``MAX_BROADCAST_GROUPS``."""
    return rows.join(F.broadcast(few) if n <= MAX_BROADCAST_GROUPS else few, F.col("grp").eqNullSafe(F.col("of_grp")))


def _values(rows: DataFrame, group: str, value: str) -> DataFrame:
    kept = rows.select(F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{value}`").cast("double").alias("v"))
    return kept.where(F.col("v").isNotNull() & ~F.isnan("v"))


def groups_above(rows: DataFrame, group: str, value: str, p: float, threshold: float, k: int = 64) -> DataFrame:
    """Groups whose value at rank ceil(p n) exceeds ``threshold``: ``grp, by`` (``sketch`` or ``count``).

    The sketch decides wherever the threshold's rank lies outside its error bound. Only the rows of groups within the bound are read again and counted
    exactly; where there are none, no row is.
    """
    judged = staged(judged_groups(rows, group, value, p, threshold, k), "verdicts")  # one short row per group
    yes = judged.where("verdict = 'yes'").select("grp", F.lit("sketch").alias("by"))
    near = judged.where("verdict = 'near'").select(F.col("grp").alias("of_grp"), "need")
    n = near.count()
    if not n:
        return yes
    exact = _beside(_values(rows, group, value).where(F.col("v") > threshold), near, n).groupBy("grp").agg(F.count("*").alias("n_above"), F.first("need").alias("need"))
    return yes.unionByName(exact.where("n_above > need").select("grp", F.lit("count").alias("by")))


def bounds_kept(rows: DataFrame, quantiles: DataFrame, group: str, value: str) -> DataFrame:
    """``grp, p, n, inside``: whether the exact value at rank ceil(p n) lies between ``value_low`` and ``value_high`` of ``sketch_quantiles``.

    Found by counting the rows below either end, so no group is sorted or held.
    """
    few = staged(quantiles, "bounds").withColumnRenamed("grp", "of_grp")
    per = _beside(_values(rows, group, value), few, few.count()).groupBy("grp", "p", "n", "value_low", "value_high")
    counts = per.agg(F.count_if(F.col("v") < F.col("value_low")).alias("below"), F.count_if(F.col("v") <= F.col("value_high")).alias("upto"), F.count("*").alias("rows"))
    rank = F.ceil(F.round(F.col("p") * F.col("rows"), 9))
    return counts.select("grp", "p", "n", ((F.col("below") < rank) & (F.col("upto") >= rank) & (F.col("rows") == F.col("n"))).alias("inside"))
