"""Rebuilding conversations from message rows.

Instants and turns come from DataFrame steps. Turns are then dealt into blocks of bounded size, ranges of (session, instant, line), so a session
that holds a third of all rows is spread over many tasks; inside a block they lie in any order. In each block the reply graph is built (a turn
replies to the parent line it names, else to the last turn of the other speaker before it and behind its own speaker's last turn) and
Kahn's algorithm, ties by instant and line, gives the order. Nodes left over lie on a cycle. Role alternation and completeness are checked along that
order. What is open at the edges of blocks (two turns each) is settled in a small second step.

Where turns name their parents, instants may contradict them. Such a turn takes the latest instant above it in its reply graph (found by pointer
doubling, in sessions that hold a contradiction only), so a parent never lies in a later block than its replies, unless they form a cycle.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from threadlake.functions.instants import instant_ms
from threadlake.functions.text import folded, is_blank
from threadlake.schema import struct
from threadlake.session import staged

#: Lines of a session that lie in one block when missing instants are filled.
FILL_BLOCK = 4096
#: Turns that one task orders at a time; small inputs are cut finer, to use all cores.
BLOCK_TURNS, LEAST_TURNS = 200_000, 5_000
TURN = struct(
    "session_id string, line_no int, instant_ms bigint, role string, reply_to int, answered boolean, cyclic boolean, edge boolean, part int, place bigint"
)


def kahn_order(parents: Sequence[Sequence[int]], keys: Sequence[tuple]) -> tuple[list[int], list[int]]:
    """Kahn's topological order of a block, the smallest key first among the nodes that are free; and the nodes left over.

    ``parents[i]`` are the nodes that i waits for; -1 stands for one that went before this block. What is left over lies on a
    cycle or behind one.
    """
    waits = [sum(p >= 0 for p in ps) for ps in parents]
    children: list[list[int]] = [[] for _ in parents]
    for i, ps in enumerate(parents):
        for p in ps:
            if p >= 0:
                children[p].append(i)
    free = [(keys[i], i) for i, n in enumerate(waits) if not n]
    heapq.heapify(free)
    order: list[int] = []
    while free:
        _, i = heapq.heappop(free)
        order.append(i)
        for c in children[i]:
            waits[c] -= 1
            if not waits[c]:
                heapq.heappush(free, (keys[c], c))
    done = set(order)
    return order, [i for i in range(len(waits)) if i not in done] if len(order) < len(waits) else []


def unique_lines(messages: DataFrame, parent_col: str | None = None) -> DataFrame:
    """Lines counted once per (session_id, line_no): ``ms`` (own readable instant or null), ``is_turn``, ``role`` and ``parent_no`` (null without a column).

    Of copies the one with the lowest ``line_id`` stands; its instant may come from any copy.
    """
    role = folded("role")
    parent = F.col(f"`{parent_col}`") if parent_col else F.lit(None)
    turn = (
        F.col("type").isin("user", "assistant")
        & (role == F.col("type"))
        & ~F.coalesce("ismeta", F.lit(False))
        & ~F.coalesce("issidechain", F.lit(False))
        & ~is_blank("content_text")
    )
    first = F.struct("line_id", F.coalesce(turn, F.lit(False)).alias("is_turn"), role.alias("role"), parent.cast("int").alias("parent_no"))
    return (
        messages.select("session_id", "line_no", instant_ms("timestamp").alias("ms"), first.alias("first"))
        .groupBy("session_id", "line_no")
        .agg(F.min("ms").alias("ms"), F.min_by("first", "first.line_id").alias("first"))
        .select("session_id", "line_no", "ms", *[F.col(f"first.{c}").alias(c) for c in ("is_turn", "role", "parent_no")])
    )


def filled_instants(lines: DataFrame) -> DataFrame:
    """``instant_ms``: a line's own instant, else that of the nearest earlier line of its session that has one, else null.

    Windows run over blocks of ``FILL_BLOCK`` lines; what a block hands on is one value, so no window grows with a session.
    """
    blocked = lines.withColumn("blk", F.floor(F.col("line_no") / FILL_BLOCK))
    near = Window.partitionBy("session_id", "blk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    within = blocked.withColumn("near", F.last("ms", ignorenulls=True).over(near))
    earlier = Window.partitionBy("session_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    handed = (
        blocked.groupBy("session_id", "blk")
        .agg(F.max_by("ms", F.when(F.col("ms").isNotNull(), F.col("line_no"))).alias("last_ms"))
        .withColumn("before", F.last("last_ms", ignorenulls=True).over(earlier))
        .select(F.col("session_id").alias("s"), F.col("blk").alias("b"), "before")
    )
    joined = within.join(handed, F.col("session_id").eqNullSafe(F.col("s")) & F.col("blk").eqNullSafe(F.col("b")), "left")
    return joined.withColumn("instant_ms", F.coalesce("near", "before")).drop("blk", "near", "s", "b", "before")


#: Columns that order the turns of a session: the effective place (see the module) first, then the turn's own.
PLACE = ["top_ms", "top_line", "depth", "instant_ms", "line_no"]


def _graph(sessions: list, keys: list[tuple], roles: list[str], lines: list[int], named: list[int | None], named_keys: list) -> tuple[list[list[int]], list[int | None]]:
    """Parents of each turn (see ``kahn_order``) and the line it replies to, for the turns of a block in any order."""
    by_role: dict[tuple, list] = defaultdict(list)
    at = {}
    for i, (s, k) in enumerate(zip(sessions, keys, strict=True)):
        by_role[s, roles[i]].append((k, i))
        at[s, lines[i]] = i
    for some in by_role.values():
        some.sort()
    parents, replies = [], []
    for i, s in enumerate(sessions):
        if named[i] is not None:
            p = at.get((s, named[i]))
            # A parent that isn't here went before this block, or comes after it and is waited for in vain: a cycle.
            parents.append([p if p is not None else i if named_keys[i] > keys[i] else -1])
            replies.append(named[i])
            continue
        before, reply = [], None
        for role in ("user", "assistant"):
            some = by_role.get((s, role), [])
            no = bisect_left(some, (keys[i], i)) - 1
            before.append(some[no][1] if no >= 0 else -1)
            if role != roles[i] and no >= 0:
                reply = lines[some[no][1]]
        parents.append(before)
        replies.append(reply)
    return parents, replies


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of turns in any order in; the turns in Kahn's order with reply, answer and edge marks out."""
    arrow = to_arrow_schema(TURN)
    block = [b for b in batches if b.num_rows]
    if not block:
        return
    table = pa.Table.from_batches(block)
    sessions, roles, parts, named = (table.column(c).to_pylist() for c in ("session_id", "role", "part", "parent_no"))
    place, own = [table.column(c).to_pylist() for c in PLACE], table.column("line_no").to_pylist()
    up = [table.column(c).to_pylist() for c in ("parent_top_ms", "parent_top_line", "parent_depth", "parent_ms", "parent_no")]

    def rank(row: tuple) -> tuple:  # missing instants go first
        top, top_line, depth, ms, line = row
        return (top is not None, top or 0, top_line, depth, ms is not None, ms or 0, line)

    keys = [rank(r) for r in zip(*place, strict=True)]
    parents, replies = _graph(sessions, keys, roles, own, named, [rank(r) if r[4] is not None else None for r in zip(*up, strict=True)])
    code = {s: (s is not None, s or "") for s in set(sessions)}
    order, left = kahn_order(parents, [(code[s], k) for s, k in zip(sessions, keys, strict=True)])
    cyclic, turns = set(left), defaultdict(list)
    for i in [*order, *left]:
        turns[sessions[i]].append(i)
    first, last = min(turns, key=code.get), max(turns, key=code.get)  # those that may go on in other blocks
    out: list[tuple] = []
    for s, mine in turns.items():
        for no, (i, after) in enumerate(zip(mine, [*mine[1:], None], strict=True)):
            known = after is not None or s != last
            answered = roles[i] != "user" or (after is not None and roles[after] == "assistant") if known or roles[i] != "user" else None
            edge = s == first and not no or s == last and after is None
            out.append((s, own[i], place[3][i], roles[i], replies[i], answered, i in cyclic, edge, parts[i], no))
    for lo in range(0, len(out), 20_000):
        some = out[lo : lo + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)


def _placed(turns: DataFrame) -> DataFrame:
    """``turns`` (``session_id, instant_ms, line_no, role, parent_no``) with their effective place and that of the parent.

    Only a parent that is a turn of the session, and not the turn itself, counts. Where no parent is later than its reply, places are the turns' own.
    """
    key = F.struct(F.col("instant_ms").isNotNull().alias("has"), F.coalesce("instant_ms", F.lit(0)).alias("ms"), F.col("line_no").alias("line"))
    base = staged(turns.withColumn("key", key), "parents")
    other = base.select(F.col("session_id").alias("s"), F.col("line_no").alias("l"), F.col("key").alias("parent_key"))
    linked = base.join(other, F.col("session_id").eqNullSafe(F.col("s")) & (F.col("parent_no") == F.col("l")), "left").drop("s", "l")
    linked = staged(linked.withColumn("parent_no", F.when(F.col("parent_key").isNotNull(), F.col("parent_no"))), "links")
    turned = linked.where(F.col("parent_key") >= F.col("key")).select(F.col("session_id").alias("s")).distinct()
    state = linked.join(turned, F.col("session_id").eqNullSafe(F.col("s")), "left_semi")
    state = staged(state.select("session_id", "line_no", F.col("parent_no").alias("up"), F.col("key").alias("top"), F.col("parent_no").isNotNull().cast("int").alias("depth")), "tops")
    longest = state.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length() + 1):  # pointer doubling: each round looks twice as far up
        if state.where("up IS NOT NULL").isEmpty():
            break
        far = state.select(F.col("session_id").alias("s"), F.col("line_no").alias("l"), F.col("up").alias("far_up"), F.col("top").alias("far_top"), F.col("depth").alias("far_depth"))
        joined = state.join(far, F.col("session_id").eqNullSafe(F.col("s")) & (F.col("up") == F.col("l")), "left")
        state = staged(joined.select("session_id", "line_no", F.col("far_up").alias("up"), F.greatest("top", "far_top").alias("top"), (F.col("depth") + F.coalesce("far_depth", F.lit(0))).alias("depth")), "tops")
    # What still looks up after that lies on a cycle or behind one; its depth means nothing.
    tops = state.select(F.col("session_id").alias("s"), F.col("line_no").alias("l"), "top", F.when(F.col("up").isNull(), F.col("depth")).otherwise(0).alias("depth"))
    placed = linked.join(tops, F.col("session_id").eqNullSafe(F.col("s")) & (F.col("line_no") == F.col("l")), "left")
    top = F.coalesce("top", "key")
    placed = staged(
        placed.select("session_id", "instant_ms", "line_no", "role", "parent_no", F.when(top["has"], top["ms"]).alias("top_ms"), top["line"].alias("top_line"), F.coalesce("depth", F.lit(0)).alias("depth")), "placed"
    )
    up = placed.select(F.col("session_id").alias("s"), F.col("line_no").alias("l"), F.col("top_ms").alias("parent_top_ms"), F.col("top_line").alias("parent_top_line"), F.col("depth").alias("parent_depth"), F.col("instant_ms").alias("parent_ms"))
    return placed.join(up, F.col("session_id").eqNullSafe(F.col("s")) & (F.col("parent_no") == F.col("l")), "left").drop("s", "l")


def ordered_turns(lines: DataFrame, named: bool = False) -> DataFrame:
    """The turns of ``filled_instants(unique_lines(..))`` in Kahn's order (see ``TURN``); written once, as they are read more than once.

    ``named``: ``parent_no`` counts.
    """
    none = F.lit(None).cast("int")
    turns = lines.where("is_turn").select("session_id", "instant_ms", "line_no", "role", "parent_no")
    if named:
        placed = _placed(turns.withColumn("parent_no", F.when(F.col("parent_no") != F.col("line_no"), F.col("parent_no"))))
    else:
        placed = staged(turns.withColumns({"top_ms": F.col("instant_ms"), "top_line": F.col("line_no"), "depth": F.lit(0)}), "placed")
        placed = placed.withColumns({"parent_top_ms": none.cast("bigint"), "parent_top_line": none, "parent_depth": none, "parent_ms": none.cast("bigint")})
    n = placed.count()
    blocks = max(1, math.ceil(n / BLOCK_TURNS), min(lines.sparkSession.sparkContext.defaultParallelism, math.ceil(n / LEAST_TURNS)))
    ranged = placed.repartitionByRange(blocks, "session_id", *PLACE).withColumn("part", F.spark_partition_id())
    walked = staged(ranged.mapInArrow(_order, TURN), "turns")
    # Turns at the edges of blocks: two of each.
    following = F.lead("role").over(Window.partitionBy("session_id").orderBy("part", "place"))
    edges = walked.where("edge").withColumn("answered", F.coalesce("answered", following == "assistant", F.lit(False)))
    return walked.where(~F.col("edge")).unionByName(edges)


def _lines(messages: DataFrame, parent_col: str | None) -> DataFrame:
    """Unique lines, written once: read by the blocks, by what they hand on and by the check for empty sessions."""
    return staged(unique_lines(messages, parent_col=parent_col), "lines")


def conversation_defects(messages: DataFrame, parent_col: str | None = None) -> DataFrame:
    """``session_id, defect``: ``empty``, ``headless``, ``unanswered`` or ``cyclic``, one row per defect of a session.

    ``parent_col`` names a column with the ``line_no`` a line replies to, if there is one. Defined results: a line is counted once per (session_id,
    line_no); a null session is a session of its own; instants that can't be read or inferred go first; blank texts are no turns; a
    parent that is no turn of the session, or the line itself, doesn't count; other columns are ignored; an empty table gives no rows.
    """
    lines = _lines(messages, parent_col)
    turns = ordered_turns(filled_instants(lines), parent_col is not None)
    checked = turns.groupBy("session_id").agg(
        (F.min_by("role", F.struct("part", "place")) == "assistant").alias("headless"),
        F.bool_or(~F.col("answered")).alias("unanswered"),
        F.bool_or("cyclic").alias("cyclic"),
    )
    found = F.array(*[F.when(F.col(c), F.lit(c)) for c in ("headless", "unanswered", "cyclic")])
    some = checked.select("session_id", F.explode(F.array_compact(found)).alias("defect"))
    empty = lines.groupBy("session_id").agg(F.bool_or("is_turn").alias("some")).where(~F.col("some")).select("session_id", F.lit("empty").alias("defect"))
    return some.unionByName(empty)


def rebuild_conversations(messages: DataFrame, with_text: bool = True, parent_col: str | None = None) -> DataFrame:
    """Whole conversations: ``session_id, turn_no, role, instant_ms, line_no, reply_to`` and, if asked for, ``content_text``.

    Sessions with any defect are dropped. ``turn_no`` counts from 0 over all blocks of a session. Defined results as in
    ``conversation_defects``.
    """
    turns = ordered_turns(filled_instants(_lines(messages, parent_col)), parent_col is not None)
    whole = staged(
        turns.groupBy("session_id")
        .agg((F.min_by("role", F.struct("part", "place")) == "user").alias("headed"), F.bool_and("answered").alias("complete"), F.bool_or("cyclic").alias("cyclic"))
        .where(F.col("headed") & F.col("complete") & ~F.col("cyclic"))
        .select(F.col("session_id").alias("whole_id")),
        "whole",
    )
    # Places within a block become turn numbers by the counts of the blocks before.
    before = Window.partitionBy("session_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # So do replies: a turn may answer one that went before its block.
    last = {r: F.max_by("line_no", F.when(F.col("role") == r, F.col("place"))).alias(r) for r in ("user", "assistant")}
    offsets = (
        turns.groupBy("session_id", "part").agg(F.count("*").alias("n"), *last.values())
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select(
            F.col("session_id").alias("s"), F.col("part").alias("p"), "offset",
            *[F.last(r, ignorenulls=True).over(before).alias(f"last_{r}") for r in last],
        )
    )
    kept = turns.join(whole, F.col("session_id").eqNullSafe(F.col("whole_id")), "left_semi")
    numbered = kept.join(offsets, F.col("session_id").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select(
        "session_id",
        (F.col("offset") + F.col("place")).cast("bigint").alias("turn_no"),
        "role",
        "instant_ms",
        "line_no",
        F.coalesce("reply_to", F.when(F.col("role") == "user", F.col("last_assistant")).otherwise(F.col("last_user"))).alias("reply_to"),
    )
    if not with_text:
        return numbered
    # Only the texts of whole sessions are moved.
    texts = (
        messages.select("session_id", "line_no", "line_id", "content_text").join(whole, F.col("session_id").eqNullSafe(F.col("whole_id")), "left_semi")
        .groupBy("session_id", "line_no").agg(F.min_by("content_text", "line_id").alias("content_text"))
        .select(F.col("session_id").alias("s"), F.col("line_no").alias("l"), "content_text")
    )
    return numbered.join(texts, F.col("session_id").eqNullSafe(F.col("s")) & (F.col("line_no") == F.col("l"))).drop("s", "l")
