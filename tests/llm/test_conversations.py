"""Conversations against a plain reading of the rules."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from threadlake.llm import conversations
from threadlake.llm.conversations import conversation_defects, filled_instants, kahn_order, ordered_turns, rebuild_conversations, unique_lines

SCHEMA = "line_id bigint, session_id string, line_no int, type string, timestamp string, ismeta boolean, issidechain boolean, role string, content_text string, part int, place string"


def brute(rows):
    """(defects, turns of the whole conversations)."""
    sessions = defaultdict(dict)
    for r in sorted(rows, key=lambda r: r[0]):
        ms = int(r[4]) if r[4] and r[4].isdigit() else None
        line = sessions[r[1]].setdefault(r[2], [None, r])
        line[0] = ms if line[0] is None else line[0] if ms is None else min(ms, line[0])
    defects, whole = set(), []
    for session, lines in sessions.items():
        near, order = None, []
        for no in sorted(lines):
            near = lines[no][0] if lines[no][0] is not None else near
            order.append(((near is not None, near or 0, no), near, lines[no][1]))
        turns = []
        for _, ms, r in sorted(order, key=lambda x: x[0]):
            role = (r[7] or "").strip().lower()
            if r[3] in ("user", "assistant") and role == r[3] and not r[5] and not r[6] and r[8] and r[8].strip():
                turns.append((role, ms, r[2], r[8]))
        mine = set()
        if not turns:
            mine.add("empty")
        elif turns[0][0] == "assistant":
            mine.add("headless")
        if any(t[0] == "user" and (i + 1 == len(turns) or turns[i + 1][0] == "user") for i, t in enumerate(turns)):
            mine.add("unanswered")
        defects |= {(session, d) for d in mine}
        if not mine:
            for i, (role, ms, no, text) in enumerate(turns):
                reply = next((t[2] for t in reversed(turns[:i]) if t[0] != role), None)
                whole.append((session, i, role, ms, no, reply, text))
    return defects, sorted(whole, key=str)


def some_rows(seed, n_sessions=12):
    rng = random.Random(seed)
    rows, line_id = [], 0
    for s in range(n_sessions):
        n = 200 if not s else rng.randrange(1, 12)
        clean = rng.random() < 0.6 or not s
        for no in range(n):
            line_id += 1
            kind = ("user", "assistant")[no % 2] if clean else rng.choice(["user", "assistant", "system", None])
            role = kind and rng.choice([kind, kind.upper(), f" {kind} "]) if clean or rng.random() < 0.9 else None
            at = str(1_000_000 + no * 1000 // 3 * 3) if rng.random() < 0.8 else rng.choice([None, "soon", ""])
            flag = None if clean else rng.choice([None, False, False, True])
            rows.append((line_id, f"s{s}" if s != 3 else None, no, kind, at, flag, None, role, f"t{line_id}" if clean or rng.random() < 0.9 else rng.choice([None, " \n\t", ""]), 0, "x"))
        if clean and n % 2:
            rows.pop()
    for r in rng.sample(rows, 20):  # lines that arrive again
        line_id += 1
        rows.append((line_id, *r[1:]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_rules_over_partition_edges(spark, fixed_partitions, seed):
    rows = some_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    defects, whole = brute(rows)
    assert {tuple(r) for r in conversation_defects(df).collect()} == defects
    got = rebuild_conversations(df).select("session_id", "turn_no", "role", "instant_ms", "line_no", "reply_to", "content_text").collect()
    assert sorted(map(tuple, got), key=str) == whole
    assert any(w[0] == "s0" for w in whole)


def test_many_blocks(spark, monkeypatch):
    """Blocks of a few turns: every session crosses their edges, and the block's rows come in any order."""
    monkeypatch.setattr(conversations, "BLOCK_TURNS", 7)
    rows = some_rows(5)
    df = spark.createDataFrame(rows, SCHEMA)
    defects, whole = brute(rows)
    assert {tuple(r) for r in conversation_defects(df).collect()} == defects
    got = rebuild_conversations(df).select("session_id", "turn_no", "role", "instant_ms", "line_no", "reply_to", "content_text").collect()
    assert sorted(map(tuple, got), key=str) == whole


def linked(session, links, at=lambda no: no * 1000):
    """Lines of alternating speakers from ``(line_no, parent)``."""
    return [(hash((session, no)) % 10**9, session, no, ("user", "assistant")[no % 2], str(at(no)), None, None, ("user", "assistant")[no % 2], f"t{no}", parent) for no, parent in links]


LINKED = "line_id bigint, session_id string, line_no int, type string, timestamp string, ismeta boolean, issidechain boolean, role string, content_text string, parent int"


@pytest.mark.parametrize("block", [200_000, 3])
def test_named_parents(spark, monkeypatch, block):
    """Cycles come out as a defect; contradicting instants don't: a reply goes behind what it answers."""
    monkeypatch.setattr(conversations, "BLOCK_TURNS", block)
    n = 12
    chain = [(no, no - 1 if no else None) for no in range(n)]
    rows = linked("plain", chain)
    rows += linked("pair", [(no, 5 if no == 4 else p) for no, p in chain])  # 4 and 5 answer each other
    rows += linked("ring", [(no, n - 1 if not no else p) for no, p in chain])  # all of them on one cycle
    rows += linked("back", chain, lambda no: 100_000 - no * 1000)  # a clock that runs backwards
    rows += linked("late", chain, lambda no: 900_000 if not no else no * 1000)  # the first line is written last
    rows += linked("itself", [(no, no) for no in range(n)])  # no parents, then
    rows += linked("gone", [(no, 77 if no % 3 else p) for no, p in chain])
    df = spark.createDataFrame(rows, LINKED)
    assert {tuple(r) for r in conversation_defects(df, "parent").collect() if r.defect == "cyclic"} == {("pair", "cyclic"), ("ring", "cyclic")}
    got = defaultdict(list)
    for r in sorted(rebuild_conversations(df, parent_col="parent").collect(), key=lambda r: r.turn_no):
        got[r.session_id].append((r.turn_no, r.line_no, r.reply_to))
    assert set(got) == {"plain", "back", "late", "itself", "gone"}
    for s in ("plain", "back", "late"):
        assert got[s] == [(no, no, no - 1 if no else None) for no in range(n)]
    assert [x[1] for x in got["itself"]] == list(range(n))
    # Without the column the backward clock turns the conversation round: it then begins with the assistant.
    assert ("back", "headless") in {tuple(r) for r in conversation_defects(df).collect()}


def test_kahn_gives_the_order_of_a_branching_graph(spark, monkeypatch):
    """Ties by instant: a branch waits for its parent only."""
    monkeypatch.setattr(conversations, "LEAST_TURNS", 10**6)
    rng = random.Random(3)
    parent = {no: rng.randrange(no) if no else None for no in range(60)}
    at = {no: rng.randrange(50) for no in parent}
    df = spark.createDataFrame(linked("s", parent.items(), at.get), LINKED)
    lines = filled_instants(unique_lines(df, "parent"))
    got = [r.line_no for r in sorted(ordered_turns(lines, True).collect(), key=lambda r: r.place)]

    def place(no):
        path, x = [], no
        while x is not None:
            path.append((at[x], x))
            x = parent[x]
        return max(path), len(path), at[no], no

    assert got == sorted(parent, key=place)
    where = {no: i for i, no in enumerate(got)}
    assert all(where[p] < where[no] for no, p in parent.items() if p is not None)


def test_empty_table_and_no_text(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversation_defects(df).count() == 0
    assert rebuild_conversations(df, with_text=False).count() == 0


def test_kahn_order():
    assert kahn_order([[], [0], [0], [1, 2]], [(0,), (2,), (1,), (3,)]) == ([0, 2, 1, 3], [])
    assert kahn_order([[-1], []], [(5,), (1,)]) == ([1, 0], [])
    order, left = kahn_order([[1], [0], [], [0]], [(0,), (1,), (2,), (3,)])
    assert order == [2]
    assert left == [0, 1, 3]  # a cycle and what waits behind it
