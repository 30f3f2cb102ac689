"""Blocks of raw lines against a reader that uses the json module."""

from __future__ import annotations

import json

from threadlake.operators.nested import block_table, line_table, shred_lines

BLOCK = ["line_id", "block_path", "parent_path", "block_type", "tool_ref"]


def ref(v):
    return "" if v is None else v if isinstance(v, str) else json.dumps(v)


def brute(line, raw):
    out = []

    def opened(content, parent):
        items = content if isinstance(content, list) else [content] if content else []
        for i, b in enumerate(items):
            path = f"{parent}.{i}" if parent else str(i)
            if isinstance(b, str):
                out.append((line, path, parent, "text", ""))
            elif isinstance(b, dict):
                kind = b.get("type") if isinstance(b.get("type"), str) else ""
                out.append((line, path, parent, kind, ref(b.get({"tool_use": "id", "tool_result": "tool_use_id"}.get(kind, "?")))))
                if kind == "tool_result":
                    opened(b.get("content"), path)

    try:
        top = json.loads(raw)
        msg = top.get("message")
        msg = json.loads(msg) if isinstance(msg, str) else msg
        opened(msg.get("content"), "")
    except (ValueError, AttributeError, TypeError):
        pass
    return out


CASES = [
    '{"message":{"content":"plain"}}',
    '{"message":{"content":""}}',
    '{"message":{"content":[]}}',
    '{"message":{"content":{}}}',
    '{"message":{"content":null}}',
    '{"message":null}',
    '{"type":"user"}',
    "{}",
    "",
    "  ",
    "[1,2]",
    '"text"',
    '{"message":{"content":[{"type":"text","text":"a \\" ] } b"}',
    '  {"message" : {"content": [ "x", {"type":"tool_use","id":"t1","input":{"a":[1,{"b":2}]}}, {"type":"new"}, {} ]}} ',
    '{"message":{"content":[{"type":"tool_result","tool_use_id":"t1","content":[{"type":"tool_result","content":[{"type":"text"},"deep"]},{"type":"image"}]}]}}',
    '{"message":{"content":[{"type":"tool_result","content":"s"},{"type":"tool_result","tool_use_id":null,"content":{"type":"text"}}]}}',
    '{"message":"{\\"content\\":[{\\"type\\":\\"text\\",\\"text\\":\\"\\u00e9\\\\\\\\\\"}]}"}',
    '{"message":"no json"}',
    '{"a":[[[]]],"message":{"content":[{"text":"€ 漢 \\ud83d\\ude00","type":"thinking"}]}}',
    '{"message":{"content":{"type":"tool_use","id":7}}}',
]


def test_against_json_module(spark):
    rows = [(i, raw, "own") for i, raw in enumerate(CASES)]
    rows += [(100, '{"message":{"content":[' + ",".join(['{"type":"text","text":"' + "y" * 50 + '"}'] * 20_000) + "]}}", "own")]  # very long
    df = spark.createDataFrame(rows, "line_id bigint, raw string, block_type string")
    got = sorted(tuple(r) for r in block_table(shred_lines(df)).select(*BLOCK).collect())
    assert got == sorted(b for i, raw, _ in rows for b in brute(i, raw))


def test_parents_exist_and_repeats_stay(spark):
    df = spark.createDataFrame([(1, CASES[14]), (1, CASES[14])], "line_id bigint, raw string")
    blocks = block_table(shred_lines(df)).collect()
    assert len(blocks) == 10
    assert {b.parent_path for b in blocks} <= {""} | {b.block_path for b in blocks}


def test_lines_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "{}"), (None, "{"), (4, '{"type":"user","cwd":"/x","message":{"role":"user"}}')], "line_id bigint, raw string")
    got = {r.line_id: (r.readable, r.line_type, r.cwd, r.role) for r in line_table(shred_lines(df)).collect()}
    assert got == {1: (False, None, None, None), 2: (False, None, None, None), 3: (True, None, None, None), None: (False, None, None, None), 4: (True, "user", "/x", "user")}
    assert shred_lines(df.limit(0)).count() == 0
