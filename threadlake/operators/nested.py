"""Flat tables from deeply nested transcript lines.

Each Arrow batch of raw lines is indexed as a whole (see ``functions.jsonindex``); spans are then followed from the
line to its message, its content and the contents of results, and linked rows come out. There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from threadlake.functions.jsonindex import StructuralIndex
from threadlake.schema import struct

#: Bytes of JSON that are indexed at a time; a longer line is indexed alone.
SLICE_BYTES = 4 << 20
_STR, _OBJ, _ARR = 34, 123, 91

LINE_FIELDS = ["line_type", "line_timestamp", "cwd", "role"]
BLOCK_SCHEMA = (
    "line_id bigint, record string, block_path string, parent_path string, depth int, position int, block_type string, tool_ref string, "
    "tool_name string, body string, line_type string, line_timestamp string, cwd string, role string, n_blocks int, n_top_blocks int"
)


def _string(ix: StructuralIndex, m: dict[str, int], name: str) -> str | None:
    t = m.get(name)
    return ix.text(t) if t is not None and ix.kind[t] == _STR else None


def _ref(ix: StructuralIndex, m: dict[str, int], name: str) -> str:
    """An id as text: a string's value, a number as written, '' where it is absent or null."""
    t = m.get(name)
    if t is None or ix.raw(t) == "null":
        return ""
    return ix.text(t) if ix.kind[t] == _STR else ix.raw(t)


def _blocks(ix: StructuralIndex, content: int | None) -> list[tuple]:
    """(path, parent path, depth, position, type, tool ref, tool name, body) of every block below ``content``, outermost first."""
    out: list[tuple] = []
    todo = [(content, "", 0)]
    while todo:
        t, parent, depth = todo.pop()
        if t is None:
            continue
        if ix.kind[t] == _ARR:
            items = ix.elements(t)
        elif ix.kind[t] == _STR:
            items = [t] if ix.end[t] - ix.start[t] > 2 else []
        else:
            items = [t] if ix.kind[t] == _OBJ and ix.last[t] > ix.first[t] else []
        for i, e in enumerate(items):
            path = f"{parent}.{i}" if parent else str(i)
            if ix.kind[e] == _STR:
                out.append((path, parent, depth, i, "text", "", None, ix.text(e)))
            elif ix.kind[e] == _OBJ:
                m = ix.members(e)
                kind = _string(ix, m, "type") or ""
                ref = _ref(ix, m, "id") if kind == "tool_use" else _ref(ix, m, "tool_use_id") if kind == "tool_result" else ""
                body = _string(ix, m, kind) if kind in ("text", "thinking") else ix.raw(m["input"]) if kind == "tool_use" and "input" in m else None
                out.append((path, parent, depth, i, kind, ref, _string(ix, m, "name"), body))
                if kind == "tool_result":
                    todo.append((m.get("content"), path, depth + 1))
    return out


def _slices(ids: list, raws: list) -> Iterator[tuple[list, list[bytes]]]:
    some: tuple[list, list[bytes]] = ([], [])
    held = 0
    for i, raw in zip(ids, raws, strict=True):
        raw = raw or b""
        if held and held + len(raw) > SLICE_BYTES:
            yield some
            some, held = ([], []), 0
        some[0].append(i)
        some[1].append(raw)
        held += len(raw)
    if some[0]:
        yield some


def _shred(ids: list, raws: list[bytes]) -> list[tuple]:
    """Rows of ``BLOCK_SCHEMA`` for some lines: one ``line`` record each, then one ``block`` record per block."""
    ix = StructuralIndex(raws)
    rows: list[tuple] = []
    heads: list[tuple] = []  # id, line fields, index that holds the message, message token
    inner: list[bytes] = []
    for i, line in enumerate(ids):
        root = int(ix.root[i])
        if not ix.readable[i] or ix.kind[root] != _OBJ:
            rows.append((line, "unreadable", *[None] * 12, 0, 0))
            continue
        m = ix.members(root)
        msg = m.get("message")
        if msg is not None and ix.kind[msg] == _STR:
            inner.append(ix.text(msg).encode("utf-8", "surrogatepass"))
            msg = -len(inner)
        heads.append((line, (_string(ix, m, "type"), _string(ix, m, "timestamp"), _string(ix, m, "cwd")), msg))
    nested = StructuralIndex(inner) if inner else None
    for line, fields, msg in heads:
        at = ix
        if msg is not None and msg < 0:  # the message was JSON in a string
            at, k = nested, -msg - 1
            msg = int(nested.root[k]) if nested.readable[k] else None
        m = at.members(msg) if msg is not None and at.kind[msg] == _OBJ else {}
        blocks = _blocks(at, m.get("content"))
        rows.append((line, "line", *[None] * 8, *fields, _string(at, m, "role"), len(blocks), sum(b[2] == 0 for b in blocks)))
        rows.extend((line, "block", *block, *[None] * 6) for block in blocks)
    return rows


def shred_lines(lines: DataFrame, id_col: str = "line_id", raw_col: str = "raw") -> DataFrame:
    """Linked flat rows from raw JSON lines, in one pass; see ``line_table`` and ``block_table``.

    Defined results: null, empty, cut off or non-object lines give one ``unreadable`` record; of repeated member names
    the last holds; repeated rows give repeated records; other columns are ignored; an empty table gives no rows.
    """
    schema = struct(BLOCK_SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for some in _slices(ids, raws):
                cols = list(zip(*_shred(*some), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return lines.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{raw_col}`").cast("string")).mapInArrow(run, schema)


def block_table(records: DataFrame) -> DataFrame:
    """One row per content block, linked to its line and to the block that encloses it."""
    return records.where(F.col("record") == "block").select(
        "line_id", "block_path", "parent_path", "depth", "position", "block_type", "tool_ref", "tool_name", "body"
    )


def line_table(records: DataFrame) -> DataFrame:
    """One row per line, readable or not."""
    return records.where(F.col("record") != "block").select(
        "line_id", (F.col("record") == "line").alias("readable"), *LINE_FIELDS, "n_blocks", "n_top_blocks"
    )
