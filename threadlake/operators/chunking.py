"""Heading-aware chunks with overlap: one input row at a time, no shuffle.

The sections of a text, trimmed, are laid out as one running text with a blank line between them. Every chunk is a span of that text: its offsets are chosen in
one pass over the sections' ends, with the places of line ends looked up by bisection, and the chunk texts are cut out last.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, OVERLAP = 3600, 540
_HEADING = re.compile(r"^#{1,6} .+$", re.M)
_BODY = re.compile(r"\S(?:[\s\S]*\S)?")
_GAP = "\n\n"


def _layout(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The running text and (start, end, place in the source) of each section in it; without headings the text itself."""
    cuts = [0, *(m.start() for m in _HEADING.finditer(text) if m.start()), len(text)]
    if len(cuts) == 2:
        return text, [(0, len(text), 0)]
    parts, sections, at = [], [], 0
    for source, stop in zip(cuts, cuts[1:], strict=False):
        body = _BODY.search(text, source, stop)
        if body:
            parts.append(body[0])
            sections.append((at, at + len(body[0]), source))
            at += len(body[0]) + len(_GAP)
    return _GAP.join(parts), sections


def _windows(run: str, lo: int, hi: int, target: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most ``target`` that cover ``lo..hi``: each ends at the last blank line of its second half, else the last line end there, else where it is full."""
    marks = [[m.start() for m in re.finditer(pattern, run[lo:hi])] for pattern in (r"\n(?=\n)", r"\n")]
    spans, at, size = [], 0, hi - lo
    while at + target < size:
        full = at + target
        near = (some[bisect_right(some, full) - 1] for some in marks if some and some[0] <= full)
        stop = next((x for x in near if x > at + target / 2), full)
        spans.append((lo + at, lo + stop))
        at = max(at + 1, stop - overlap)
    return [*spans, (lo + at, hi)]


def chunk_spans(text: str, target: int = TARGET, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int, int]]]:
    """The running text and (start, end, place in the source) of each chunk in it.

    Sections are taken in while the chunk stays within ``target``. One that doesn't fit begins the next chunk behind the last ``overlap`` characters of this one,
    and stays whole: only a first section that alone is too long is cut (``_windows``). So a chunk can exceed the target; that is the defined behaviour. The
    place of a chunk that begins with an overlap is counted back in the running text.
    """
    if len(text) <= target:
        return text, [(0, len(text), 0)]
    run, sections = _layout(text)
    done: list[tuple[int, int, int]] = []
    start = stop = place = 0
    for no, (lo, hi, source) in enumerate(sections):
        if not no:
            *cut, (start, stop) = _windows(run, lo, hi, target, overlap)
            done += [(a, b, source + a - lo) for a, b in cut]
            place = source + start - lo
            body = _BODY.search(run, start, stop)
            start = body.start() if body else stop  # the place keeps the blanks before it
        elif hi - start <= target:
            stop = hi
        else:
            done.append((start, stop, place))
            back = max(start, stop - overlap)
            place, start, stop = place + back - start, back, hi
    if run[start:stop].strip():
        done.append((start, stop, place))
    return run, done


def chunk_text(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """(chunk, place) of a text; chunks are trimmed unless the text is a single one."""
    run, spans = chunk_spans(text, target, overlap)
    return [(run[a:b] if len(text) <= target else run[a:b].strip(), place) for a, b, place in spans]


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, chunk_id, seq, pos, text``. Null texts give no chunk, empty ones one empty chunk; an empty table gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, f"{d}_{i}", i, p, c) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, (c, p) in enumerate(chunk_text(t, target, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "seq", "pos", "text"])

    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return kept.mapInPandas(run, "doc_id bigint, chunk_id string, seq int, pos int, text string")
