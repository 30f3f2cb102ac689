"""Cutting long texts into overlapping pieces at natural boundaries.

Every byte position of a text gets a boundary strength, segment by segment. A sparse table over (strength, position) answers "strongest
cut in this window, the rightmost of equals" in two look-ups. From each piece the next one starts ``overlap`` tokens
before the cut. Sizes are tokens of a byte-level vocabulary, one per UTF-8 byte. Rows are independent: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from threadlake.functions.text import utf8_size
from threadlake.schema import struct

#: Strengths: inside a character, between characters, after a blank, clause, sentence, line, paragraph, before a heading.
INSIDE, HARD, BLANK, CLAUSE, SENTENCE, LINE, PARAGRAPH, HEADING = range(-1, 7)
#: Characters after which a cut is natural, in UTF-8.
WIDE_BLANK, WIDE_MARKS = "　".encode(), [c.encode() for c in "。！？"]
#: Positions that are indexed at a time, so that memory doesn't grow with the text.
SEGMENT = 1 << 18


def _after(b: np.ndarray, mark: bytes) -> np.ndarray:
    """Flags the first byte of each place where the three-byte ``mark`` stands."""
    out = np.zeros(len(b), bool)
    if len(b) >= 3:
        out[:-2] = (b[:-2] == mark[0]) & (b[1:-1] == mark[1]) & (b[2:] == mark[2])
    return out


def boundaries(data: bytes, feeds_before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(strength of a cut before each byte, flags of the bytes that belong to break characters).

    ``feeds_before``: line feeds in the white space right before ``data``, if it is a part of a text.
    """
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    blank = (b == 32) | (b == 9)
    lf, cr = b == 10, b == 13
    wide_mark = np.zeros(n, bool)
    for mark in WIDE_MARKS:
        wide_mark |= _after(b, mark)
    wide_blank = _after(b, WIDE_BLANK)
    three = wide_mark | wide_blank
    broken = blank | lf | cr | three
    broken[1:] |= three[:-1]
    broken[2:] |= three[:-2]

    strength = np.zeros(n, np.int8)
    strength[(b & 0xC0) == 0x80] = INSIDE
    prev = np.zeros(n, np.uint8)
    prev[1:] = b[:-1]
    spaced = np.zeros(n, bool)  # a blank before this byte
    spaced[1:] = blank[:-1] | cr[:-1]
    spaced[3:] |= wide_blank[:-3]
    strength[spaced] = BLANK
    if n > 2:
        before = np.zeros(n, np.uint8)
        before[2:] = b[:-2]
        tight = np.zeros(n, bool)
        tight[2:] = blank[1:-1]
        strength[tight & np.isin(before, [44, 58, 59])] = CLAUSE
        strength[tight & np.isin(before, [33, 46, 63])] = SENTENCE
    ended = np.zeros(n, bool)
    ended[3:] = wide_mark[:-3]
    strength[ended] = SENTENCE
    line = np.zeros(n, bool)
    line[1:] = lf[:-1]
    strength[line] = LINE
    # A paragraph ends where only blanks stand between two line feeds.
    at = np.arange(n, dtype=np.int32)
    solid = np.maximum.accumulate(np.where(~(blank | cr | lf), at, -1))
    feeds = np.cumsum(lf, dtype=np.int32)
    empty = np.zeros(n, bool)
    base = np.where(solid >= 0, feeds[solid], -feeds_before)
    empty[1:] = lf[:-1] & ((feeds - base)[:-1] >= 2)
    strength[empty] = PARAGRAPH
    strength[line & (b == 35)] = HEADING
    # Inside a run of white space only its end is worth more than a blank.
    inner = (strength > BLANK) & (blank | lf | cr)
    strength[inner] = BLANK
    return strength, broken


#: White space in UTF-8 that ends a paragraph's last line, and what ends an unbroken stretch.
_SPACES = b" \t\r\n"
_BREAK = re.compile(rb"[ \t\r\n]|" + b"|".join([WIDE_BLANK, *WIDE_MARKS]))
_STEP = 1 << 12


def _feeds_before(data: bytes, at: int) -> int:
    """Line feeds in the white space that ends at ``at``."""
    lo = at
    while lo > 0:
        part = data[max(0, lo - _STEP) : lo]
        left = len(part.rstrip(_SPACES))
        lo -= len(part) - left
        if left:
            break
    return data.count(b"\n", lo, at)


class CutIndex:
    """Sparse table for range maxima over boundary strengths of ``data``, built segment by segment: only a segment is ever held."""

    SHIFT = 24

    def __init__(self, data: bytes, window: int):
        self.data, self.window = data, window
        self.base = self.stop = -1
        if SEGMENT + window >= 1 << self.SHIFT:
            raise ValueError("the window is too large")

    def _build(self, lo: int) -> None:
        self.base, self.stop = lo, min(len(self.data), lo + SEGMENT + self.window)
        edge = max(0, lo - 3)  # a strength depends on the three bytes before, and on the white space before those
        strength, _ = boundaries(self.data[edge : self.stop], _feeds_before(self.data, edge))
        part = strength[lo - edge :].astype(np.int32)
        # Position in the low digits: of equal strengths the rightmost is largest.
        rows = [((part + 1) << self.SHIFT) + np.arange(len(part), dtype=np.int32)]
        step = 1
        while 2 * step <= min(self.window, len(part)):
            low = rows[-1]
            rows.append(np.maximum(low[:-step], low[step:]))
            step *= 2
        self.rows = rows

    def strongest(self, lo: int, hi: int) -> tuple[int, int]:
        """(position, strength) of the best cut in ``lo..hi``, both included."""
        if not (self.base <= lo and hi < self.stop) or self.base < 0:
            self._build(lo)
        a, z = lo - self.base, hi - self.base
        k = (z - a + 1).bit_length() - 1
        best = int(max(self.rows[k][a], self.rows[k][z - (1 << k) + 1]))
        return self.base + (best & ((1 << self.SHIFT) - 1)), (best >> self.SHIFT) - 1


def split_spans(data: bytes, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], CutIndex]:
    """((start, end, strength of the cut at the end) of each piece in bytes, the index they were found with)."""
    n, out, start = len(data), [], 0
    index = CutIndex(data, limit)
    while n - start > limit:
        cut, power = index.strongest(start + max(limit // 2, overlap + 1), start + limit)
        if power <= HARD:  # nothing natural in the upper half: look in the lower one
            low = index.strongest(start + overlap + 4, start + max(limit // 2, overlap + 5)) if overlap + 4 < limit // 2 else (cut, power)
            if low[1] > HARD:
                cut, power = low
        out.append((start, cut, power))
        start = cut - overlap
        while data[start] & 0xC0 == 0x80:
            start -= 1
    out.append((start, n, HEADING))
    return out, index


def _stretch(data: bytes, at: int) -> tuple[int, int]:
    """(start, end) of the stretch without a break around ``at``."""
    after = _BREAK.search(data, at)
    hi = at
    while hi > 0:
        lo = max(0, hi - _STEP)
        last = None
        for last in _BREAK.finditer(data, lo, min(at, hi + 2)):  # a break may lie across two steps
            pass
        if last:
            return last.end(), after.start() if after else len(data)
        hi = lo
    return 0, after.start() if after else len(data)


class _Chars:
    """Code points before a byte position, counted from the position asked last."""

    def __init__(self, data: bytes):
        self.bytes, self.at, self.n = np.frombuffer(data, np.uint8), 0, 0

    def before(self, at: int) -> int:
        lo, hi, sign = (self.at, at, 1) if at >= self.at else (at, self.at, -1)
        for a in range(lo, hi, SEGMENT):
            self.n += sign * int(np.count_nonzero((self.bytes[a : min(hi, a + SEGMENT)] & 0xC0) != 0x80))
        self.at = at
        return self.n


PIECE = struct(
    "doc_id bigint, piece_no int, n_pieces int, start_char bigint, end_char bigint, size bigint, cut_strength int, stretch_start bigint, stretch_size bigint, piece string"
)


def _pieces(doc_id: int, data: bytes, limit: int, overlap: int, with_text: bool) -> list[tuple]:
    spans, _ = split_spans(data, limit, overlap)
    chars = _Chars(data)
    rows, around, first = [], (0, -1), 0
    for no, (lo, hi, power) in enumerate(spans):
        start = chars.before(lo)
        stretch = (None, None)
        if power <= HARD:
            if not around[0] < hi <= around[1]:  # a long stretch holds many cuts
                around = _stretch(data, hi)
                first = chars.before(around[0])
            stretch = (first, around[1] - around[0])
        text = data[lo:hi].decode() if with_text else None
        rows.append((doc_id, no, len(spans), start, chars.before(hi), hi - lo, None if no == len(spans) - 1 else int(power), *stretch, text))
    return rows


def split_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, overlap: int = 128, with_text: bool = True
) -> DataFrame:
    """Pieces of the texts above ``limit`` tokens: at most ``limit`` each, consecutive ones share ``overlap`` tokens.

    A cut goes to the strongest boundary of the window, rightmost of equals; between two characters (strength 0) only where
    the window has no natural one, and then ``stretch_start``/``stretch_size`` (code points/tokens) tell the unbroken stretch it
    lies in. Where the overlap would begin inside a character it begins up to three tokens earlier, so pieces
    are valid text.

    Defined results: null, empty and shorter texts give no rows; repeated rows give repeated pieces; other columns are
    ignored; a text without any boundary is cut between characters; an empty table gives no rows.
    """
    if not 0 <= overlap < limit // 2 - 8:
        raise ValueError("overlap must be less than half the limit")
    arrow = to_arrow_schema(PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                new = _pieces(doc, text.as_py(), limit, overlap, with_text)
                rows += new
                size += len(text.as_py()) if with_text else 0
                if size > 8 << 20 or len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    long = docs.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`").alias("text")).where(utf8_size("text") > limit)
    return long.mapInArrow(run, PIECE)


def unbroken_stretches(pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """``doc_id, stretch_start`` of the stretches above ``limit`` tokens, which had to be cut between characters."""
    return pieces.where(F.col("stretch_size") > limit).select("doc_id", "stretch_start").distinct()
