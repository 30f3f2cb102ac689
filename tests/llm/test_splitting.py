"""Pieces: exact round trip, sizes, overlap, and the strongest cut by looking at every position."""

from __future__ import annotations

import random
import re

import pytest

from threadlake.llm import splitting
from threadlake.llm.splitting import HARD, boundaries, split_documents, split_spans, unbroken_stretches

SCHEMA = "doc_id bigint, text string, piece string, size int"


def some_text(seed):
    rng = random.Random(seed)
    bits = ["word", "naïve", "漢字", "。", "！", " ", " ", "\t", "\n", "\n\n", "\r\n", "\n# Head ", ". ", ", ", "　", "😀", "x" * 90, "é" * 60]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(80, 500)))


@pytest.mark.parametrize("seed", range(12))
def test_strongest_cut_of_each_window(seed):
    data, limit, overlap = some_text(seed).encode(), 120, 15
    strength, _ = boundaries(data)
    spans, _ = split_spans(data, limit, overlap)
    assert spans[0][0] == 0
    assert spans[-1][1] == len(data)
    for (lo, hi, power), (nxt, _, _) in zip(spans, spans[1:]):
        assert 0 < hi - lo <= limit
        assert overlap <= hi - nxt <= overlap + 3
        assert nxt > lo
        window = range(lo + limit // 2, lo + limit + 1)
        best = max(window, key=lambda i: (strength[i], i))
        if strength[best] > HARD:
            assert (hi, power) == (best, strength[best])
        data[lo:hi].decode()


def test_documents(spark):
    texts = {i: some_text(i) for i in range(20)} | {50: None, 51: "", 52: "short", 53: "z" * 5000, 54: "a" * 200 + " " + "漢" * 100, 55: "y" * 120}
    df = spark.createDataFrame([(k, v, "own", 1) for k, v in texts.items()] + [(53, texts[53], "again", 1)], SCHEMA)
    pieces = split_documents(df, limit=120, overlap=15)
    by_doc = {}
    for r in pieces.collect():
        by_doc.setdefault(r.doc_id, {})[r.piece_no] = r
    assert set(by_doc) == {k for k, v in texts.items() if v and len(v.encode()) > 120}
    for k, mine in by_doc.items():
        at, text = 0, ""
        for no in sorted(mine):
            r = mine[no]
            assert r["size"] == len(r.piece.encode()) <= 120
            assert texts[k][r.start_char : r.end_char] == r.piece
            text += r.piece[at - r.start_char :]
            at = r.end_char
        assert text == texts[k]
    want = {
        (k, m.start()) for k in by_doc for m in re.finditer("[^ \t\r\n　。！？]+", texts[k]) if len(m[0].encode()) > 120
    }
    assert {tuple(r) for r in unbroken_stretches(pieces, 120).collect()} == want
    assert (54, 201) in want
    assert split_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        split_documents(df, limit=100, overlap=60)


def test_segments_give_the_same_pieces(monkeypatch):
    """Boundaries and stretches don't depend on where a segment ends, also in the middle of white space or of a character."""
    rng = random.Random(7)
    parts = ["a", "bb ", "\n", "\n\n", "# h\n", " ", "é", "。", "　", "word, ", "end. ", "x" * 70, "\r\n", " " * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40, 150))).encode() for _ in range(200)]
    texts = [t for t in texts if len(t) > 64]
    whole = [splitting._pieces(1, t, 64, 8, True) for t in texts]
    monkeypatch.setattr(splitting, "SEGMENT", 50)
    monkeypatch.setattr(splitting, "_STEP", 5)
    assert [splitting._pieces(1, t, 64, 8, True) for t in texts] == whole
    assert len(splitting._pieces(1, b"x" * 100_000, 64, 8, False)) > 1000
