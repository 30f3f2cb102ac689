"""Chunks of texts: written cases, and what must hold for every text."""

from __future__ import annotations

import random

import pytest

from threadlake.operators.chunking import OVERLAP, TARGET, chunk_documents, chunk_spans, chunk_text

TWO = "## One\n" + "A" * 2000 + "\n## Two\n" + "B" * 2000


def test_short_texts_are_one_chunk():
    for text in ("", "Hello", "  padded \n", "x" * TARGET):
        assert chunk_text(text) == [(text, 0)]


def test_sections_break_at_headings_with_overlap():
    (first, at), (second, then) = chunk_text(TWO)
    assert (at, first) == (0, "## One\n" + "A" * 2000)
    assert second == "A" * OVERLAP + "\n\n## Two\n" + "B" * 2000
    assert then == len(first) - OVERLAP


def test_long_text_without_headings_is_cut_where_it_is_full():
    chunks = chunk_text("x" * (2 * TARGET + 1000))
    assert [(len(c), p) for c, p in chunks] == [(3600, 0), (3600, 3060), (2080, 6120)]


def test_cuts_prefer_blank_lines_then_line_ends():
    para = "word " * 360
    chunks = chunk_text(f"{para}\n\n{para}\n\n{para}")
    assert len(chunks) >= 2
    assert all(not c[0].isspace() and c.endswith("word") for c, _ in chunks)
    lines = ("y" * 99 + "\n") * 60
    assert all(len(c) % 100 == 99 for c, _ in chunk_text(lines)[:-1])


def test_a_long_section_stays_whole_behind_another():
    text = "# a\n" + "A" * 100 + "\n# b\n" + "B" * 9000
    assert [len(c) for c, _ in chunk_text(text)] == [104, 104 + 2 + 4 + 9000]


@pytest.mark.parametrize("seed", range(4))
def test_nothing_is_lost(seed):
    """Chunks follow one another in the running text, overlap as asked, and leave out blanks only."""
    rng = random.Random(seed)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bb ", "\n", "\n\n", "# h\n", "## x y\n", " ", "é😀"]) for _ in range(rng.randrange(120)))
        run, spans = chunk_spans(text, 30, 6)
        assert "".join(run.split()) == "".join(text.split())
        upto = 0
        for a, b, _ in spans:
            assert not run[upto:a].strip()
            assert a <= upto or not run[upto:a].strip()
            assert upto - a <= 6 or a == 0
            upto = max(upto, b)
        assert not run[upto:].strip()
        places = [p for *_, p in spans]
        assert places == sorted(places)


def test_documents(spark):
    rows = [(1, TWO, "x", 0), (2, None, "x", 0), (3, "", "x", 0), (1, TWO, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, chunk_id string, pos int")
    got = [(r.chunk_id, r.seq, len(r.text)) for r in chunk_documents(df).collect()]
    assert sorted(got) == sorted([("1_0", 0, 2007), ("1_1", 1, 2549)] * 2 + [("3_0", 0, 0)])
    assert chunk_documents(df.limit(0)).count() == 0
