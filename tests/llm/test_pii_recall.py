"""Recall and precision on planted texts: names, phrases, numbers and streets of our own, which the finder's lists and cues don't hold.

README gives the figures.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import pytest

from threadlake.llm.pii import Finder, NameModel, WordShape, find_pii, gram_counts, learned_parts, ordinary_words, redact

GIVEN = "Siobhan Katarzyna Xiulan Olumide Priyanka Thorsten Anneliese Giuseppe Ximena Aurelien Bogdan Chiamaka Dmitri Eszter Fatoumata Gunnar Hiroshi Ingeborg Jacek Kwabena".split()
FAMILY = "Gallagher Wojcik Okonkwo Adeyemi Venkataraman Lindqvist Oberhauser Castellano Villalobos Beaumont Popescu Eze Sokolov Kovacs Diallo Halvorsen Nakamura Steinbach Nowak Mensah".split()
# A second set, which no threshold was looked at with.
HELD_GIVEN = "Beatrix Caoimhe Efua Farrukh Gwendolyn Hamza Ilse Jovana Kenji Lachlan Mirela Nkechi Odalys Pavel Qiang Rosalind Svetlana Tunde Ulrike Vasilis".split()
HELD_FAMILY = "Abernathy Bjornstad Cisneros Dubois Eriksen Fitzgerald Grigoryan Hashimoto Iyer Jankowski Kruger Lefebvre Mbeki Novotny Okafor Petrov Quiroga Rasmussen Schumacher Takahashi".split()
PERSON = [
    "Met with {} today about the rollout.", "author: {}", "Dear {}, the build is green.", "I had lunch with {} and we agreed on the schema.", "Ticket was filed by {} last week.", "cc {} on the thread please",
    "{} wrote the first draft of this.", "According to {}, the cache is cold.", "Please forward it to {} before noon.", "The on-call this week is {}.", "{}'s laptop needs a new key.", "Patient: {}, admitted at nine.",
]
PHONE = ["my cell is {}", "ring {} after six", "Fax {} for the forms", "reach the desk under {} any time", "Kontakt: {}"]
NUMBERS = ["+46 8 123 456 78", "+81 3-1234-5678", "+234 802 123 4567", "+39 06 1234 5678", "+1-415-555-0132", "(617) 555-0199", "+55 11 91234-5678", "+44 161 496 0123", "0161 496 0456", "+91 98765 43210"]
IDS = ["his SSN is 321-54-9876 on file", "social security number 219-09-9999", "NI no. JG 10 37 59 A", "passport number 533401829", "Passport: K0456789", "tax id 457-55-5462", "national insurance: YY 22 33 44 B"]
STREETS = ["48 Wellington Crescent", "7 Harbour View Lane", "221b Linden Avenue", "Kastanienallee 12", "Bergstraße 3a", "15 rue des Acacias", "Calle Serrano 41", "Via Garibaldi 9", "1600 N Juniper Drive", "Schillerplatz 8"]
HOME = ["she moved to {} in May", "Deliver the parcel to {} please.", "Home address {} (back door)", "He grew up at {} with two brothers."]
MAILS = ["t.lindqvist@posteo.example", "ximena+lists@correo.example.mx", "okonkwo_c@mail.example.ng", "kovacs (at) example (dot) hu", "b.popescu [at] example [dot] ro"]
WRITE = ["drop a line to {} today", "Reply-To: {}", "forwarded from {} yesterday", "mailto {} works"]
NOTHING = [
    "The Apache Spark Driver runs on Amazon Linux today.", "Visual Studio Code and Google Chrome are installed.", "See Section Four of the Release Notes.", "Added Support for Delta Tables in New York.",
    "error at 10.12.0.4:8080 after 1200345 ms, commit 4fd2a9c10b", "The Great Refactor of Monday Morning begins.", "Run Unit Tests, then Build Docker Image.", "Order 2024-11-05 has 1234567890 rows", "id 550e8400-e29b-41d4-a716-446655440000",
]


def planted(given: list[str] = GIVEN, family: list[str] = FAMILY) -> list[tuple[str, str, str]]:
    """(text, kind, passage)."""
    rng, out = random.Random(3), []
    for g in given:
        for frame in PERSON:
            name = f"{g} {rng.choice(family)}"
            out.append((frame.format(name), "person_name", name))
    out += [(f.format(x), "phone", x) for f in PHONE for x in NUMBERS]
    out += [(t, "id_number", re.search(r"[A-Z]{0,2} ?\d[\d -]{5,10}\d(?: [A-Z])?", t)[0].strip()) for t in IDS]
    out += [(f.format(x), "street_address", x) for f in HOME for x in STREETS]
    out += [(f.format(x), "email", x) for f in WRITE for x in MAILS]
    return out


def measured(finder: Finder, *names: list[str]) -> dict[str, tuple[float, float]]:
    """kind -> (recall, precision)."""
    hit, found, right = Counter(), Counter(), Counter()
    total = Counter(kind for _, kind, _ in planted(*names))
    for text, kind, passage in planted(*names):
        got = {(text[a:b], k) for a, b, k in finder.find(text)}
        hit[kind] += (passage, kind) in got
        for p, k in got:
            found[k] += 1
            right[k] += (p, k) == (passage, kind)
    for text in NOTHING:
        for *_, k in finder.find(text):
            found[k] += 1
    return {k: (round(hit[k] / total[k], 3), round(right[k] / max(1, found[k]), 3)) for k in total}


def known_names() -> tuple[list[str], list[str]]:
    pq = pytest.importorskip("pyarrow.parquet")
    path = Path("/root/testdata/sf0.001/known_names.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    rows = pq.read_table(path).to_pylist()
    return tuple([r["form"] for r in rows if r["name_part"] == p and r["form"]] for p in ("given", "family"))


def ordinary() -> list[str]:
    """The words of the smallest table, as ``ordinary_words`` has them."""
    rows = pytest.importorskip("pyarrow.parquet").read_table("/root/testdata/sf0.001/messages.parquet", columns=["content_text"])["content_text"].to_pylist()
    counts = Counter(w for t in rows if t for w in set(re.findall(r"(?<![\w'’-])[a-zß-öø-ÿ]{3,}(?![\w'’-])", t)))
    return [w for w, n in counts.items() if n > 1]


def test_recall_and_precision():
    given, family = known_names()
    assert not {w.lower() for w in [*GIVEN, *HELD_GIVEN]} & {w.lower() for w in given}
    assert not {w.lower() for w in [*FAMILY, *HELD_FAMILY]} & {w.lower() for w in family}
    by_cue = measured(Finder(NameModel(given, family)))
    assert by_cue["person_name"][0] >= 0.4  # without ordinary words: behind a cue only
    finder = Finder(NameModel(given, family, ordinary=ordinary()))
    for names in ((GIVEN, FAMILY), (HELD_GIVEN, HELD_FAMILY)):
        got = measured(finder, *names)
        for kind in ("email", "phone", "id_number", "street_address", "person_name"):
            assert min(got[kind]) >= 0.9, (kind, got[kind])


def test_ordinary_words(spark):
    df = spark.createDataFrame([("some words here",), ("Some words, there_is",), ("words",), (None,), ("",), ("here ab here",)], "text string")
    assert ordinary_words(df, "text") == ["here", "words"]
    assert ordinary_words(df, "text", most=1) == ["words"]
    assert ordinary_words(df.limit(0), "text") == []


def test_ordinary_words_of_all_texts(spark):
    """60,000 words, each in two of 120,000 texts: neither texts nor words are left out."""
    df = spark.range(120_000).selectExpr("concat('w', translate(lpad(cast(id % 60000 as string), 5, '0'), '0123456789', 'abcdefghij')) text")
    assert len(ordinary_words(df, "text")) == 60_000


def model_tables(spark):
    given, family = known_names()
    listed = spark.createDataFrame([*[("given", w) for w in given], *[("family", w) for w in family]], "name_part string, form string")
    texts = [*[text for text, *_ in planted()], *NOTHING, None, "", "THE QUESTION Maria Lindqvist", "well-known Siobhan Gallagher", "The Siobhan Gallagher file"]
    return listed, spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame([(w,) for w in ordinary()], "word string")


def test_models_of_lists_of_any_size(spark):
    """What Spark learns of a list is what is learned of a list that is held."""
    listed, _, words = model_tables(spark)
    given, family = known_names()
    model = NameModel(given, family)
    listed = listed.selectExpr("name_part part", "lower(form) word").distinct()
    assert learned_parts(listed) == model.parts
    assert any(learned_parts(listed)[0])
    assert gram_counts(listed.where("part = 'given'")) == WordShape.counts(model.known[0])
    assert gram_counts(words) == WordShape.counts(ordinary())
    assert gram_counts(words.limit(0)) == {}


@pytest.mark.parametrize("bounds", [{"max_names": 1}, {"max_words": 1}, {"max_names": 1, "max_words": 1}])
def test_long_lists_change_no_result(spark, bounds):
    listed, texts, words = model_tables(spark)
    held = sorted(find_pii(texts, "id", "text", listed, ordinary=ordinary()).collect())
    assert sorted(find_pii(texts, "id", "text", listed, ordinary=words).collect()) == held
    assert sorted(find_pii(texts, "id", "text", listed, ordinary=words, **bounds).collect()) == held
    assert sum(r.kind == "person_name" for r in held) > 200
    clean = sorted(redact(texts, "id", "text", listed, b"k", ordinary=words).collect())
    assert sorted(redact(texts, "id", "text", listed, b"k", ordinary=words, **bounds).collect()) == clean
