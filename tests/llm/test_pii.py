"""Finding personal information in marked texts; pseudonyms as keyed permutations."""

from __future__ import annotations

import re

import pytest

from threadlake.llm.pii import Finder, NameModel, Pseudonyms, country_code, find_pii, redact, scan_pii

NAMES = [(1, "given", "Maria"), (2, "given", "John"), (3, "family", "Keller"), (4, "family", "Smith"), (5, "given", None)]
NAME_SCHEMA = "name_id int, name_part string, form string"
TEXTS = {
    "mail": ("write to anna.b+x@mail.example.org, please", {("email", "annabxmailexampleorg")}),
    "mail_words": ("reach me: jo [at] example [dot] com", {("email", "joatexampledotcom")}),
    "machine": ("git@host.example.com and noreply@example.com", set()),
    "phone": ("call +44 20 7946 0958 now", {("phone", "442079460958")}),
    "phone_us": ("(212) 555-0147.", {("phone", "2125550147")}),
    "ssn": ("SSN: 123-45-6789", {("id_number", "123456789")}),
    "no_ssn": ("code 000-12-3456 and 666-12-3456", set()),
    "nino": ("NI number AB 12 34 56 C", {("id_number", "ab123456c")}),
    "passport": ("passport no. X1234567", {("id_number", "x1234567")}),
    "street": ("lives at 12b Baker Street, flat 3", {("street_address", "12bbakerstreet")}),
    "street_de": ("Lindenstraße 7 in Bonn", {("street_address", "lindenstraße7")}),
    "street_fr": ("12 rue de la Paix", {("street_address", "12ruedelapaix")}),
    "name": ("asked Maria Keller about it", {("person_name", "mariakeller")}),
    "turned": ("Keller, Maria signed", {("person_name", "kellermaria")}),
    "initial": ("thanks J. Smith!", {("person_name", "jsmith")}),
    "alone": ("Maria said Smith knows", set()),
    "version": ("v1.2.3.4 at 2024-01-02T03:04:05Z, 10.0.0.1, build 20240102", set()),
    "twice": ("Maria Keller and Maria Keller", {("person_name", "mariakeller")}),
    "empty": ("", set()),
    "null": (None, set()),
    "long": ("filler text " * 200_000 + "SSN 123-45-6789", {("id_number", "123456789")}),
}


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(NAMES, NAME_SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(k, v[0], "own", 1) for k, v in TEXTS.items()], "id string, text string, kind string, value int")


def test_found(texts, names):
    got = {k: set() for k in TEXTS}
    for r in find_pii(texts, "id", "text", names).collect():
        got[r.row_key].add((r.kind, r.value))
    assert got == {k: v[1] for k, v in TEXTS.items()}


def test_redacted_text_keeps_the_rest(texts, names):
    got = {r.row_key: r for r in redact(texts, "id", "text", names, b"k").collect()}
    assert len(got) == len(TEXTS)
    assert got["null"].text is None
    assert re.fullmatch(r"write to \[EMAIL [0-9a-f]{20}\], please", got["mail"].text)
    assert re.fullmatch(r"SSN: \[ID_NUMBER \d{3}-\d\d-\d{4}\]", got["ssn"].text)
    assert "6789" not in got["ssn"].text
    assert got["alone"].text == TEXTS["alone"][0]
    assert len(set(re.findall(r"\[PERSON_NAME \w+\]", got["twice"].text + got["name"].text + got["turned"].text))) == 1  # linked however written
    assert got["long"].text.startswith("filler text " * 200_000)
    assert got["long"].text.endswith(got["ssn"].text.split()[-1])


def test_empty_tables(spark, texts, names):
    assert find_pii(texts.limit(0), "id", "text", names).count() == 0
    only_formats = {r.kind for r in find_pii(texts, "id", "text", names.limit(0)).collect()}
    assert only_formats == {"email", "phone", "id_number", "street_address"}


def test_feistel_is_a_keyed_permutation():
    p, q = Pseudonyms(b"one"), Pseudonyms(b"two")
    every = [f"{i:03}" for i in range(1000)]
    image = [p.digits(d, "t") for d in every]
    assert sorted(image) == every
    assert [p.undo(d, "t") for d in image] == every
    assert image != [q.digits(d, "t") for d in every]
    kept = [d for d in every if d[0] != "0"]
    assert sorted(p.within(d, "t", lambda x: x[0] != "0") for d in kept) == kept


def test_equal_numbers_stay_linked():
    p = Pseudonyms(b"one")
    a, b = p.phone("+1 (212) 555-0147"), p.phone("212-555-0147")
    assert re.sub(r"\D", "", a)[1:] == re.sub(r"\D", "", b)
    assert p.id_number("123456789") == p.id_number("123-45-6789").replace("-", "")
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", p.birth_date("1980-02-29"))


MAILS = (
    "jo@a.org", "JO @ A.ORG", "jane.doe { at } example.org", "jane < AT > example.org", "jane [  at  ] example.org", "jane(\tat\t)example.org",
    "jane{at}example{dot}org", "jane<at>example < dot > org", "jo at example\tdot\torg", "jo\nAt\nexample\nDOT\norg",
)
ADDRESSES = (
    "12b Baker Street", "7 N. Oak  Hill  ROAD", "7  WEST Élan Ave", "12 rue Ampère", "12 bis rue de la Paix", "12 bis, rue de la Paix", "3 ter, rUE d’Alésia", "4b, allée des Lilas",
    "Calle Mayor 5", "VIA della Spiga, 12", "Rua do Ouro  9b", "Lindenstr. 12b", "Hauptstr. 5", "Ahorn-STR. 5", "Lindenstraße 7", "HAUPTSTRASSE 7", "Mühlweg 3", "Seeufer\t8",
)
NUMBERS = (
    "PAſſPORT no. X1234567", "passport 1 2 3 4 5 6", "AB123456C", "ab 12 34 56 c", "+1 (212) 555-0147", "0044 (20) 7946 0958", "(212)555-0147", "tel: 02079460958",
    "123-45-6789", "ssn 123 45 6789", "date of bİrth: 1980-02-29", "DOB=1980/02/29",
)
PEOPLE = ("Maria O'Brien", "O’Brien, Maria", "O'Brien, M.", "J. O'Brien", "maria keller", "Dana-Lee O'Brien")


@pytest.mark.parametrize("passage", [*MAILS, *ADDRESSES, *NUMBERS, *PEOPLE])
def test_gates_pass_every_spelling(passage):
    """The cheap tests lose nothing that the patterns find, whatever else the text holds."""
    names = (["maria", "dana-lee"], ["keller", "o'brien", "o’brien"])
    gated, whole = Finder(NameModel(*names)), Finder(NameModel(*names), gates=False)
    for text in (passage, f"so: {passage}", f"sie wohnt dort: {passage} seit mai", f"{passage}\n"):
        assert gated.find(text) == whole.find(text)
    if passage not in ("ab 12 34 56 c",):  # no label
        assert whole.find(f"so: {passage}")


CUED = {
    "Signed-off-by: Wolfgang Kurz <w@k.org>": "Wolfgang Kurz",
    "co-authored-by: Élodie McBride": "Élodie McBride",
    "Dear Ingrid Haller, thanks": "Ingrid Haller",
    "Dear Dr. Ingrid Haller,": "Ingrid Haller",
    "bug reported by Jean-Luc O’Neal yesterday": "Jean-Luc O’Neal",
    '{"author": "Wolfgang Kurz"}': "Wolfgang Kurz",
    "Author:     WOLFGANG KURZ": "WOLFGANG KURZ",
    "customer record: Kurz, Wolfgang | 12": "Kurz, Wolfgang",
    "Author: W. Kurz": "W. Kurz",
    "Author: Kurz, W.": "Kurz, W",
}
NOT_CUED = (
    "Dear Hiring Manager", "Dear Customer Support Team", "Dear Acme Support Team", "Author: Release Bot", "author = ReadOnly Thing", "Dear Ingrid, Thomas and all", "self.author = Some Value",
    "Wolfgang Kurz", "Author: Ingrid", "Author: Kurz, Haller, Meier", "reported by Static Analysis", "Signed-off-by: Wolfgang\nKurz", "author: Unknown Author", "Author: see Foo Bar",
)


@pytest.mark.parametrize("gates", [True, False])
def test_strong_cue_proposes_names_outside_the_list(gates):
    finder = Finder(NameModel(["maria"], ["keller"]), gates)
    for text, name in CUED.items():
        text = f"so it is. {text}"
        assert [text[a:b] for a, b, kind in finder.find(text) if kind == "person_name"] == [name], text
    for text in NOT_CUED:
        assert finder.find(f"so it is. {text}") == [], text


def test_whole_format_is_permuted():
    p = Pseudonyms(b"one")
    every = [f"{i // 26 % 10}{chr(65 + i % 26)}{i // 260}" for i in range(2600)]
    assert sorted(p.mixed(x, "t") for x in every) == sorted(every)
    ninos = [f"{a}B 12 34 {i:02} C" for a in "ABCEGH" for i in range(50)]
    got = [p.id_number(x) for x in ninos]
    assert all(re.fullmatch(r"[A-Z]{2} \d\d \d\d \d\d [A-D]", x) for x in got)
    assert len(set(got)) == 300
    assert len({x[:2] for x in got}) > 100  # the letters don't stay
    assert p.id_number("ab123456c") == p.id_number("AB 12 34 56 C").replace(" ", "").lower()
    assert p.id_number("x1234567")[0].islower()
    assert len({p.id_number(f"123-45-{i}")[0] for i in range(1000, 1100)}) > 5
    assert len({p.phone(f"+44 20 7946 {i}")[4] for i in range(1000, 1100)}) > 5
    assert all(re.fullmatch(r"\+44 [2-9]\d \d{4} \d{4}", p.phone(f"+44 20 7946 {i}")) for i in range(1000, 1100))
    assert re.fullmatch(r"\(0[2-9]\d\d\) \d{3} \d{4}", p.phone("(0207) 946 0958"))
    assert p.phone("+1 212 555 0147")[:3] == "+1 "
    far = ["1899-12-31", "1850-01-01", "0001-01-01", "2050-08-03", "2060-05-05", "9999-12-31"]
    dates = [p.birth_date(x) for x in far]
    assert len(set(dates)) == len(far)
    assert not {"0000-00-00", *far} & set(dates)
    assert len({p.id_number(f"{a}00123456") for a in "0123456789"} | {p.id_number(f"{a}00-12-3456") for a in "12"}) == 12
    assert len({p.phone(f"{a}12-{b}55-0147") for a in "23456789" for b in range(10)}) == 80


def test_every_pseudonym_can_be_undone():
    """Numbers and dates come back from their pseudonyms, in every spelling, also those that break a rule of their format."""
    p = Pseudonyms(b"one")
    phones = ["+33 1 23 45 67 89", "+33123456789", "0033 1 23 45 67 89", "+44 (0)20 7946 0958", "+44 1632 960123", "+441632960123", "(0207) 946 0958", "212-555-0147", "+1 (212) 555-0147",
              "+1 112 055 0147", "+49 30 123456", "+4930123456", "+353 1 234 5678", "+7 495 123-45-67", "02079460958", "0044 (20) 7946 0958"]
    ids = ["123-45-6789", "123 45 6789", "000123456", "AB 12 34 56 C", "ab123456d", "X1234567", "12 34 56", "QQ123456Z"]
    dates = ["1980-02-29", "1899/12/31", "0001.01.01", "2050-08-03", "9999-12-31", "2000-01-01"]
    for kind, some in (("phone", phones), ("id_number", ids), ("birth_date", dates)):
        for x in some:
            y = p.of(x, kind)
            assert p.restored(y, kind) == x
            assert [c for c in y if not c.isalnum()] == [c for c in x if not c.isalnum()]


def test_country_codes_dont_depend_on_spaces():
    p = Pseudonyms(b"one")
    for a, b in (("+33 1 23 45 67 89", "+33123456789"), ("+49 30 123456", "+4930123456"), ("+353 1 234 5678", "+35312345678"), ("+44 (0)20 7946 0958", "+442079460958")):
        digits = ["".join(c for c in p.phone(x).replace("(0)", "") if c.isdigit()) for x in (a, b)]
        assert digits[0] == digits[1]
    assert [country_code(x) for x in ("12125550147", "74951234567", "331234", "3531234", "2071234")] == ["1", "7", "33", "353", "20"]


def test_tags_are_wide_enough():
    p = Pseudonyms(b"one")
    assert len({p.tag(str(i), "email") for i in range(2000)}) == 2000
    assert len(p.tag("x", "email")) * 4 == 80


def test_found_and_replaced_in_one_pass(texts, names):
    got = [r for r in scan_pii(texts, "id", "text", names, b"k").collect() if r.row_key == "ssn"]
    clean = next(r for r in redact(texts, "id", "text", names, b"k").collect() if r.row_key == "ssn")
    assert f"[ID_NUMBER {got[0].pseudonym}]" in clean.text
    assert got[0].value == "123456789"


def test_a_list_of_any_size(texts, names):
    """Names above the bound are found through a join with the texts' words."""
    got = {k: set() for k in TEXTS}
    for r in find_pii(texts, "id", "text", names, max_names=1).collect():
        got[r.row_key].add((r.kind, r.value))
    assert got == {k: v[1] for k, v in TEXTS.items()}
    assert {r.row_key: r.n_found for r in redact(texts, "id", "text", names, b"k", max_names=1).collect()}["twice"] == 2
