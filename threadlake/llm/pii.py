"""Personal information in free text: finding it and replacing it with typed placeholders.

Formats (mail addresses, phone and identity numbers, street addresses) are found by patterns and validated; names of people by the
list of known names and, for names that aren't in it, by word parts learned from that list. A placeholder keeps a pseudonym: numbers and
dates are permuted by a keyed Feistel network within their own format, so the text stays readable and equal values stay
linked in all documents, however they are written; words get a keyed tag. Rows are independent: no shuffle, but for word lists too long for a task.
"""

from __future__ import annotations

import copy
import datetime as dt
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from threadlake.schema import struct
from threadlake.session import staged

PERMUTED = ("phone", "id_number", "birth_date")
KINDS = ("email", "phone", "id_number", "street_address", "person_name", "birth_date")

# Accounts that belong to no person, and words of street names in several languages.
MACHINE = frozenset("git root deploy noreply no-reply donotreply do-not-reply bot ci build cron daemon mailer-daemon postmaster nobody hg svn www-data system jenkins actions".split())
STREET_AFTER = "Street St Road Rd Avenue Ave Lane Ln Boulevard Blvd Drive Dr Court Ct Place Pl Square Sq Terrace Way Close Crescent Highway Hwy Parkway Row Gardens Grove Hill Walk Mews".split()
STREET_BEFORE_FR = "rue avenue boulevard place chemin quai impasse allée cours route square".split()
STREET_BEFORE = "Calle Avenida Paseo Plaza Camino Via Viale Piazza Corso Vicolo Rua Travessa Largo Praça Carrer".split()
STREET_END_DE = "straße strasse str. gasse weg platz allee ring damm ufer".split()


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
EMAIL = re.compile(
    rf"""(?xi) (?<![\w.+@/%-]) (?P<local> [^\W_](?:[\w.+%-]*[\w+])? )
    (?: (?: @ | \s@\s ) {_LABEL} (?: \.{_LABEL} )*? \.[a-z]{{2,24}}
      | \s? [\[({{<] \s* at \s* [\])}}>] \s? {_LABEL} (?: (?: \s? [\[({{<] \s* dot \s* [\])}}>] \s? | \s+dot\s+ | \. ) {_LABEL} )+
      | \s+at\s+ {_LABEL} (?: \s+dot\s+ {_LABEL} )+ )
    (?![\w@]|-\w|\.\w)"""
)
_SEP = r"[ .\-\u00a0\u2009\u2010\u2011\u2012\u2013\u202f]"
PHONE = re.compile(
    rf"""(?x) (?<![\w+./@#‑-])
    (?: \+ [1-9]\d{{0,2}} (?: {_SEP}? \(?\d{{1,5}}\)? (?: {_SEP}? \d{{2,5}} ){{1,4}} )
      | 00 [1-9]\d{{0,2}} {_SEP} \(?\d{{1,11}}\)? (?: {_SEP} \d{{2,5}} ){{0,4}}
      | \(\d{{3}}\) {_SEP}? \d{{3}} {_SEP} \d{{4}}
      | \d{{3}} (?P<s> {_SEP} ) \d{{3}} (?P=s) \d{{4}}
      | \(? 0\d{{2,4}} \)? {_SEP} \d{{3,4}} {_SEP}? \d{{3,4}}
    ) (?! \w | [-.:/]\d )"""
)
_BARE_PHONE = re.compile(r"(?i)\b(?:tel|phone|telephone|mobile|pager|fax|sms|call)(?: number)?(?:\s+(?:me|us|is|to|on|at)){0,3}[\s.:=\"']{1,4}(\d{10,11})(?!\w)")
SSN = re.compile(r"(?<![\w.+-])(\d{3})([- ]?)(\d{2})\2(\d{4})(?![\w-]|\.\d)")
_SSN_LABEL = re.compile(r"(?i)(?:\bssn|social[ -]security|tax[ -]?(?:id|payer)|\bitin|\btin)\b[^\d\n]{0,24}$")
NINO = re.compile(r"(?i)(?<![\w.-])([a-z]{2})( ?)(\d\d)\2(\d\d)\2(\d\d)\2([a-d])(?![\w-])")
_NINO_LABEL = re.compile(r"(?i)(?:\bnino|\bni\b|insurance)[^\n]{0,16}$")
PASSPORT = re.compile(r"(?i)\bpassport(?:\s+(?:no\.?|number|nr\.?|num|id))?\s*[:#=]?\s*([a-z]{0,2} ?\d(?: ?\d){5,8})(?!\w)")
BIRTH = re.compile(r"(?i)\b(?:dob|date of birth|born(?: on)?|birthday)\s*[:=]?\s*(\d{4})([-/.])(\d{2})\2(\d{2})(?!\w)")
_NAME = r"[A-ZÀ-ÖØ-Þ][\w’'-]*"
STREETS = (
    re.compile(rf"(?<![\w.,/-])\d{{1,5}}[A-Za-z]?\s+(?:(?:North|South|East|West|N|S|E|W|NORTH|SOUTH|EAST|WEST)\.?\s+)?(?:{_NAME}\s+){{1,3}}?(?i:{_any(STREET_AFTER)})\b(?![-/_]\w)"),
    re.compile(rf"(?<![\w.,/-])\d{{1,4}}[A-Za-z]?(?:\s(?:bis|ter))?,?\s+(?i:{_any(STREET_BEFORE_FR)})\s+(?:(?:de la|de l[’']|du|des|de|d[’'])\s*)?{_NAME}"),
    re.compile(rf"(?<![\w/.-])(?:{_any(STREET_BEFORE)}|{_any([w.upper() for w in STREET_BEFORE])})\s+(?:(?:de la|de los|del|de|da|do|dei|della|di)\s+)?{_NAME},?\s+\d{{1,4}}[A-Za-z]?(?![\w/-]|[.:]\d)"),
    re.compile(rf"(?<![\w/.-])[A-ZÄÖÜ][\w-]{{2,}}(?i:{_any(STREET_END_DE)})\s+\d{{1,4}}[A-Za-z]?(?![\w/-]|[.:]\d)"),
)
#: Cheap tests: each finds something in every text in which a pattern it guards does (``find`` says the same with ``gates=False``).
_BRACKET_AT = re.compile(r"[\[({<]\s*[aA][tT]\s*[\])}>]")
_MANY_DIGITS = re.compile(r"\d(?:[^\w\n]{0,3}\d){5}")
_STREET_GATES = (
    re.compile(r"\d[A-Za-z]?\s+[A-ZÀ-ÖØ-Þ]"),
    re.compile(rf"\d[A-Za-z]?(?:\s(?:bis|ter))?,?\s+(?i:{_any(STREET_BEFORE_FR)})\s"),
    re.compile(rf"{_NAME},?\s+\d"),
    re.compile(r"[A-ZÄÖÜ][\w-]{3,}\.?\s+\d"),
)
WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]{2,})*")
#: What precedes a person's name where the text uses it for one: any label, words of contact, titles, in the languages of the patterns above.
_TITLE = r"(?:mr|mrs|ms|miss|dr|prof|sir|herr|frau|monsieur|madame|mme|señor|señora|sr|sra|signor|signora)\.?"
_CONTACT = (
    r"(?:(?:met|meet|meeting|spoke|speak|talk|talked|work|works|worked|chat|call|lunch|interview) (?:with|to)|(?:written|reported|reviewed|approved|signed|sent|assigned|forwarded|owned|led|filed|requested|raised)"
    r" (?:by|to)|(?:ask|asked|tell|told|email|emailed|call|called|contact|ping|pinged|thank|thanks|invite|cc|from|attn|named|called|is|think|says|regards|cheers|sincerely|greetings|hi|hello|hey|dear|liebe[r]?|cher|chère|querid[oa]),?"
    r"(?: to| for)?)"
)
CUE = re.compile(rf"""(?i)(?:\b[^\W\d_][\w -]{{1,30}}"?\s*[:=]\s*"?|\b{_TITLE}\s+|\b{_CONTACT}\s+)$""")
#: What only a person's name follows, so that two capitalised words need no listed or learned half; without person: words of roles, groups and machines.
_STRONG = (
    r"""(?<![\w.])(?:(?ai:signed-off-by|co-authored-by|reviewed-by|reported-by|acked-by|tested-by|suggested-by|author|committer|customer|patient|tenant|employee|attendee)(?: record| name)?"?[^\S\n]*[:=][^\S\n]*"?|"""
    r"(?:Dear|DEAR|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Herr|Frau|Madame|Señora?|(?ai:reported by|(?:met|meeting|spoke|talked|lunch|interview) with|spoke to|talked to|introduce you to|regards,|my name is|je m'appelle|ich heiße|me llamo))[^\S\n]+)"
)
_STRONG_SIGNS = ("-by", "author", "committer", "customer", "patient", "tenant", "employee", "attendee", "dear", "mr", "ms", "dr", "herr", "frau", "madame", "señor", " by", " with", " to", "regards", "my name", "appelle", "heiße", "llamo")
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:[’'-][^\W\d_]{2,})*"
STRONG_NAME = re.compile(
    rf"{_STRONG}(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau)\.?[^\S\n]+)?"
    rf"(?P<name>(?P<first>{_CAPITAL})(?P<gap>\.?[^\S\n]{{1,3}}|,[^\S\n]{{1,3}})(?P<second>{_CAPITAL}))(?![\w-])(?=(?P<dot>\.?))(?=[^\S\n]*(?P<next>{WORD.pattern})?)"
)
_PERSON_CASE = re.compile(r"(?:Ma?c)?[A-ZÀ-ÖØ-Þ](?:[^\W\d_A-ZÀ-ÖØ-Þ]*|[A-ZÀ-ÖØ-Þ]+)")
NO_PERSON = frozenset(
    "mr mrs ms dr prof herr frau sir madam lord lady all both everyone everybody colleague colleagues friend friends reader readers member members user users customer customers client clients guest "
    "team teams group department office board committee staff crew support service services sales marketing security engineering operations ops platform product project release build builds code "
    "manager managers director editor editors admin administrator administrators maintainer maintainers developer developers engineer engineers contributor contributors owner owners author authors "
    "hiring human resources quality assurance bot robot agent assistant system systems server daemon automation automated automatic continuous integration deployment pipeline scanner scan static analysis "
    "analyzer tool tools tooling tracking monitoring alert alerts error errors test tests testing action actions hook hooks job jobs script unknown anonymous undefined none null nil nobody not no set todo "
    "fixme tbd true false the a an and or of for to in on this that your our my valued inc ltd llc gmbh corp corporation company foundation institute university bank software technologies labs studio".split()
)
_INITIAL = re.compile(r"(?<![\w.])([^\W\d_])\.\s{1,2}$")
_INITIAL_AFTER = re.compile(r",?\s{1,2}([^\W\d_])\.(?![\w])")


# Words that begin or end names of streets and places, not of people; days and months.
NO_NAME = frozenset(
    w.lower()
    for w in [*STREET_AFTER, *STREET_BEFORE_FR, *STREET_BEFORE, *"North South East West New Old San Saint Upper Lower Mount Lake Fort Port Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split(),
              *"January February March April May June July August September October November December".split()]
)
#: Two capitalised words in running text, and no third beside them.
_TWO = r"[A-ZÀ-ÖØ-Þ][^\W\d_A-ZÀ-ÖØ-Þ]{2,}(?:[’'-][A-ZÀ-ÖØ-Þ]?[^\W\d_A-ZÀ-ÖØ-Þ]{2,})?"
PLAIN_PAIR = re.compile(rf"(?<![\w./@#_\\-])(?P<first>{_TWO}) (?P<second>{_TWO})(?![\w/@(_-])(?! [A-ZÀ-ÖØ-Þ][^\W\d_])")


class WordShape:
    """How much more a word looks like one sort of words than like another: the mean log ratio of its letter pairs and triples in the two.

    ``one`` and ``other`` are those of all words of the two sorts, counted (``counts``).
    """

    def __init__(self, one: Counter, other: Counter):
        size = len({*one, *other}) or 1
        a, b = (math.log(sum(c.values()) + 0.3 * size) for c in (one, other))
        self.ratio = {g: math.log(one[g] + 0.3) - a - math.log(other[g] + 0.3) + b for g in {*one, *other}}
        self.new = b - a

    @staticmethod
    def grams(word: str) -> list[str]:
        w = f"^{word.lower()}$"
        return [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]

    @classmethod
    def counts(cls, words: Iterable[str]) -> Counter:
        return Counter(g for w in words for g in cls.grams(w))

    def __call__(self, word: str) -> float:
        grams = self.grams(word)
        return sum(self.ratio.get(g, self.new) for g in grams) / len(grams)


class NameModel:
    """Which words are given or family names: those listed, and those made of parts that listed names share.

    A listed name is cut at each place into a beginning and an end. An end that is met with twice ``least`` beginnings is productive, and so is
    a beginning that is met with ``least`` productive ends (of two letters: twice as many); a word of a productive beginning and a productive end is taken
    for a name of that part.

    With ``ordinary`` words (``ordinary_words``) two capitalised words that are none of them, and look no more like them than ``least_shape`` allows, are
    taken for a name too (``unlisted``).

    Lists too long to hold are learned from outside: ``parts`` are those of given and family names (``learned_parts``), ``grams`` the counts of given names,
    family names and ordinary words (``gram_counts``). The words themselves then come with each text (``knowing``).
    """

    def __init__(
        self, given: list[str], family: list[str], least: int = 3, ordinary: list[str] | None = None, least_shape: float = -1.6, parts: tuple | None = None, grams: tuple[Counter, ...] | None = None
    ):
        self.known = ({w.lower() for w in given}, {w.lower() for w in family})
        self.ordinary, self.least_shape = frozenset(ordinary or ()), least_shape
        grams = grams or tuple(map(WordShape.counts, (*self.known, self.ordinary)))
        self.shapes = tuple(WordShape(own, grams[2]) for own in grams[:2]) if all(grams) else None
        self.parts = parts or tuple(self._learn(words, least) for words in self.known)
        self.cache: dict[str, int] = {}
        self.plain: set[str] = set()  # words met that are no names

    @staticmethod
    def _learn(words: set[str], least: int) -> tuple[frozenset, frozenset]:
        ends, begins = defaultdict(set), defaultdict(set)
        for w in words:
            for i in range(2, len(w) - 1):
                ends[w[:i]].add(w[i:])
                begins[w[i:]].add(w[:i])
        productive = frozenset(k for k, v in begins.items() if len(v) >= 2 * least)
        return frozenset(k for k, v in ends.items() if len(v & productive) >= (least if len(k) > 2 else 2 * least)), productive

    def knowing(self, given: list[str] | None = None, family: list[str] | None = None, ordinary: list[str] | None = None) -> NameModel:
        """The same word parts and shapes with other listed names, other ordinary words or both."""
        other = copy.copy(self)
        if given is not None:
            other.known, other.cache, other.plain = (set(given), set(family)), {}, set()
        if ordinary is not None:
            other.ordinary = frozenset(ordinary)
        return other

    def unlisted(self, first: str, second: str) -> bool:
        """True for a given and a family name by their shape alone."""
        if self.shapes is None or any(w.lower() in self.ordinary or w.lower() in NO_PERSON or w.lower() in NO_NAME for w in (first, second)):
            return False
        return self.shapes[0](first) + self.shapes[1](second) >= self.least_shape

    def __call__(self, word: str) -> int:
        """Bit 1 given, bit 2 family (bits 4 and 8 if listed); 0 for neither."""
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > 1_000_000:
                self.cache.clear()
            found = self.cache[word] = self._judge(word)
        return found

    def _judge(self, word: str) -> int:
        if not (word.islower() or word.isupper() or word[0].isupper() and word[1:].islower() or "-" in word or "'" in word or "’" in word):
            return 0  # mixed case: an identifier
        w, out = word.lower(), 0
        for bit, known, (begins, ends) in zip((1, 2), self.known, self.parts, strict=True):
            if w in known:
                out |= bit | bit << 2
            elif any(w[:i] in begins and w[i:] in ends for i in range(2, len(w) - 1)):
                out |= bit
        return out


class Finder:
    """Finds personal information in a text; see ``find``. Without ``gates`` every pattern is tried on every text."""

    def __init__(self, names: NameModel, gates: bool = True):
        self.names, self.gates = names, gates

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of each passage, in order and without overlap."""
        out: list[tuple[int, int, str]] = []
        # Cheap tests first: most texts hold nothing of a kind, and then its patterns needn't run.
        if not self.gates or "@" in text or "dot" in text.lower() or _BRACKET_AT.search(text):
            out.extend((*m.span(), "email") for m in EMAIL.finditer(text) if m["local"].lower() not in MACHINE)
        self._numbers(text, out)
        self._names(text, out)
        if not self.gates or any(map(text.lower().__contains__, _STRONG_SIGNS)):
            self._cued(text, out)
        if self.names.shapes is not None:
            self._plain(text, out)
        out.sort(key=lambda x: (x[0], -x[1]))
        kept: list[tuple[int, int, str]] = []
        for x in out:
            if not kept or x[0] >= kept[-1][1]:
                kept.append(x)
        return kept

    def _numbers(self, text: str, out: list) -> None:
        taken = list(out)

        def add(a: int, b: int, kind: str) -> None:
            if all(b <= s or e <= a for s, e, _ in taken):
                taken.append((a, b, kind))
                out.append((a, b, kind))

        if not self.gates or _MANY_DIGITS.search(text):
            self._long_numbers(text, add)
        for gate, pattern in zip(_STREET_GATES, STREETS, strict=True):
            if not self.gates or gate.search(text):
                for m in pattern.finditer(text):
                    add(*m.span(), "street_address")

    @staticmethod
    def _long_numbers(text: str, add: Callable[[int, int, str], None]) -> None:
        for m in PASSPORT.finditer(text):
            add(*m.span(1), "id_number")
        for m in NINO.finditer(text):
            if m[1].isupper() or _NINO_LABEL.search(text, max(0, m.start() - 40), m.start()):
                add(*m.span(), "id_number")
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 17:
                add(*m.span(), "phone")
        for m in SSN.finditer(text):
            if m[1] not in ("000", "666") and m[3] != "00" and m[4] != "0000":
                if m[2] == "-" or _SSN_LABEL.search(text, max(0, m.start() - 60), m.start()):
                    add(*m.span(), "id_number")
        for m in _BARE_PHONE.finditer(text):
            add(*m.span(1), "phone")
        for m in BIRTH.finditer(text):
            if _date(m[1], m[3], m[4]):
                add(m.start(1), m.end(4), "birth_date")

    def _names(self, text: str, out: list) -> None:
        judge = self.names
        if self.gates:
            words = WORD.findall(text)
            if judge.plain.issuperset(words):
                return
            if not any(map(judge, words)):
                if len(judge.plain) < 1_000_000:
                    judge.plain.update(words)
                return
        taken = list(out)
        last: tuple[int, int, int, str] | None = None  # start, end, class, word
        done = -1
        for m in WORD.finditer(text):
            a, b = m.span()
            word = m[0]
            kind = judge(word)
            pair = None
            if last and last[0] >= done and (kind or last[2]):
                gap = text[last[1] : a]
                comma = gap.startswith(",")
                if 0 < len(gap) <= 4 and (gap[1:] if comma else gap).isspace() and gap.count("\n") <= 1:
                    first, second = last[2], kind
                    if not comma and first & 1 and second & 2 or first & 2 and second & 1:
                        pair = (last[0], b)
                    elif not comma and "\n" not in gap and (first & 1 or second & 2) and word[0].isupper() and last[3][0].isupper() and len(word) > 1 and len(last[3]) > 1:
                        if CUE.search(text, max(0, last[0] - 40), last[0]) or self._alone(text, last[0], b):
                            pair = (last[0], b)
            if pair is None and kind & 2 and (last is None or a > done):
                one = _INITIAL.search(text, max(0, a - 5), a)
                if one and one.start(1) >= done:
                    pair = (one.start(1), b)
                else:
                    after = _INITIAL_AFTER.match(text, b)
                    if after and text[b] == "," and after[1].isupper():
                        pair = (a, after.end(1))
            if pair and self._free(text, pair, taken):
                out.append((*pair, "person_name"))
                done = pair[1]
                last = None
            else:
                last = (a, b, kind, word)

    def _cued(self, text: str, out: list) -> None:
        """Names after a strong cue that ``_names`` left, as neither half is listed or made of learned parts."""
        for m in STRONG_NAME.finditer(text):
            first, second, gap = m["first"], m["second"], m["gap"]
            if gap[0] == "," and (m[0][:4].lower() == "dear" or re.match(r",?\s*[A-ZÀ-ÖØ-Þ]", text[m.end() : m.end() + 8])):
                continue  # a list of names
            if len(second) == 1 and (gap[0] != "," or not m["dot"]) or (len(first) == 1) != (gap[0] == "."):
                continue  # a single letter is an initial: "W. Kurz", "Kurz, W."
            words = (first, second, m["next"] or "")
            if any(w.lower() in NO_PERSON for w in words[: 3 if words[2][:1].isupper() else 2]):
                continue
            if all(_PERSON_CASE.fullmatch(part) for w in words[:2] for part in re.split("[’'-]", w)) and self._free(text, m.span("name"), out):
                out.append((*m.span("name"), "person_name"))

    def _plain(self, text: str, out: list) -> None:
        """Names by the shape of both words, where nothing else was found."""
        for m, before in self._pairs(text):
            if (before is None or before.lower() in self.names.ordinary) and self.names.unlisted(m["first"], m["second"]) and self._free(text, m.span(), out):
                out.append((*m.span(), "person_name"))

    @staticmethod
    def _pairs(text: str) -> Iterator[tuple[re.Match, str | None]]:
        """Two capitalised words, and the word before them unless it begins in lower case."""
        for m in PLAIN_PAIR.finditer(text):
            before = re.search(r"([^\W\d_]+) $", text[max(0, m.start() - 24) : m.start()])
            yield m, None if before is None or before[1][0].islower() else before[1]

    @classmethod
    def asked(cls, text: str) -> set[str]:
        """The words of a text of which ``find`` asks whether they are ordinary."""
        return {w.lower() for m, before in cls._pairs(text) for w in (m["first"], m["second"], before) if w}

    @staticmethod
    def _alone(text: str, a: int, b: int) -> bool:
        """True for a line of its own (a speaker's mark in brackets may go before), or with a genitive."""
        head = text[text.rfind("\n", 0, a) + 1 : a].strip()
        return text[b : b + 3] in ("'s ", "’s ") or text[b : b + 1] in ("", "\n", "\r") and (not head or re.fullmatch(r"\[\w{1,20}\]", head) is not None)

    @staticmethod
    def _free(text: str, span: tuple[int, int], taken: list) -> bool:
        a, b = span
        if any(a < e and s < b for s, e, _ in taken):
            return False
        before, after = text[a - 1 : a], text[b : b + 1]
        return before not in ("_", "/", "\\", "@", ".", "-", "`") and after not in ("_", "/", "\\", "@", "(", "`") and not after.isdigit()


def _date(y: str, m: str, d: str) -> dt.date | None:
    try:
        return dt.date(int(y), int(m), int(d))
    except ValueError:
        return None


def value_of(passage: str) -> str:
    """A passage in lower case, letters and digits only."""
    return "".join(c for c in passage.lower() if c.isalnum())


# Country codes of the public numbering plan. Zones 1 and 7 have one digit, these two, all others three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def country_code(digits: str) -> str:
    """The country code that an international number begins with, however it is parted."""
    return digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


class Pseudonyms:
    """Keyed, format-preserving pseudonyms.

    Digits go through a ten-round Feistel network over two halves; where the result breaks a rule of its format (an
    area code that doesn't exist, a date outside its range) it goes through again until it keeps it, which still is a permutation.
    """

    ROUNDS = 10
    FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), 55_000

    def __init__(self, key: bytes):
        self.key = key[:64]

    def _round(self, i: int, tweak: str, half: str) -> int:
        return int.from_bytes(blake2b(f"{i}|{tweak}|{half}".encode(), key=self.key, digest_size=16).digest(), "big")

    def mixed(self, text: str, tweak: str) -> str:
        """A permutation of the strings of ``text``'s form: a digit stays a digit and a letter a capital letter.

        A Feistel network over two halves, each a number in the mixed base of its places.
        """
        u = len(text) // 2
        bases = [10 if c.isdigit() else 26 for c in text]
        halves, parts = [self._number(text[:u]), self._number(text[u:])], (bases[:u], bases[u:])
        for i in range(self.ROUNDS):
            k = i % 2
            halves[k] = (halves[k] + self._round(i, tweak, str(halves[1 - k]))) % math.prod(parts[k])
        return "".join(self._places(n, base) for n, base in zip(halves, parts, strict=True))

    @staticmethod
    def _places(n: int, bases: list[int]) -> str:
        out = []
        for b in reversed(bases):
            n, x = divmod(n, b)
            out.append(str(x) if b == 10 else chr(65 + x))
        return "".join(reversed(out))

    @staticmethod
    def _number(text: str) -> int:
        n = 0
        for c in text:
            n = n * 10 + int(c) if c.isdigit() else n * 26 + ord(c) - 65
        return n

    def unmixed(self, text: str, tweak: str) -> str:
        """The inverse of ``mixed``."""
        u = len(text) // 2
        bases = [10 if c.isdigit() else 26 for c in text]
        halves, parts = [self._number(text[:u]), self._number(text[u:])], (bases[:u], bases[u:])
        for i in reversed(range(self.ROUNDS)):
            k = i % 2
            halves[k] = (halves[k] - self._round(i, tweak, str(halves[1 - k]))) % math.prod(parts[k])
        return "".join(self._places(n, base) for n, base in zip(halves, parts, strict=True))

    def digits(self, d: str, tweak: str) -> str:
        """A permutation of the strings of ``len(d)`` digits."""
        u = len(d) // 2
        sizes = (u, len(d) - u)
        a, b = d[:u], d[u:]
        for i in range(self.ROUNDS):
            m = sizes[i % 2]
            c = (int(a or "0") + self._round(i, tweak, b)) % 10**m
            a, b = b, str(c).zfill(m) if m else ""
        return a + b

    def undo(self, d: str, tweak: str) -> str:
        """The inverse of ``digits``."""
        u = len(d) // 2
        sizes = (u, len(d) - u)
        a, b = d[:u], d[u:]
        for i in reversed(range(self.ROUNDS)):
            m = sizes[i % 2]
            c = (int(b or "0") - self._round(i, tweak, a)) % 10**m
            a, b = str(c).zfill(m) if m else "", a
        return a + b

    def within(self, d: str, tweak: str, rule: Callable[[str], object], back: bool = False) -> str:
        """``digits`` (``mixed`` where there are letters), or their inverse, again and again until ``rule`` says the same of the result as of ``d``.

        So a format's rule is kept, and what breaks it is permuted among its like: still a permutation.
        """
        if d.isdigit():
            permute = self.undo if back else self.digits
        else:
            permute = self.unmixed if back else self.mixed
        like, out = rule(d), permute(d, tweak)
        while rule(out) != like:
            out = permute(out, tweak)
        return out

    def tag(self, canonical: str, kind: str) -> str:
        return blake2b(f"{kind}|{canonical}".encode(), key=self.key, digest_size=10).hexdigest()

    @staticmethod
    def _written(passage: str, digits: str) -> str:
        """``digits`` in the places of the passage's last digits, all else as it was."""
        out, todo = list(passage), list(digits)
        for i in range(len(out) - 1, -1, -1):
            if out[i].isdigit() and todo:
                out[i] = todo.pop()
        return "".join(out)

    @staticmethod
    def phone_parts(passage: str) -> tuple[str, str]:
        """(country code, national number without its trunk zero); a number that names no country is North American or British by its form."""
        d = "".join(c for c in passage if c.isdigit())
        abroad = d if passage.startswith("+") else d[2:] if d.startswith("00") and len(d) > 9 else ""
        if abroad:
            code = country_code(abroad)
            own = abroad[len(code) :]
            return code, own[1:] if code != "1" and own.startswith("0") else own
        return ("1", d) if len(d) == 10 and d[0] in "23456789" else ("44", d.lstrip("0"))

    def phone(self, passage: str, back: bool = False) -> str:
        code, own = self.phone_parts(passage)
        places = (0, 3) if code == "1" and len(own) == 10 else (0,)  # area and exchange codes don't begin with 0 or 1
        return self._written(passage, self.within(own, f"phone{code}", lambda x: [min(x[i], "2") for i in places], back))

    def id_number(self, passage: str, back: bool = False) -> str:
        d = "".join(c for c in passage if c.isdigit())
        if not any(c.isalpha() for c in passage):
            social = len(d) == 9
            return self._written(passage, self.within(d, "ssn" if social else "id", lambda x: not social or (x[:3] not in ("000", "666") and x[3:5] != "00" and x[5:] != "0000"), back))
        plain = "".join(c for c in passage.upper().translate({0x130: "I", 0x212A: "K"}) if c.isalnum())
        new = iter(self.within(plain, "id", lambda x: x[-1] in "ABCD", back))  # a national insurance number ends on A to D
        return "".join(c if not c.isalnum() else next(new).lower() if c.islower() else next(new) for c in passage)

    def birth_date(self, passage: str, back: bool = False) -> str:
        """Dates of the usual range among themselves, all others too."""
        y, m, d = re.findall(r"\d+", passage)
        no, first, days = _date(y, m, d).toordinal(), self.FIRST_DAY, self.DAYS
        if first <= no < first + days:
            new = first + int(self.within(str(no - first).zfill(5), "date", lambda x: int(x) < days, back))
        else:
            other = dt.date.max.toordinal() - days
            at = int(self.within(str(no - 1 if no < first else no - 1 - days).zfill(7), "far date", lambda x: int(x) < other, back))
            new = at + 1 if at + 1 < first else at + 1 + days
        return self._written(passage, dt.date.fromordinal(new).isoformat().replace("-", ""))

    def restored(self, pseudonym: str, kind: str) -> str:
        """The passage a number's or date's pseudonym stands for."""
        return getattr(self, kind)(pseudonym, back=True)

    def placeholder(self, passage: str, kind: str) -> str:
        return f"[{kind.upper()} {self.of(passage, kind)}]"

    def of(self, passage: str, kind: str) -> str:
        """The pseudonym of a passage: permuted within its format, or for words a keyed tag of 80 bits."""
        if kind in PERMUTED:
            return getattr(self, kind)(passage)
        canonical = "".join(sorted(value_of(w) for w in WORD.findall(passage))) if kind == "person_name" else value_of(passage)
        if kind == "email":
            canonical = re.sub(r"\s*[\[({<]?\s*\b(?:at|dot)\b\s*[\])}>]?\s*|[@.\s]", "|", passage.lower())
        return self.tag(canonical, kind)

    def redact(self, text: str, spans: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for a, b, kind in spans:
            out += [text[at:a], self.placeholder(text[a:b], kind)]
            at = b
        return "".join([*out, text[at:]])


FOUND = "row_key string, kind string, value string, pseudonym string"
CLEAN = struct("row_key string, text string, n_found int")


def _listed(names: DataFrame, part_col: str = "name_part", form_col: str = "form") -> DataFrame:
    """Distinct ``part, word`` in lower case."""
    return names.select(F.lower(F.col(part_col)).alias("part"), F.lower(F.col(form_col)).alias("word")).where("word IS NOT NULL").distinct()


def name_lists(names: DataFrame, part_col: str = "name_part", form_col: str = "form", max_names: int = 200_000) -> tuple[list[str], list[str]] | None:
    """All listed given and family names, for the driver and then every task; None if there are more than ``max_names``.

    Of a longer list word parts and shapes are learned by Spark (``learned_parts``, ``gram_counts``), and its names are found by ``own_words``.
    """
    rows = _listed(names, part_col, form_col).limit(max_names + 1).collect()
    return None if len(rows) > max_names else tuple([r.word for r in rows if r.part == p] for p in ("given", "family"))


def learned_parts(listed: DataFrame, least: int = 3) -> tuple[tuple[frozenset, frozenset], ...]:
    """What ``NameModel`` learns from given and from family names, of a list (``part, word``) of any size."""
    cuts = F.transform(F.sequence(F.lit(2), F.length("word") - 2), lambda i: F.struct(F.substring("word", F.lit(1), i).alias("a"), F.substring("word", i + 1, F.length("word")).alias("b")))
    cut = listed.where(F.length("word") >= 4).select("part", F.explode(cuts).alias("cut")).select("part", "cut.a", "cut.b")
    ends = cut.groupBy("part", "b").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * least).select("part", "b")
    begins = cut.join(ends, ["part", "b"]).groupBy("part", "a").agg(F.count("*").alias("n")).where(F.col("n") >= F.when(F.length("a") > 2, least).otherwise(2 * least))
    rows = begins.select("part", F.lit(0).alias("at"), F.col("a").alias("piece")).unionAll(ends.select("part", F.lit(1), "b")).collect()
    return tuple(tuple(frozenset(r.piece for r in rows if (r.part, r.at) == (p, at)) for at in (0, 1)) for p in ("given", "family"))


def gram_counts(words: DataFrame) -> Counter:
    """``WordShape.counts`` of a table ``word`` of any size; bounded by the letters there are, not by the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordShape.counts(w for batch in batches for w in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    return Counter({r.gram: r.n for r in words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()})


def ordinary_counts(df: DataFrame, text_col: str) -> DataFrame:
    """Words in lower case that at least two of all texts hold, and in how many: ``word, n``; what names are told from."""
    texts = df.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL AND text != ''")
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_'’-])\p{Ll}{3,}(?![\p{L}\p{N}_'’-])"), 0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


def ordinary_words(df: DataFrame, text_col: str, most: int | None = None) -> list[str]:
    """``ordinary_counts`` as a list, all of them unless only the ``most`` frequent ones are asked for."""
    often = ordinary_counts(df, text_col)
    return sorted(r.word for r in (often if most is None else often.orderBy(F.col("n").desc(), "word").limit(most)).collect())


def own_words(df: DataFrame, listed: DataFrame | None, ordinary: DataFrame | None) -> DataFrame:
    """``df`` (``row_key, text``) with ``given`` and ``family``, the listed names (``part, word``) among the words of each text, and ``ordinary``, those
    words of which ``Finder`` asks that are in that table (``word``); each by a join, and only for the tables that are passed.

    For lists of any size: words are counted once per row, and a row gets back no more than its own words.
    """
    rows = staged(df.withColumn("row_no", F.monotonically_increasing_id()), "texts")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(no, w) for no, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for w in Finder.asked(text)]
            yield pa.RecordBatch.from_arrays([pa.array([no for no, _ in found], pa.int64()), pa.array([w for _, w in found], pa.string())], names=["row_no", "word"])

    found, parts = [], []
    if listed is not None:
        words = rows.select("row_no", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+(?:[’'-][\p{L}]{2,})*"), 0))).alias("word"))
        found.append(words.join(listed, "word"))
        parts += ["given", "family"]
    if ordinary is not None:
        found.append(rows.select("row_no", "text").mapInArrow(asked, "row_no long, word string").join(ordinary.select("word", F.lit("ordinary").alias("part")), "word"))
        parts.append("ordinary")
    by_row = reduce(DataFrame.unionByName, found).groupBy("row_no").agg(*[F.collect_set(F.when(F.col("part") == p, F.col("word"))).alias(p) for p in parts])
    none = F.array().cast("array<string>")
    return rows.join(by_row, "row_no", "left").select("row_key", "text", *[F.coalesce(p, none).alias(p) for p in parts])


def _rows(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{key_col}`").cast("string").alias("row_key"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _with_model(df: DataFrame, names: DataFrame, ordinary: DataFrame | list[str] | None, max_names: int, max_words: int) -> tuple[DataFrame, NameModel]:
    """``df`` ready for a finder, and the model every task holds, learned from all names and all ordinary words; longer lists come to each row as its own words."""
    lists, listed, long_ordinary = name_lists(names, max_names=max_names), None, None
    if isinstance(ordinary, DataFrame):
        words = [r.word for r in ordinary.select("word").limit(max_words + 1).collect()]
        ordinary, long_ordinary = (words, None) if len(words) <= max_words else (None, ordinary)
    if lists is None:
        listed = staged(_listed(names), "names")
    if lists and long_ordinary is None:
        return df, NameModel(*lists, ordinary=ordinary)
    shapes = [gram_counts(listed.where(F.col("part") == p)) for p in ("given", "family")] if lists is None else [*map(WordShape.counts, map(set, lists))]
    shapes.append(WordShape.counts(set(ordinary or ())) if long_ordinary is None else gram_counts(long_ordinary))
    model = NameModel(*(lists or ([], [])), ordinary=ordinary, parts=None if lists else learned_parts(listed), grams=tuple(shapes))
    return own_words(df, listed, long_ordinary), model


def _finders(model: NameModel) -> Callable[[pa.RecordBatch], Iterator[Finder]]:
    """A finder for each row of a batch: one for all, unless rows bring words of their own."""
    one = Finder(model)

    def of(batch: pa.RecordBatch) -> Iterator[Finder]:
        own = batch.schema.names[2:]
        if not own:
            return (one for _ in range(batch.num_rows))
        return (Finder(model.knowing(**dict(zip(own, row, strict=True)))) for row in zip(*[batch.column(x).to_pylist() for x in own], strict=True))

    return of


def scan_pii(df: DataFrame, key_col: str, text_col: str, names: DataFrame, key: bytes, max_names: int = 200_000, pseudonyms: bool = True, ordinary: DataFrame | list[str] | None = None, max_words: int = 200_000) -> DataFrame:
    """Distinct passages per row: ``row_key, kind, value`` and, if asked for, ``pseudonym``, found and replaced in one pass.

    ``value`` is the passage in lower case, letters and digits only. That of a number or date is read back from its pseudonym by undoing the permutation, so
    what comes out has a pseudonym that stands for it and nothing else; if it didn't, the task would fail. With ``ordinary`` words (a table with
    ``word``, or a list) names are also found by their shape. Lists above ``max_names`` and ``max_words`` are as whole as shorter ones, but come to the texts by joins.

    Defined results: null and empty texts give nothing; repeated rows give repeated results; a text of any length is read whole; other
    columns are ignored; without known names only formats, and names after a strong cue, are found; an empty table gives no rows.
    """
    rows, model = _with_model(_rows(df, key_col, text_col).where(F.col("text").isNotNull() & (F.col("text") != "")), names, ordinary, max_names, max_words)
    schema = struct(FOUND if pseudonyms else FOUND.rsplit(",", 1)[0])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders, keyed = _finders(model), Pseudonyms(key)
        for batch in batches:
            out: list[tuple] = []
            for row_key, text, finder in zip(batch.column(0).to_pylist(), batch.column(1), finders(batch), strict=True):
                text = text.as_py()
                found = set()
                for a, b, kind in finder.find(text):
                    value, pseudonym = value_of(text[a:b]), keyed.of(text[a:b], kind)
                    if kind in PERMUTED:
                        value, written = value_of(keyed.restored(pseudonym, kind)), value
                        if value != written:
                            raise ValueError(f"the pseudonym of a {kind} can't be undone")
                    found.add((row_key, kind, value, pseudonym) if pseudonyms else (row_key, kind, value))
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*out, strict=True) if out else [()] * len(arrow))], schema=arrow)

    return rows.mapInArrow(run, schema)


def find_pii(df: DataFrame, key_col: str, text_col: str, names: DataFrame, key: bytes = b"any", max_names: int = 200_000, ordinary: DataFrame | list[str] | None = None, max_words: int = 200_000) -> DataFrame:
    """Distinct values per row: ``row_key, kind, value`` of ``scan_pii``; a value that is written in two ways in one row counts once."""
    return scan_pii(df, key_col, text_col, names, key, max_names, pseudonyms=False, ordinary=ordinary, max_words=max_words)


def redact(df: DataFrame, key_col: str, text_col: str, names: DataFrame, key: bytes, max_names: int = 200_000, ordinary: DataFrame | list[str] | None = None, max_words: int = 200_000) -> DataFrame:
    """The same texts with a typed placeholder for each passage: ``row_key, text, n_found``.

    ``key`` is the secret of the pseudonyms: equal values get equal placeholders under the same key. Defined results as in ``scan_pii``, but
    every row comes out; a null text stays null.
    """
    rows, model = _with_model(_rows(df, key_col, text_col), names, ordinary, max_names, max_words)
    arrow = to_arrow_schema(CLEAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders, pseudonyms = _finders(model), Pseudonyms(key)
        for batch in batches:
            texts, counts = [], []
            for text, finder in zip(batch.column(1).to_pylist(), finders(batch), strict=True):
                spans = finder.find(text) if text else []
                texts.append(pseudonyms.redact(text, spans) if spans else text)
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], schema=arrow)

    return rows.mapInArrow(run, CLEAN)
