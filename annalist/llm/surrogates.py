"""PII surrogates: detected entities get keyed replacements of their own type and format.

Detection: patterns for addresses, numbers and secrets, dates of birth, street addresses, and names that begin with a known given name or a title or
stand where a person is named. A replacement is a keyed permutation
of the entity's symbols (a Feistel network over mixed alphabets: digits stay digits, letters stay letters of their case and script, hex stays
hex; country codes, separators, top-level domains and check digits stay valid), so equal entities have equal surrogates everywhere and, of one format,
different ones different surrogates. Names get given names of the same gender and script and built family names. All distinct entities
of the corpus are then checked, whatever their types: a surrogate that reads as somebody's real value, or as another entity's surrogate, is drawn again until none is left.
Of a name the entities are its family words, wherever they stand; given names are permuted, so names differ as their family words do.
Symbols of no alphabet are replaced by keyed letters, and what finds no free value is made longer, by a symbol more with each draw.
Dates of birth are permuted among all days of two centuries, which keeps different ones different; of so few days any is somebody's.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import BROADCAST_ROWS, NULL_ID, cut, discard, restore_id, small_batches, table
from annalist.llm.text import chunks, release

ROUNDS = 8
#: Family names grow with each second draw of a surrogate, and from draw GROW on all other values do with each draw.
GROW = 10

# Given names by script and gender (f, m), and what family names are built of.
GIVEN = {
    "latin": {
        "f": ["Alice", "Anna", "Carla", "Clara", "Diana", "Elena", "Emily", "Greta", "Helen", "Ingrid", "Julia", "Karen", "Laura", "Maria", "Nina", "Olivia", "Paula", "Rachel", "Sarah", "Sophie", "Teresa", "Victoria"],
        "m": ["Adam", "Albert", "Bruno", "Carlos", "Daniel", "David", "Erik", "Felix", "Frank", "George", "Hugo", "James", "John", "Karl", "Lucas", "Martin", "Michael", "Oscar", "Peter", "Robert", "Thomas", "William"],
    },
    "cyrillic": {
        "f": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна"],
        "m": ["Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей", "Юрий"],
    },
    "greek": {
        "f": ["Άννα", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία"],
        "m": ["Αλέξανδρος", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
    },
}
SYLLABLES = {
    "latin": ["bar", "bel", "cor", "dan", "del", "far", "gan", "hol", "jar", "kel", "lan", "mar", "mor", "nor", "pel", "ran", "sel", "tor", "val", "wen"],
    "cyrillic": ["бар", "вел", "гор", "дан", "зар", "кал", "лан", "мар", "нов", "пет", "ров", "сел", "тор", "хол"],
    "greek": ["βαρ", "γαλ", "δελ", "καρ", "λαν", "μαρ", "νικ", "παπ", "ροδ", "σιλ", "τασ"],
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Monsieur": "m", "Madame": "f"}
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
_WHERE = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
_HEX, _HEX_UP = "0123456789abcdef", "0123456789ABCDEF"

_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω][a-zß-öø-ÿа-яёά-ώ]+(?:-[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω][a-zß-öø-ÿа-яёά-ώ]+)?"
_GIVEN = {n: (s, g) for s, by in GIVEN.items() for g, names in by.items() for n in names}
#: A value behind the name of a secret.
_KEYED = re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key)\b\s*[:=]\s*[\"']?([A-Za-z0-9_\-+/.=]{8,})")
# What a date of birth stands behind, months, words for streets (before, behind and at the end of their names), and what names a person.
BORN = r"(?i:born(?: on)?|date of birth|birth ?date|d\.?o\.?b\.?|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento|дата рождения|ημερομηνία γέννησης)"
MONTHS = {
    "en": ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"],
    "de": ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"],
    "fr": ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"],
    "es": ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"],
}
STREET_BEHIND = ["Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Court", "Square", "Terrace"]
STREET_BEFORE = ["rue", "Rue", "avenue", "boulevard", "Calle", "calle", "Avenida", "avenida", "Via"]
STREET_END = ["straße", "strasse", "str.", "gasse", "weg", "platz", "allee"]
NAMED = r"(?i:full name|contact person|signed by|nombre completo|vollständiger name|nom complet):?"
NAMED_SELF = r"(?i:my name is|mein name ist|ich heiße|je m'appelle|mi nombre es|me llamo|меня зовут|με λένε)"
_MONTH = {m.lower(): i + 1 for names in MONTHS.values() for i, m in enumerate(names)}
_DATE = rf"\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}|(?i:{'|'.join(sorted(_MONTH))}) \d{{1,2}},? \d{{4}}|\d{{1,2}}\.? (?:de )?(?i:{'|'.join(sorted(_MONTH))}) (?:de )?\d{{4}}"
_WORD = r"[A-ZÀ-ÖØ-Þ][\wà-ÿ'-]+"

#: (type, pattern), the first that matches a stretch of text wins; group 1, if there is one, is the entity.
PATTERNS = [
    ("email", re.compile(r"[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[A-Za-z]{2,}")),
    ("secret", _KEYED),
    ("secret", re.compile(r"\b((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9\-_]{20,}|xox[abp]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{30,})\b")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])((?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,128})(?![0-9A-Za-z])")),
    ("birth", re.compile(rf"\b{BORN}\s*[:,]?\s*({_DATE})(?!\w)")),
    ("address", re.compile(rf"(?<![\w.])\d{{1,5}}[a-z]? (?:{_WORD} ){{1,3}}(?:{'|'.join(STREET_BEHIND)})\b")),
    ("address", re.compile(rf"(?<![\w.])\d{{1,4}},? (?:{'|'.join(STREET_BEFORE[:4])}) (?:de |du |des |la |l')*{_WORD}(?: {_WORD})?")),
    ("address", re.compile(rf"\b(?:{'|'.join(STREET_BEFORE[4:])}) (?:de |del |la |los )*{_WORD}(?: {_WORD})?,? \d{{1,4}}\b")),
    ("address", re.compile(rf"\b[A-ZÄÖÜ][a-zäöüß-]+(?:{'|'.join(map(re.escape, STREET_END))}) \d{{1,4}}[a-z]?\b")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("mac", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+?\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\w)")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\w)")),
    ("phone", re.compile(r"(?<![\w-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w-])")),
    ("number", re.compile(r"(?<![\w])\d{4}(?:([ -])\d{4})(?:\1\d{4}){2}(?![\w])")),
    ("number", re.compile(r"(?<!\w)\d{13,19}(?!\w)")),
    ("person", re.compile(rf"\b(?:{'|'.join(sorted(_GIVEN))}) {_NAME}(?: {_NAME})?(?!\w)")),
    ("person", re.compile(rf"\b(?:{'|'.join(TITLES)})\.? ({_NAME}(?: {_NAME})?)(?!\w)")),
    ("person", re.compile(rf"\b{NAMED}\s+({_NAME} {_NAME}(?: {_NAME})?)(?!\w)")),
    ("person", re.compile(rf"\b{NAMED_SELF}\s+({_NAME}(?: {_NAME}){{0,2}})(?!\w)")),
]
#: What a text with an entity, or with a name, holds at least; both are searched much faster than the patterns.
_HINT = re.compile(r"[@\d:=]|sk-|xox[abp]-|gh[pousr]_|AKIA|ASIA|AIza|(?:[A-Fa-f]{2}-){5}")
_NAME_HINT = re.compile("|".join(sorted([*_GIVEN, *TITLES])))
#: What stands, in lower case, in a text that one of these patterns may match; substrings are found many times faster than patterns without regard to case.
_CUES = {
    BORN: ["born", "birth", "o.b", "dob", "d.ob", "geboren", "geburtsdatum", "né le", "née le", "de naissance", "nacid", "nacimiento", "дата рождения", "ημερομηνία γέννησης"],
    NAMED: ["full name", "contact person", "signed by", "nombre completo", "vollständiger name", "nom complet"],
    NAMED_SELF: ["my name is", "mein name ist", "ich heiße", "je m'appelle", "mi nombre es", "me llamo", "меня зовут", "με λένε"],
}


_CUE_OF = {p: cue for _, p in PATTERNS for cue in _CUES if cue in p.pattern}


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    end: int
    value: str


def _random(value: str) -> bool:
    """Whether a value may be a secret: words and hyphenated words are not."""
    return any(c.isdigit() for c in value) or (len(value) >= 16 and value.lower() != value != value.upper() and value != value.title())


def detect(text: str) -> list[Entity]:
    """Entities in order, without overlaps; of overlapping ones the earlier pattern wins. Time is linear in the text and in the entities."""
    found: list[Entity] = []
    hinted, named, low = _HINT.search(text) is not None, _NAME_HINT.search(text) is not None, text.lower()
    cued = {cue for cue, words in _CUES.items() if any(w in low for w in words)}
    if not hinted and not named and not cued & {NAMED, NAMED_SELF}:
        return found
    taken = bytearray(len(text))

    def claim(kind: str, s: int, e: int) -> None:
        if taken.find(1, s, e) < 0:
            taken[s:e] = b"\1" * (e - s)
            found.append(Entity(kind, s, e, text[s:e]))

    for kind, pattern in PATTERNS:
        if pattern in _CUE_OF:
            if _CUE_OF[pattern] not in cued:
                continue
        elif not (named if kind == "person" else hinted):
            continue
        for m in pattern.finditer(text):
            s, e = m.span(1 if kind in ("secret", "person", "birth") and pattern.groups else 0)
            if (pattern is _KEYED and not _random(text[s:e])) or (kind == "birth" and date_of(text[s:e]) is None):
                continue
            claim(kind, s, e)
    # the last part of a name that stands alone, or in capitals
    parts = {x.value.split(" ")[-1] for x in found if x.kind == "person"}
    parts |= {p.upper() for p in parts}
    if parts:
        before = None
        for m in re.finditer(r"\w+", text):
            if before and before.end() + 1 == m.start() and text[before.end()] == "-" and text[before.start() : m.end()] in parts:
                claim("family", before.start(), m.end())
            elif m[0] in parts:
                claim("family", *m.span())
            before = m
    return sorted(found, key=lambda x: x.start)


#: Days that dates of birth are permuted among.
_DAY_ONE, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


def date_of(value: str) -> tuple[date, list[str]] | None:
    """A written date and what its fields are, in order; day before month unless the numbers say otherwise. None: no such day, or of another century."""
    fields = re.findall(r"\d+|[^\W\d_]+", value)
    fields = [f for f in fields if f.lower() != "de"]
    month = next((i for i, f in enumerate(fields) if not f.isdigit()), None)
    if month is not None:
        kinds = ["month", "day", "year"] if month == 0 else ["day", "month", "year"]
    elif len(fields[0]) == 4:
        kinds = ["year", "month", "day"]
    else:
        kinds = ["month", "day", "year"] if int(fields[1]) > 12 else ["day", "month", "year"]
    by = dict(zip(kinds, fields, strict=True))
    try:
        found = date(int(by["year"]), _MONTH[by["month"].lower()] if month is not None else int(by["month"]), int(by["day"]))
    except ValueError:
        return None
    return (found, kinds) if 0 <= found.toordinal() - _DAY_ONE < _DAYS else None


def _birth(value: str, k: Keyed) -> str:
    """Another day, written in the same way; one day has one surrogate however it is written."""
    found, kinds = date_of(value)
    n = found.toordinal() - _DAY_ONE
    while True:  # until it is one of the days: a permutation of a superset, walked along its cycle, is one of the days
        high, low = k.permute([n >> 8, n & 255], [(_DAYS >> 8) + 1, 256], "birth")
        n = high << 8 | low
        if n < _DAYS:
            break
    new = date.fromordinal(n + _DAY_ONE)
    order = iter(kinds)

    def field(m: re.Match) -> str:
        if m[0].lower() == "de":
            return m[0]
        kind = next(order)
        if kind == "month" and not m[0].isdigit():
            names = next(x for x in MONTHS.values() if m[0].lower() in [y.lower() for y in x])
            word = names[new.month - 1]
            return word.upper() if m[0].isupper() else word.lower() if m[0].islower() else word.capitalize()
        return str(getattr(new, kind)).zfill(len(m[0]))

    return re.sub(r"\d+|[^\W\d_]+", field, value)


def _address(value: str, k: Keyed) -> str:
    """Another house number, and built names for those of the street."""
    keep = {*STREET_BEHIND, *STREET_BEFORE}

    def word(m: re.Match) -> str:
        w = m[0]
        if w[0].isdigit():
            return k.text(w, f"house{len(w)}{value}")
        if w in keep or w[0].islower():
            return w
        end = next((x for x in STREET_END if w.endswith(x)), "")
        return _family(w[: len(w) - len(end)], k) + end

    return re.sub(r"\d+|[\w'-]+\.?", word, value) + _longer(k, value, ALPHABETS[0])


def _abroad(value: str) -> bool:
    """Whether a phone number begins with its country's code."""
    return value.startswith("+") or "(" in value and not value.startswith("(")


def family_words(name: str) -> list[str]:
    """The words of a person's name but for a given name before others."""
    words = name.split(" ")
    return words[1:] if len(words) > 1 and words[0] in _GIVEN else words


def written_small(word: str) -> str:
    """A family word in the case that names have: LOPEZ and Lopez are one."""
    return word.title() if len(word) > 1 and word.isupper() else word


def checked(e: Entity) -> list[tuple[str, str, str]]:
    """kind, entity, value of what a mention's surrogate is built from."""
    if e.kind in ("person", "family"):
        return [("family", w, w) for w in map(written_small, family_words(e.value))]
    if e.kind == "birth":
        return []  # a permutation of all days, which needs no draws
    return [(e.kind, identity(e.kind, e.value), e.value)]


def reading(made: str) -> str:
    """What a value reads as, whatever its type and form: letters and digits."""
    return "".join(c for c in made.casefold() if c.isalnum())


def identity(kind: str, value: str) -> str:
    """What makes two mentions the same entity."""
    if kind == "email":
        return value.lower()
    if kind == "phone":
        return "+" * _abroad(value) + re.sub(r"\D", "", value)
    if kind in ("number", "ssn"):
        return re.sub(r"\D", "", value)
    if kind in ("iban", "mac"):
        return re.sub(r"[ :-]", "", value).upper()
    return value


# Keyed permutations


def _alphabet(c: str) -> tuple[str, int] | None:
    """The alphabet of a symbol and its place there; digits of all scripts have one."""
    if c in _WHERE:
        return _WHERE[c]
    d = unicodedata.decimal(c, None)
    return None if d is None else ("".join(chr(ord(c) - d + i) for i in range(10)), d)


#: Country codes of one and two digits; all others have three.
_SHORT_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def _country(digits: str) -> int:
    """Digits of the country's code at the start, whatever the separators."""
    plain = "".join(str(int(c)) for c in digits[:2])
    return next((n for n in (1, 2) if plain[:n] in _SHORT_CODES), 3)


class Keyed:
    def __init__(self, key: bytes, attempt: int = 0):
        self.key, self.attempt = key[:64], attempt

    def numbers(self, n: int, *what: object) -> list[int]:
        """n numbers of 32 bits that depend on the key, the attempt and ``what``."""
        out: list[int] = []
        i = 0
        while len(out) < n:
            h = hashlib.blake2b(repr((self.attempt, i, *what)).encode("utf-8", "surrogatepass"), key=self.key).digest()
            out += [int.from_bytes(h[j : j + 4], "big") for j in range(0, 64, 4)]
            i += 1
        return out[:n]

    def permute(self, symbols: list[int], sizes: list[int], tweak: str) -> list[int]:
        """A permutation of the sequences of symbols with these alphabet sizes."""
        s = list(symbols)
        if len(s) == 1:
            return [(s[0] + self.numbers(1, tweak, "one")[0]) % sizes[0]]
        half = len(s) // 2
        for r in range(ROUNDS):
            mine, other = (range(half), range(half, len(s))) if r % 2 else (range(half, len(s)), range(half))
            f = self.numbers(len(mine), tweak, r, tuple(s[i] for i in other), tuple(sizes))
            for i, x in zip(mine, f, strict=True):
                s[i] = (s[i] + x) % sizes[i]
        return s

    def text(self, value: str, tweak: str, alphabets: Callable[[str], tuple[str, int] | None] = _alphabet) -> str:
        """Every symbol of a known alphabet permuted inside it, other letters replaced by keyed ones; the rest stays in place."""
        places = [(i, *a) for i, c in enumerate(value) if (a := alphabets(c))]
        out = list(value)
        other = [i for i, c in enumerate(value) if not c.isascii() and not alphabets(c)]
        for i, x in zip(other, self.numbers(len(other), tweak, "other", value), strict=True):
            out[i] = ALPHABETS[1][x % 26]
        if not places:
            return "".join(out)
        new = self.permute([p[2] for p in places], [len(p[1]) for p in places], tweak)
        for (i, alphabet, _), x in zip(places, new, strict=True):
            out[i] = alphabet[x]
        return "".join(out)


def luhn(digits: str) -> int:
    """The sum that a valid number has divisible by ten."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))


def _check_digit(body: str) -> str:
    """In the script of the digit before it."""
    return _alphabet(body[-1])[0][-luhn(body + "0") % 10]


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _refill(template: str, symbols: str, keep: str) -> str:
    """Symbols put back between the separators of a template."""
    it = iter(symbols)
    return "".join(c if c in keep else next(it) for c in template)


def _hex(alphabet: str):
    return lambda c: (alphabet, alphabet.index(c)) if c in alphabet else None


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of a value as it is written; mentions of one entity in other forms get the same one in their form."""
    k = Keyed(key, attempt)
    if kind == "email":
        local, _, domain = value.lower().rpartition("@")
        labels, _, top = domain.rpartition(".")
        new, place = k.text(local, "email"), k.text(labels, "domain")
        more = _longer(k, identity(kind, value), ALPHABETS[1], 6 if (new, place) == (local, labels) else 0)
        return f"{new}{more}@{place}.{top}"
    if kind == "ip":
        return ".".join(map(str, k.permute([int(x) for x in value.split(".")], [256] * 4, "ip"))) + _longer(k, value, ALPHABETS[0], mark="-")
    if kind == "mac":
        plain = identity(kind, value)
        made = _refill(value, k.text(plain, "mac", _hex(_HEX_UP)), ":-")
        return (made if value.upper() == value else made.lower()) + _longer(k, plain, _HEX, mark="-")
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        n = _country(digits) if _abroad(value) else 0
        return _fill_digits(value, digits[:n] + k.text(digits[n:], f"phone{digits[:n]}")) + _longer(k, identity(kind, value), ALPHABETS[0])
    if kind in ("number", "ssn"):
        digits = identity(kind, value)
        more = _longer(k, digits, ALPHABETS[0], mark="-")
        if kind == "number" and luhn(digits) % 10 == 0:
            body = digits[0] + k.text(digits[1:-1], f"card{digits[0]}")
            return _fill_digits(value, body + _check_digit(body)) + more
        return _fill_digits(value, digits[0] + k.text(digits[1:], f"{kind}{digits[0]}")) + more
    if kind == "iban":
        plain = identity(kind, value)
        body = k.text(plain[4:], f"iban{plain[:2]}")
        valid = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
        return _refill(value, plain[:2] + (_iban_check(plain[:2], body) if valid else plain[2:4]) + body, " ") + _longer(k, plain, ALPHABETS[2], mark="-")
    if kind == "secret":
        head = re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|AIza)?", value)[0]
        rest = value[len(head) :]
        hexed = next((a for a in (_HEX, _HEX_UP) if rest and set(rest) <= set(a)), None)
        return head + (k.text(rest, "hex", _hex(hexed)) if hexed else k.text(rest, f"secret{head}")) + _longer(k, value, _HEX)
    if kind == "family":
        return _family(value, k)
    if kind == "birth":
        return _birth(value, Keyed(key))
    if kind == "address":
        return _address(value, k)
    return person(value, key, lambda w: attempt)


def person(value: str, key: bytes, attempt: Callable[[str], int]) -> str:
    """A name's surrogate; attempt: that of each family word. Given names are permuted alike for all, so that they need no draws."""
    family = [_family(w, Keyed(key, attempt(w))) for w in family_words(value)]
    first, *more = value.split(" ")
    if len(family) == 1 + len(more):
        return " ".join(family)
    script, gender = _GIVEN[first]
    names = GIVEN[script][gender]
    return " ".join([names[Keyed(key).permute([names.index(first)], [len(names)], f"given{script}{gender}")[0]], *family])


def _longer(k: Keyed, value: str, alphabet: str, least: int = 0, mark: str = "") -> str:
    """What is put behind a surrogate once its format has run out of free values: a symbol more with each draw."""
    n = max(least, k.attempt - GROW + 1)
    return mark + "".join(alphabet[x % len(alphabet)] for x in k.numbers(n, "longer", value)) if n > 0 else ""


def _fill_digits(template: str, digits: str) -> str:
    it = iter(digits)
    return re.sub(r"\d", lambda m: next(it), template)


def _family(value: str, k: Keyed) -> str:
    script = "cyrillic" if re.search("[Ѐ-ӿ]", value) else "greek" if re.search("[Ͱ-Ͽ]", value) else "latin"
    made = "".join(SYLLABLES[script][x % len(SYLLABLES[script])] for x in k.numbers(4 + k.attempt // 2, "family", value))
    return made.capitalize()


# Corpus


def _mentions(batches):
    for batch in batches:
        for part, _, _ in chunks([batch]):
            seen = {(k, i): v for t in part.column("text").to_pylist() if t for e in detect(t) for k, i, v in checked(e)}
            keys = sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.string()), pa.array([seen[k] for k in keys], pa.string()), pa.array([reading(i) for _, i in keys], pa.string())], names=["kind", "entity", "value", "reads"])
    release()


MENTION = "kind string, entity string, value string, reads string"


def _drawn(key: bytes):
    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("kind", "value", "attempt")), strict=True)
            made = [reading(identity(k, surrogate(k, v, key, a))) for k, v, a in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "made"])
        release()

    return run


def draws(entities: DataFrame, key: bytes, written: list[DataFrame] | None = None) -> DataFrame:
    """entities(kind, entity, value, reads) -> kind, entity, attempt > 0 of those whose first surrogate was taken: it reads as a real entity, or as another's surrogate.

    Entities that keep their surrogate are never drawn again, so the rounds only shrink; values grow with the draws, so that they end. The tables between, which tell entities and
    surrogates, are added to ``written``: whoever has read the result deletes them."""
    written = [] if written is None else written
    originals = entities.select(F.col("reads").alias("made")).distinct()
    open_ = entities.select("kind", "entity", "value").withColumn("attempt", F.lit(0))
    fixed = None
    for attempt in itertools.count():
        made = cut(open_.mapInArrow(_drawn(key), "kind string, entity string, value string, attempt int, made string"), "surrogates")
        written.append(made)
        first = made.groupBy("made").agg(F.min(F.struct("kind", "entity")).alias("first")).select("made", "first.*")
        good = made.join(first, ["kind", "made", "entity"], "left_semi").join(originals, "made", "left_anti")
        if fixed is not None:
            good = good.join(fixed.select("made"), "made", "left_anti")
        good = cut(good, "surrogates")
        written.append(good)
        fixed = good if fixed is None else fixed.unionByName(good)
        rest = made.join(good.select("kind", "entity"), ["kind", "entity"], "left_anti")
        if rest.isEmpty():
            return fixed.where("attempt > 0").select("kind", "entity", "attempt")
        open_ = rest.select("kind", "entity", "value", F.lit(attempt + 1).alias("attempt"))


OUT = "doc_id long, text string, entities array<struct<kind:string,start:int,end:int,surrogate:string>>"
_ENTITY = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])


def replace(text: str, key: bytes, attempt: Callable[[str, str], int]) -> tuple[str, list[dict]]:
    """The text with surrogates, and where they stand in the new text."""
    out, at, size, spans = [], 0, 0, []
    for e in detect(text):
        if e.kind == "person":
            made = person(e.value, key, lambda w: attempt("family", w))
        elif e.kind == "family" and written_small(e.value) != e.value:
            small = written_small(e.value)
            made = surrogate("family", small, key, attempt("family", small)).upper()
        else:
            made = surrogate(e.kind, e.value, key, attempt(e.kind, identity(e.kind, e.value)))
        out += [text[at : e.start], made]
        size += e.start - at
        spans.append({"kind": e.kind, "start": size, "end": size + len(made), "surrogate": made})
        size += len(made)
        at = e.end
    return "".join([*out, text[at:]]), spans


def _apply(key: bytes, known):
    def run(batches):
        shared = known.value if known is not None else {}
        for batch in batches:
            for part, _, _ in chunks([batch]):
                own = part.column("redrawn").to_pylist() if "redrawn" in part.schema.names else [None] * part.num_rows
                texts, spans = [], []
                for t, more in zip(part.column("text").to_pylist(), own, strict=True):
                    table_ = {m["tag"]: m["attempt"] for m in more} if more else shared
                    new, found = replace(t, key, lambda k, i, d=table_: d.get(tag(k, i, key), 0) if d else 0) if t else (t, [])
                    texts.append(new)
                    spans.append(found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(spans, pa.list_(_ENTITY))], names=["doc_id", "text", "entities"])
        release()

    return run


def tag(kind: str, entity: str, key: bytes) -> str:
    """Stands for an entity where it is written down: without the key nobody can tell whose it is."""
    return hashlib.blake2b(f"{kind}\0{entity}".encode("utf-8", "surrogatepass"), key=key[:64], digest_size=16, person=b"entity").hexdigest()


def _tagged(key: bytes):
    def run(batches):
        for b in batches:
            tags = [tag(k, i, key) for k, i in zip(b.column("kind").to_pylist(), b.column("entity").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(tags, pa.string()), b.column("attempt")], names=["tag", "attempt"])

    return run


def _by_document(key: bytes):
    def run(batches):
        for batch in batches:
            for part, _, _ in chunks([batch]):
                ids, tags = [], []
                for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for k, i in sorted({(k, i) for e in detect(t) for k, i, _ in checked(e)} if t else ()):
                        ids.append(d), tags.append(tag(k, i, key))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.string())], names=["doc_id", "tag"])
        release()

    return run


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with surrogates), entities (kind, start, end in the new text, surrogate); originals are never returned.

    Null text stays null; empty text and text without entities come back unchanged. Null ids come back as null, repeated rows get equal rows, extra columns are
    pruned, an empty table gives an empty result. Very long texts are handled alone, in time linear in them. Tables of entities and of their surrogates, as sensitive as the
    input, are written to the shared folder and deleted once the surrogates are settled, also where that fails; what is left names entities by keyed hashes.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    mentions = rows.mapInArrow(_mentions, MENTION)
    written: list[DataFrame] = []
    try:
        entities = cut(mentions.groupBy("kind", "entity").agg(F.min("value").alias("value"), F.min("reads").alias("reads")), "entities")
        written.append(entities)
        again = cut(draws(entities, key, written).mapInArrow(_tagged(key), "tag string, attempt int"), "redrawn")
    finally:
        for t in written:
            discard(t)
    few = again.limit(BROADCAST_ROWS + 1).collect()
    if len(few) <= BROADCAST_ROWS:
        known = docs.sparkSession.sparkContext.broadcast({r.tag: r.attempt for r in few}) if few else None
        out = rows.mapInArrow(_apply(key, known), OUT)
    else:  # each document gets its own part of the table
        own = rows.mapInArrow(_by_document(key), "doc_id long, tag string").distinct().join(again, "tag")
        own = own.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "attempt")).alias("redrawn"))
        out = rows.join(own, "doc_id", "left").mapInArrow(_apply(key, None), OUT)
    return out.withColumn("doc_id", restore_id("doc_id"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"), key=b"a key of the deployment's own")
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.transform("entities", lambda e: e["kind"]).alias("kinds"))
