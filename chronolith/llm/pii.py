r"""Personal data and secrets: keyed surrogates of the same type and format.

Detection looks for e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment card numbers (by the Luhn test), IBANs, assigned
secrets and access keys (token = "...", hexadecimal or base-64 text), dates after words for being born, street addresses with a house
number, and names after a title (Mr, Mrs, Herr, Frau, Señor, Madame, ...). Once a text has named a person, every later or earlier mention of
that name's words in the same text counts, with a title or without; names that never follow a title in their text aren't found. Each
entity has a canonical form, by which its mentions refer to one another: digits without separators, the address in lower case, a name's word.

Surrogates come from a keyed permutation of all values with the canonical form's shape: letters go to letters of the same case
and script, digits to digits, separators stay, a card keeps passing the Luhn test, an IBAN gets valid check digits, a date stays a date, an
address part stays below 256. Names and streets are made of syllables of the script, word by word: one family name is one
surrogate whatever title or given name stands before it, and a given name takes an ending of its gender. The gender comes from the
titles that the corpus gives to this name, else from its ending (a / o).

The collision check is a Spark job over distinct entities, not over documents: surrogates that two entities share, or that are
themselves entities of the corpus, go to the smallest entity and the others draw again, in shapes that grow after a few attempts; if any are
left after the last round, the job fails. Entities that drew again, or whose gender isn't the one that their own title tells, are joined to
the documents that mention them; usually there are few.

The key decides all surrogates. It comes from the caller; whoever has it can undo the permutations. Detection and rewriting are linear in a
text's length.

Defined results: null texts stay null, empty and clean texts stay as they are, byte for byte. Repeated rows change alike. Rows with a
null id change like any other; overrides reach rows by the hash of their text. Extra columns are kept, but one with the count's name.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
import secrets
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, numbered, small_batches, table

KEY_SETTING = "spark.chronolith.pii.key"
TITLES = {"mr": "m", "mister": "m", "sir": "m", "herr": "m", "herrn": "m", "señor": "m", "sr": "m", "don": "m", "monsieur": "m", "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "frau": "f", "señora": "f", "sra": "f", "señorita": "f", "doña": "f", "madame": "f", "mme": "f", "mlle": "f", "господин": "m", "госпожа": "f", "dr": "n", "prof": "n"}
SYLLABLES = {"latin": [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u")], "cyrillic": [a + b for a in "бвгдзклмнпрст" for b in "аеиоу"]}
ENDINGS = {"latin": {"m": ("n", "r", "s", "ldo"), "f": ("a", "ia", "lla", "na"), "n": ("e", "i", "ny", "ley")}, "cyrillic": {"m": ("н", "р", "л", "й"), "f": ("а", "ия", "на", "ла"), "n": ("е", "и", "ня", "ся")}}

Span = tuple[int, int, str, str, str]

SECRET = re.compile(r"""(?i:\b(?:api[_-]?key|secret|token|password|passwd|access[_-]?key)\b["']?\s*[:=]\s*["']?)(?P<x>[A-Za-z0-9+/_=\-]{12,})""")
ACCESS_KEY = re.compile(r"\b(?:AKIA|gh[pousr]_|sk-)(?P<x>[A-Za-z0-9]{16,})\b")
IBAN = re.compile(r"\b(?P<x>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b")
CARD = re.compile(r"(?<!\d)(?P<x>\d{4}(?P<s>[ -]?)\d{4}(?P=s)\d{4}(?P=s)\d{4}(?:(?P=s)\d{1,3})?|3[04678]\d{2}[ -]?\d{6}[ -]?\d{4,5})(?!\d)")
IP4 = re.compile(r"(?<![\d.])(?P<x>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d)")
IP6 = re.compile(r"(?<![\w:.])(?P<x>[0-9A-Fa-f:]{6,39})(?![\w:])")
DATE = r"\d{4}(?P<s>[-/.])\d{1,2}(?P=s)\d{1,2}|\d{1,2}(?P<t>[-/.])\d{1,2}(?P=t)(?:\d{4}|\d{2})"
BORN = re.compile(r"(?i:\b(?:born(?: on)?|date of birth|birth ?date|dob|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa](?: el)?|fecha de nacimiento)\b:? )(?P<x>" + DATE + r")(?!\d)")
PHONE = re.compile(r"(?<![\w.])(?P<x>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]\d{2,8}){1,4}|\(\d{2,4}\) ?\d{3}[ .-]\d{4}|\d{3}[-. ]\d{3}[-. ]\d{4}|\d{3}-\d{2}-\d{4}|\+\d{8,15})(?![\w-])")
CAPITAL = r"[^\W\d_a-zа-яß-öø-ÿ][^\W\d_]*"
STREET = re.compile(
    r"\b(?P<x>\d{1,5} (?P<a>" + CAPITAL + r"(?: " + CAPITAL + r"){0,2}) (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Place)\b"
    r"|(?P<b>" + CAPITAL + r")(?:straße|strasse|weg|platz|allee|gasse) \d{1,4}[a-z]?\b"
    r"|\d{1,4},? (?:rue|avenue|boulevard|chemin) (?:de la |du |des |de |d')?(?P<c>" + CAPITAL + r"(?:[ -]" + CAPITAL + r"){0,2})"
    r"|(?:Calle|Avenida|Plaza|Paseo) (?:de la |del |de )?(?P<d>" + CAPITAL + r"(?: " + CAPITAL + r"){0,2}),? \d{1,4}\b)"
)
_titles = "|".join(sorted((w for t in TITLES for w in (t.capitalize(), t.upper())), key=len, reverse=True))
TITLE = re.compile(r"(?:" + _titles + r")\.? ")
NAME = re.compile(r"\b(?P<title>" + _titles + r")\b\.? (?P<x>[^\W\d_a-zа-я][^\W\d_]+(?:[ -][^\W\d_a-zа-я][^\W\d_]+){0,2})")
WORD = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
#: Years whose days stand for one another; two digits tell those of the first and last apart.
EPOCHS = tuple((datetime.date(a, 1, 1).toordinal(), datetime.date(b, 1, 1).toordinal()) for a, b in ((1930, 2025), (1850, 1930), (2025, 2030)))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses: from each @ leftwards to what can't be a local part, and a domain to the right.

    Local parts end at 64 characters and domains at 253, by the standard; what is longer is no address."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > max(end, at - 65) and (text[start - 1] in LOCAL or start < at and start - 1 > end and text[start - 1] == "." and text[start - 2] in LOCAL):
            start -= 1
        domain = DOMAIN.match(text, at + 1, at + 255) if at - 65 < start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", at + 1)


def _day(value: str) -> tuple[datetime.date, str] | None:
    """A written date and the order of its parts; None if there is no such day. 3/4/2000 is read as in America, 3.4.2000 as in Europe."""
    sep = next(c for c in value if not c.isdigit())
    parts = [int(x) for x in value.split(sep)]
    order = "ymd" if parts[0] > 99 else "dmy" if parts[0] > 12 or sep != "/" and parts[1] <= 12 else "mdy"
    at = dict(zip(order, parts))
    year = at["y"] + (0 if at["y"] > 99 else 2000 if at["y"] < 30 else 1900)
    try:
        return datetime.date(year, at["m"], at["d"]), order
    except ValueError:
        return None


def _spans(text: str) -> Iterator[list[Span]]:
    """Candidates of each kind in order of precedence; each list in the text's order."""
    low = text.lower()
    digits = DIGIT.search(text) is not None
    if "@" in text:
        yield [(a, b, "email", text[a:b].lower(), "") for a, b in _emails(text)]
    if any(w in low for w in ("key", "secret", "token", "passw")):
        yield [(*m.span("x"), "secret", m["x"], "") for m in SECRET.finditer(text)]
    if "AKIA" in text or "gh" in text and "_" in text or "sk-" in text:
        yield [(*m.span("x"), "secret", m["x"], "") for m in ACCESS_KEY.finditer(text)]
    if "::" in text or text.count(":") >= 7:
        yield [(*m.span("x"), "ip6", m["x"].lower(), "") for m in IP6.finditer(text) if _is_ip6(m["x"])]
    if digits:
        yield [(*m.span("x"), "iban", m["x"].replace(" ", ""), "") for m in IBAN.finditer(text)]
        cards = ((m.span("x"), re.sub(r"\D", "", m["x"])) for m in CARD.finditer(text))
        yield [(*at, "card", c, "") for at, c in cards if _luhn(c[:-1]) == int(c[-1])]
        yield [(*m.span("x"), "ip", m["x"], "") for m in IP4.finditer(text)]
        if any(w in low for w in ("born", "birth", "dob", "gebor", "geburt", "né", "naiss", "naci")):
            born = ((m.span("x"), _day(m["x"])) for m in BORN.finditer(text))
            yield [(*at, "date", day[0].isoformat(), "") for at, day in born if day and any(a <= day[0].toordinal() < b for a, b in EPOCHS)]
        phones = ((m.span("x"), re.sub(r"[ .()-]", "", m["x"])) for m in PHONE.finditer(text))
        yield [(*at, "phone", c, "") for at, c in phones if 7 <= len(c.lstrip("+")) <= 15]
        yield [(*m.span("x"), "address", m["x"], "") for m in STREET.finditer(text)]
    if TITLE.search(text):
        yield list(_names(text))


def _is_ip6(value: str) -> bool:
    if len([g for g in value.split(":") if g]) < 3:
        return False
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return True


def _names(text: str) -> Iterator[Span]:
    """The words of names after a title: the last one, or the only one, is the family name. Then all other mentions of these words.

    A text's first title that tells the gender counts for all mentions of a given name in it."""
    titled: dict[int, tuple[str, str]] = {}
    known: dict[str, tuple[str, str]] = {}
    genders: dict[str, str] = {}
    for m in NAME.finditer(text):
        words = list(WORD.finditer(text, *m.span("x")))
        for k, w in enumerate(words):
            what = ("family" if k == len(words) - 1 else "given", w[0].lower())
            titled[w.start()] = what
            if genders.get(what[1], "n") == "n":
                genders[what[1]] = TITLES[m["title"].lower()]
            for form in (w[0], w[0].upper(), w[0].capitalize()):
                if len(form) > 2:
                    known.setdefault(form, what)
    for w in WORD.finditer(text):
        if what := titled.get(w.start()) or known.get(w[0]):
            yield (*w.span(), *what, genders[what[1]] if what[0] == "given" else "")


def _merged(taken: list[Span], more: Iterable[Span]) -> list[Span]:
    """taken, and those of the others that meet none of them and none before; both in order, in linear time."""
    out: list[Span] = []
    k = end = 0
    for span in more:
        while k < len(taken) and taken[k][1] <= span[0]:
            out.append(taken[k])
            k += 1
        if span[0] >= end and (k == len(taken) or taken[k][0] >= span[1]):
            out.append(span)
            end = span[1]
    return out + taken[k:]


def find(text: str | None) -> list[Span]:
    """(start, end, kind, canonical form, gender by title) of each entity, in order and disjoint; a name has one for each word."""
    found: list[Span] = []
    for spans in _spans(text or ""):
        found = _merged(found, spans)
    return found


def count(text: str, found: list[Span]) -> int:
    """Entities: neighbouring words of a name are one."""
    names = ("given", "family")
    joined = sum(y[2] in names and x[2] in names and text[x[1] : y[0]] in (" ", "-") for x, y in zip(found, found[1:]))
    return len(found) - joined


def _hash(key: bytes, text: str, n: int = 16) -> int:
    data = text.encode("utf-8", "surrogatepass")
    if n <= 64:
        return int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=n).digest(), "big")
    return int.from_bytes(hashlib.shake_256(len(key).to_bytes(4, "big") + key + data).digest(n), "big")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): ten Feistel rounds over two residues, walked until they land inside."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    n = max(16, (a.bit_length() + 7) // 8 + 8)
    while True:
        left, right = value % a, value // a
        for r in range(0, 10, 2):
            left = (left + _hash(key, f"{tweak}\x1f{r}\x1f{right:x}", n)) % a
            right = (right + _hash(key, f"{tweak}\x1f{r + 1}\x1f{left:x}", n)) % b
        value = right * a + left
        if value < size:
            return value


#: Characters that may stand for one another; others stay.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
_alphabet = {c: a for a in ALPHABETS for c in a}


def _by_shape(text: str, key: bytes, tweak: str, alphabets: list[str] | None = None) -> str:
    """Permute all texts of one shape (an alphabet for each character) among themselves, 48 characters at a time.

    What stands before a piece is part of its tweak, so different texts stay different."""
    own = alphabets or [_alphabet.get(c, c) for c in text]
    tweak += "".join(a[0] for a in own)
    out = []
    for at in range(0, len(text), 48):
        size, value = 1, 0
        for c, a in zip(text[at : at + 48], own[at : at + 48]):
            size, value = size * len(a), value * len(a) + a.index(c)
        value = permute(value, size, key, tweak)
        piece = []
        for a in reversed(own[at : at + 48]):
            value, k = divmod(value, len(a))
            piece.append(a[k])
        out += reversed(piece)
        if len(text) > at + 48:
            tweak = f"{_hash(key, tweak + text[at : at + 48], 32):x}"
    return "".join(out)


def _luhn(digits: str) -> int:
    """The digit that makes digits + itself pass the Luhn test."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def gender_of(name: str, by_title: str) -> str:
    """The title's gender, else the ending's."""
    return by_title if by_title in ("m", "f") else {"a": "f", "а": "f", "o": "m", "о": "m"}.get(name[-1:].lower(), "n")


def _word(kind: str, canon: str, gender: str, key: bytes, tweak: str, grown: int) -> str:
    """A name's or street's word in lower case, of syllables of its script; given names end by gender."""
    script = "cyrillic" if "а" <= canon[:1].lower() <= "я" else "latin"
    h = _hash(key, f"{tweak}\x1f{canon}\x1f{gender}", 32)
    word = ""
    for _ in range((3 if kind == "given" else 4) + grown):
        h, s = divmod(h, len(SYLLABLES[script]))
        word += SYLLABLES[script][s]
    if kind == "given":
        endings = ENDINGS[script][gender]
        word += endings[h % len(endings)]
    return word


@lru_cache(50_000)
def surrogate(kind: str, canon: str, gender: str, key: bytes, attempt: int = 0) -> str:
    """Another canonical form of the same type and shape. After each four attempts a name, local part or secret grows by one."""
    tweak = f"{kind}{attempt}" if attempt else kind
    grown = attempt // 4
    if kind in ("given", "family"):
        return _word(kind, canon, gender_of(canon, gender) if kind == "given" else "", key, tweak, grown)
    if kind == "address":
        m = STREET.fullmatch(canon)
        a, b = next(m.span(g) for g in "abcd" if m[g])
        street = WORD.sub(lambda w: _cased(w[0], _word("family", w[0].lower(), "", key, "street" + tweak, grown)), canon[a:b])
        digits = [(c, i) for i, c in enumerate(canon) if c in "0123456789"]
        first = ["123456789"] + ["0123456789"] * (len(digits) - 1)
        number = "".join(c for c, _ in digits)
        number = number if number[0] == "0" else _by_shape(number, key, tweak + canon[a:b].lower(), first)
        new = list(canon)
        for (_, i), c in zip(digits, number):
            new[i] = c
        return "".join([*new[:a], street, *new[b:]])
    if kind == "date":
        day = datetime.date.fromisoformat(canon).toordinal()
        low, high = next(e for e in EPOCHS if e[0] <= day < e[1])
        return datetime.date.fromordinal(low + permute(day - low, high - low, key, f"{tweak}{low}")).isoformat()
    if kind == "ip":
        n = int(ipaddress.IPv4Address(".".join(str(int(p)) for p in canon.split("."))))
        return str(ipaddress.IPv4Address(permute(n, 1 << 32, key, tweak)))
    if kind == "ip6":
        return _by_shape(canon, key, tweak, ["0123456789abcdef" if c != ":" else c for c in canon])
    if kind == "card":
        body = _by_shape(canon[:-1], key, tweak)
        return body + str(_luhn(body))
    if kind == "iban":
        rest = _by_shape(canon[4:], key, tweak)
        return canon[:2] + _iban_check(canon[:2], rest) + rest
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        host, _, top = domain.rpartition(".")
        more = "".join(SYLLABLES["latin"][_hash(key, f"{tweak}{canon}{k}") % 70] for k in range(grown))
        return f"{_by_shape(local, key, tweak)}{more}@{_by_shape(host, key, tweak + 'host')}.{top}"
    if kind == "secret":
        more = "".join("0123456789abcdef"[_hash(key, f"{tweak}{canon}{k}") % 16] for k in range(grown))
        hexadecimal = ["0123456789abcdef"] * len(canon) if re.fullmatch(r"[0-9a-f]+", canon) else None
        return _by_shape(canon, key, tweak, hexadecimal) + more
    fixed = 2 if canon.startswith("+") else 0  # a telephone number keeps its + and the country's first digit
    return canon[:fixed] + _by_shape(canon[fixed:], key, tweak + canon[:fixed])


def _cased(value: str, new: str) -> str:
    return new.upper() if len(value) > 1 and value.isupper() else new.capitalize() if value[:1].isupper() else new


def surface(kind: str, value: str, new: str) -> str:
    """The mention's own separators, case and order around the surrogate."""
    if kind in ("given", "family"):
        return _cased(value, new)
    if kind in ("phone", "card", "iban"):
        it = iter(new)
        return "".join(c if c in " .()-" else next(it) for c in value) + "".join(it)
    if kind == "email":
        return "".join(n.upper() if c.isupper() and n.isalpha() else n for c, n in zip(value, new)) + new[len(value) :]
    if kind == "ip6" and value.upper() == value:
        return new.upper()
    if kind == "date":
        order = _day(value)[1]
        parts = dict(zip("ymd", new.split("-")))
        sep = next(c for c in value if not c.isdigit())
        return sep.join(parts[c][-max(2, len(old)) :] if c == "y" else f"{int(parts[c]):0{len(old)}d}" for c, old in zip(order, value.split(sep)))
    return new


def rewrite(text: str | None, key: bytes, overrides: dict[tuple[str, str], tuple[str, int]] | None = None) -> tuple[str | None, int]:
    """The text with every entity replaced, and their number. overrides: gender and attempt by kind and canonical form."""
    found = find(text)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, kind, canon, gender in found:
        gender, attempt = (overrides or {}).get((kind, canon), (gender, 0))
        out += [text[at:a], surface(kind, text[a:b], surrogate(kind, canon, gender, key, attempt))]
        at = b
    return "".join([*out, text[at:]]), count(text, found)


def entities(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(th, kind, canon, gender) of each mention; th is the hash of its text, gender what the title tells."""
    text = F.col(text_col).cast("string")
    src = docs.select(F.xxhash64(text).alias("th"), text.alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = sorted({(h, k, c, g) for h, t in zip(b.column(0).to_pylist(), b.column(1)) for _, _, k, c, g in find(t.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.string()) for i in range(4)], ["th", "kind", "canon", "gender"])

    return src.mapInArrow(run, "th long, kind string, canon string, gender string")


def _ending(name: Column) -> Column:
    """gender_of without a title, as an expression."""
    last = F.substring(name, -1, 1)
    return F.when(last.isin("a", "а"), "f").when(last.isin("o", "о"), "m").otherwise("n")


def distinct_entities(mentions: DataFrame) -> DataFrame:
    """(kind, canon, gender, mixed): a given name's gender is what most titles tell, else its ending; mixed if a mention would tell another."""
    men, women = F.count_if(F.col("gender") == "m"), F.count_if(F.col("gender") == "f")
    told = F.when(men > women, "m").when(women > men, "f").otherwise(F.when(men > 0, "n").otherwise(_ending(F.col("canon"))))
    gender = F.when(F.col("kind") == "given", told).otherwise("")
    local = F.when(F.col("gender").isin("m", "f"), F.col("gender")).otherwise(_ending(F.col("canon")))
    found = mentions.withColumn("local", F.when(F.col("kind") == "given", local).otherwise("")).groupBy("kind", "canon")
    found = found.agg(gender.alias("gender"), F.min("local").alias("lo"), F.max("local").alias("hi"))
    return found.select("kind", "canon", "gender", ((F.col("lo") != F.col("gender")) | (F.col("hi") != F.col("gender"))).alias("mixed"))


def collisions(distinct: DataFrame, key: bytes, rounds: int = 20, make=surrogate) -> DataFrame:
    """(kind, canon, attempt) of the entities that must draw again. RuntimeError if some still collide after the last round."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [make(k, c, g, key, n) for k, c, g, n in zip(*(b.column(i).to_pylist() for i in range(4)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], [*b.schema.names, "new"])

    schema = "kind string, canon string, gender string, attempt int, new string"
    drawn = checkpointed(distinct.select("kind", "canon", "gender", F.lit(0).alias("attempt")).mapInArrow(draw, schema))
    real = distinct.select("kind", F.col("canon").alias("new"))
    first = F.struct("attempt", "canon")
    for _ in range(rounds + 1):
        owners = drawn.groupBy("kind", "new").agg(F.min(first).alias("owner"), F.count("*").alias("n")).where("n > 1").select("kind", "new", "owner")
        shared = drawn.join(owners, ["kind", "new"]).where(first != F.col("owner")).select("kind", "canon")
        lost = checkpointed(shared.union(drawn.join(real, ["kind", "new"], "left_semi").select("kind", "canon")).distinct())
        if lost.isEmpty():
            return drawn.where("attempt > 0").select("kind", "canon", "attempt")
        again = lost.join(drawn, ["kind", "canon"]).select("kind", "canon", "gender", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, schema)
        drawn = checkpointed(drawn.join(lost, ["kind", "canon"], "left_anti").union(again))
    raise RuntimeError(f"{lost.count()} entities have no surrogate of their own after {rounds} draws")


def configured_key(spark: SparkSession) -> bytes:
    """The key that the session's setting spark.chronolith.pii.key holds; where it is unset a new one, which nobody keeps."""
    text = spark.conf.get(KEY_SETTING, None)
    return text.encode() if text else secrets.token_bytes(32)


def replace_entities(docs: DataFrame, *, key: bytes, text_col: str = "text", count_col: str = "_n_entities") -> DataFrame:
    """docs with text_col rewritten, and a column count_col."""
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c != count_col]
    plain, names = numbered(docs.select(*(F.col(f"`{c}`") for c in columns)))
    text = names[text_col]
    plain = plain.withColumn(text, F.col(text).cast("string"))
    mentions = checkpointed(entities(plain, text_col=text))
    distinct = checkpointed(distinct_entities(mentions))
    again = checkpointed(collisions(distinct, key))
    odd = distinct.join(again, ["kind", "canon"], "left").where("mixed OR attempt IS NOT NULL").select("kind", "canon", "gender", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    odd = checkpointed(odd)
    rows = plain.withColumn("again", F.lit(None).cast("array<struct<kind:string,canon:string,gender:string,attempt:int>>"))
    if not odd.isEmpty():
        told = mentions.select("th", "kind", "canon").distinct().join(broadcast_if_small(odd), ["kind", "canon"])
        per_text = told.groupBy("th").agg(F.collect_list(F.struct("kind", "canon", "gender", "attempt")).alias("again"))
        rows = plain.join(per_text, F.xxhash64(plain[text]) == F.col("th"), "left").select(*plain.columns, "again")
    at = plain.columns.index(text)
    schema = plain.schema.add("n", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for t, a in zip(b.column(at), b.column(b.num_columns - 1)):
                new, n = rewrite(t.as_py(), key, {(x["kind"], x["canon"]): (x["gender"], x["attempt"]) for x in a.as_py() or []})
                texts.append(new)
                counts.append(n)
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int32())], schema.names)

    return rows.mapInArrow(run, schema).toDF(*columns, count_col)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, key=configured_key(spark)).select("doc_id", F.col("_n_entities").alias("n_entities"), "text")
