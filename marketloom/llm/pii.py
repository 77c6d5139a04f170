"""PII: surrogate generation.

Detected entities are replaced by surrogates of the same type and form.  A
surrogate comes from a keyed permutation of the strings of the entity's form
(a Feistel network over mixed radices, walked until the result is valid for
the type), so one entity has one surrogate wherever it occurs, and different
entities have different ones.  Where that can't be promised (a fixed point,
a pool of names, a surrogate that occurs in the corpus as somebody's own data)
a check over the table of all distinct entities finds the clash, and the
entities concerned move on to their next surrogate.  Forms with few members
(all symbols, say) take surrogates from a fixed alphabet, and an entity that
has moved on ``LONGER`` times gets a longer one, so every corpus settles.

A phone number is its country code and its digits, however it is grouped; ten
digits in the 3-3-4 form count as one of country code 1.

Person names are found by their titles: all capitalised words and initials that
follow, and then bare mentions of these words in the same document.  Given
names follow the title's gender and the script, and given names and surnames are mapped separately, so that
"Mr. John Smith" and "Mr. Smith" still share a surname.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import is_empty, lean, only_results, spare_name, table, written

_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
_HEX = "0123456789abcdef"

# Titles by gender, and given names and surname syllables by script and gender (own choice, small on purpose).
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Señor": "m", "Sr": "m", "Monsieur": "m", "господин": "m", "г-н": "m", "κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Señora": "f", "Señorita": "f", "Sra": "f", "Madame": "f", "Mme": "f", "госпожа": "f", "г-жа": "f", "κυρία": "f",
    "Dr": "n", "Prof": "n", "Professor": "n", "Doktor": "n",
}
GIVEN = {
    "latin": {"m": "Adam Boris Carl David Emil Felix Hugo Ivan Jonas Karl Leo Martin Oscar Paul Robin Simon Theo Victor".split(), "f": "Alma Bella Clara Diana Emma Flora Greta Helena Ida Julia Klara Laura Maria Nora Olivia Paula Rosa Sofia".split(), "n": "Alex Andrea Charlie Jamie Kim Luca Noa Robin Sam Sascha".split()},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(), "f": "Алла Вера Галина Дарья Елена Жанна Ирина Клара Лидия Мария".split(), "n": "Саша Женя Валя".split()},
    "greek": {"m": "Άρης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(), "f": "Άννα Ελένη Κατερίνα Μαρία Σοφία Χριστίνα".split(), "n": "Αλέξης Ευτυχία".split()},
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo za ze zo".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до ка ке ко ла ле ло ма ме мо на не но па ра ре ро са се со та те то".split(),
    "greek": "βα βε γα γο δα δε κα κο λα λε λο μα με νο πα πε ρα ρο σα τα τε το".split(),
}
INITIALS = {"latin": _UPPER, "cyrillic": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "greek": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}


# ---- keyed permutation ----------------------------------------------------

def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network, walked back into the range."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    out = value
    while True:
        left, right = out >> half, out & mask
        for k in range(8):
            d = hmac.new(key, f"{tweak}|{k}|{right}".encode(), hashlib.sha256).digest()
            left, right = right, left ^ (int.from_bytes(d, "big") & mask)
        out = left << half | right
        if out < size:
            return out


def _alphabet(c: str, hexa: bool) -> str:
    if hexa:
        return _HEX
    return _DIGITS if c in _DIGITS else _LOWER if c in _LOWER else _UPPER if c in _UPPER else c


#: Forms with fewer members than this are left for a fixed alphabet.
FEW = 1000
#: After so many surrogates that clash, an entity's next ones are longer.
LONGER = 12


def keyed_string(key: bytes, tweak: str, n: int) -> str:
    alphabet = _DIGITS + _LOWER
    return "".join(alphabet[_pick(key, f"{tweak}|{k}", len(alphabet))] for k in range(n))


def reshaped(text: str, key: bytes, tweak: str, valid: Callable[[str], bool] = lambda s: True, hexa: bool = False, few: int = FEW) -> str:
    """Another string of the same form: each digit a digit, each letter a letter of its case.

    ``valid`` holds for ``text``; the permutation is walked until it holds again.
    A form of fewer than ``FEW`` members gives a keyed string of letters and
    digits of its length instead.
    """
    sets = [_alphabet(c, hexa) for c in text]
    size, value = 1, 0
    for c, s in zip(text, sets, strict=True):
        size *= len(s)
        value = value * len(s) + s.index(c)
    if size < few:
        return keyed_string(key, f"{tweak}|{text}", len(text))
    form = "".join(s[0] for s in sets)
    while True:
        value = permuted(value, size, key, f"{tweak}|{form}")
        rest, out = value, []
        for s in reversed(sets):
            rest, k = divmod(rest, len(s))
            out.append(s[k])
        made = "".join(reversed(out))
        if valid(made):
            return made


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10


def _net(ip: str) -> str:
    a, b, *_ = map(int, ip.split("."))
    private = a in (10, 127) or (a == 172 and 16 <= b < 32) or (a, b) == (192, 168)
    return "private" if private else "other" if a == 0 or a >= 224 else "public"


def _ip(text: str, key: bytes, tweak: str) -> str:
    value = int.from_bytes(bytes(map(int, text.split("."))), "big")
    while True:
        value = permuted(value, 1 << 32, key, tweak)
        made = ".".join(map(str, value.to_bytes(4, "big")))
        if _net(made) == _net(text):
            return made


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def _pick(key: bytes, tweak: str, n: int) -> int:
    return int.from_bytes(hmac.new(key, tweak.encode(), hashlib.sha256).digest()[:8], "big") % n


@lru_cache(maxsize=20_000)
def surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The ``attempt``-th surrogate of an entity, in canonical form."""
    tweak = f"{kind}|{attempt}"
    if attempt >= LONGER and not kind.startswith(("given", "surname")):
        more = keyed_string(key, f"{tweak}|{canonical}|more", attempt - LONGER + 4)
        first = surrogate(kind, canonical, 0, key)
        return f"{more}.{first}" if kind == "email" else f"{first}-{more}"
    if kind == "ip":
        return _ip(canonical, key, tweak)
    if kind == "card":
        first, check = canonical[0], luhn(canonical)
        return reshaped(canonical, key, tweak, lambda s: s[0] == first and luhn(s) == check)
    if kind == "phone":
        code, national = canonical.split(" ")
        low = national[0] in "01"
        return f"{code} {reshaped(national, key, f'{tweak}|{code}', lambda s: (s[0] in '01') == low)}"
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{reshaped(local, key, tweak, few=0)}@{reshaped(host, key, tweak + '|host', few=0)}.{top}"
    if kind == "iban":
        land = canonical[:2]
        body = reshaped(canonical[4:], key, tweak)
        number = "".join(str(int(c, 36)) for c in body + land + "00")
        return f"{land}{98 - int(number) % 97:02d}{body}"
    if kind.startswith("given"):
        _, gender, script = kind.split(":")
        names = GIVEN[script][gender]
        name = names[_pick(key, f"{tweak}|{canonical}", len(names))]
        extra = "-" + names[_pick(key, f"{tweak}|{canonical}|2", len(names))] if attempt else ""
        return name + extra + ("" if attempt < 3 else "-" + _surname(key, f"{tweak}|{canonical}", script, 2 + attempt))
    if kind.startswith("surname"):
        return _surname(key, f"{tweak}|{canonical}", kind.split(":")[1], 3 + attempt)
    if kind.startswith("initial"):  # a keyed turn of the alphabet: never the letter itself, never one letter for two
        letters = INITIALS[kind.split(":")[1]]
        turn = 1 + _pick(key, kind, len(letters) - 1)
        return letters[(letters.index(canonical) + turn) % len(letters)] if canonical in letters else letters[_pick(key, f"{kind}|{canonical}", len(letters))]
    if kind == "aws_key":
        return canonical[:4] + reshaped(canonical[4:], key, tweak)
    return reshaped(canonical, key, tweak, hexa=bool(re.fullmatch("[0-9a-f]+", canonical)))


def _surname(key: bytes, tweak: str, script: str, n: int) -> str:
    s = SYLLABLES[script]
    return "".join(s[_pick(key, f"{tweak}|{k}", len(s))] for k in range(n)).capitalize()


# ---- detection ------------------------------------------------------------

_NAME = r"[^\W\d_a-zß-öø-ÿа-яά-ώ][^\W\d_]+(?:-[^\W\d_]+)?"
_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
_NUMBERS = re.compile(
    r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+(?!1[ .(-])\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w|\.\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])(?:\d{4}[ -]?){3}\d{1,7}(?![\w-])|(?<![\w-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-]))"
)
# Lengths by the IBAN registry.
_IBAN_LENGTHS = {
    land: n
    for n, lands in {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}.items()
    for land in lands.split()
}
# Country codes of two digits; 1 and 7 stand alone, all others have three.
_TWO_DIGIT_CODES = {"20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}
_AWS = re.compile(r"\bAKIA[0-9A-Z]{16}\b")
_SECRET = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?([A-Za-z0-9_+/\-.]{8,})")
_ANY_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
# A word of a name (O'Brien and double names too), an initial, and what may stand between them.
_WORD = rf"(?!(?:{_ANY_TITLE}|Jr|Jnr|II|III|IV)\b)(?:[^\W\d_a-zß-öø-ÿа-яά-ώ]['’](?=[^\W\d_a-zß-öø-ÿа-яά-ώ]))?{_NAME}"
_INITIAL = r"[^\W\d_a-zß-öø-ÿа-яά-ώ](?:\.(?:-(?=[^\W\d_a-zß-öø-ÿа-яά-ώ]\.))?|(?=[ \t\xa0]+[^\W\d_a-zß-öø-ÿа-яά-ώ]))"
_GAP = r"(?:[ \t\xa0]+(?:(?:van|von|vom|zu|zur|der|den|dem|ter|ten|de|del|della|di|da|dos|das|du|la|las|los|le|el|al|bin|ibn|y|e)[ \t\xa0]+){0,3}|(?<=[.-]))"
_PART = re.compile(rf"(?P<word>{_WORD})|(?P<initial>{_INITIAL})")
_TITLE = re.compile(rf"\b(?P<titles>(?:{_ANY_TITLE})\b\.?(?:[ \t\xa0]+(?:{_ANY_TITLE})\b\.?)*){_GAP}(?P<name>(?:{_WORD}|{_INITIAL})(?:{_GAP}(?:{_WORD}|{_INITIAL}))*)")
_TITLES_IN = re.compile(rf"\b(?:{_ANY_TITLE})\b")
_TITLE_HINT = tuple(TITLES)
_DIGIT = re.compile(r"[0-9]")


def _iban_ok(s: str) -> bool:
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _canonical(kind: str, text: str) -> str | None:
    """The form that all mentions of an entity share; None if the match is none."""
    if kind == "ip":
        parts = text.split(".")
        return ".".join(str(int(p)) for p in parts) if all(int(p) < 256 for p in parts) else None
    if kind == "phone":
        digits = re.sub(r"\D", "", text.replace("(0)", "") if text[0] == "+" else f"1{text}")
        size = 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGIT_CODES else 3
        return f"+{digits[:size]} {digits[size:]}" if 8 <= len(digits) <= 15 else None
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        return digits if 13 <= len(digits) <= 19 and digits[0] in "23456" and luhn(digits) == 0 else None
    if kind == "iban":
        s = text.replace(" ", "")
        return s if _iban_ok(s) else None
    return text.lower() if kind == "email" else text


def _numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Numbered entities; a match may go too far, so it is tried with shorter ends, and what is none swallows nothing."""
    m = _NUMBERS.search(text)
    while m is not None:
        (lo, hi), kind, c = m.span(), m.lastgroup, None
        ends = [hi]
        if kind in ("iban", "phone"):
            ends += sorted((lo + g.start() for g in re.finditer("[ .-]", m[0])), reverse=True)
        if kind == "iban":  # a country's own length comes first
            ends.sort(key=lambda e: len(text[lo:e].replace(" ", "")) != _IBAN_LENGTHS.get(m[0][:2]))
        for hi in ends:
            c = _canonical(kind, text[lo:hi])
            if c is not None:
                yield lo, hi, kind, c
                break
        m = _NUMBERS.search(text, hi if c is not None else lo + 1)


def _persons(text: str) -> list[tuple[int, int, str, str]]:
    """Names after titles, and bare mentions of their words elsewhere in the same text."""
    found: list[tuple[int, int, str, str]] = []
    for m in _TITLE.finditer(text):
        gender = next((g for t in _TITLES_IN.findall(m["titles"]) if (g := TITLES[t]) != "n"), "n")
        parts = list(_PART.finditer(text, *m.span("name")))
        for k, p in enumerate(parts):
            lo, word = p.start(), p[0]
            if p["initial"] is not None:
                found.append((lo, lo + 1, f"initial:{script_of(word)}", word[0]))
            else:  # the first of several is the given name, as far as can be told
                kind = f"given:{gender}" if k == 0 and len(parts) > 1 else "surname"
                found.append((lo, p.end(), f"{kind}:{script_of(word)}", word))
    known: dict[str, tuple[str, str]] = {}
    for _, _, kind, word in found:
        if not kind.startswith("initial"):
            known.setdefault(word, (kind, word))
    for word, entity in list(known.items()):
        known.setdefault(word.upper(), entity)
        if word.isupper():
            known.setdefault(word.capitalize(), entity)
    if known:
        words = "|".join(map(re.escape, sorted(known, key=len, reverse=True)))
        found += [(*m.span(), *known[m[0]]) for m in re.finditer(rf"(?<![^\W\d_])(?:{words})(?![^\W\d_])", text)]
    return found


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(from, to, kind, canonical) of all entities, in order, none overlapping another."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(*m.span(), "email", _canonical("email", m[0])) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += _numbers(text)
    if "AKIA" in text:
        found += [(*m.span(), "aws_key", m[0]) for m in _AWS.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret", m[1]) for m in _SECRET.finditer(text)]
    if any(map(text.__contains__, _TITLE_HINT)):
        found += _persons(text)
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[tuple[int, int, str, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def rendered(mention: str, kind: str, made: str) -> str:
    """A canonical surrogate in the mention's own format; longer ones as they are."""
    if kind in ("phone", "card", "iban") and "-" in made:
        return made
    if kind == "phone":
        head, zero, tail = mention.partition("(0)") if mention[0] == "+" else (mention, "", "")
        digits = iter(made[1:].replace(" ", "") if mention[0] == "+" else made.partition(" ")[2])
        fill = lambda part: "".join(next(digits) if c in _DIGITS else c for c in part)
        return fill(head) + zero + fill(tail)
    if kind == "card":
        digits = iter(made)
        return "".join(next(digits) if c in _DIGITS else c for c in mention)
    if kind == "iban":
        rest = iter(made)
        return "".join(c if c == " " else next(rest) for c in mention)
    if kind.startswith(("given", "surname")) and mention.isupper():
        return made.upper()
    return made


def replace(text: str, key: bytes, attempts: dict[bytes, int]) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (from, to, kind, surrogate) by its new places; ``attempts`` by entity_tag."""
    out, at, spans, length = [], 0, [], 0
    for lo, hi, kind, canonical in mentions(text):
        made = rendered(text[lo:hi], kind, surrogate(kind, canonical, attempts.get(entity_tag(key, kind, canonical), 0) if attempts else 0, key))
        out += [text[at:lo], made]
        length += lo - at
        spans.append((length, length + len(made), kind, made))
        length += len(made)
        at = hi
    return "".join([*out, text[at:]]), spans


# ---- jobs -----------------------------------------------------------------

def entity_tag(key: bytes, kind: str, canonical: str) -> bytes:
    """Names an entity without showing it."""
    return hmac.new(key, f"{kind}\0{canonical}".encode(), hashlib.blake2b).digest()[:16]


def _seen(texts: DataFrame) -> DataFrame:
    """(doc, kind, canonical) of each entity of each row (doc, text), once a row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = [(i.as_py(), k, c) for i, t in zip(batch.column(0), batch.column(1), strict=True) if t.is_valid for k, c in sorted({(k, c) for _, _, k, c in mentions(t.as_py())})]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["doc", "kind", "canonical"])

    return texts.mapInArrow(lean(run), "doc string, kind string, canonical string")


def _made(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt) with each one's surrogate in ``made``."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            b["made"] = [surrogate(k, c, int(a), key) for k, c, a in zip(b["kind"], b["canonical"], b["attempt"], strict=True)]
            yield b

    return entities.select("kind", "canonical", "attempt").mapInPandas(lean(run), "kind string, canonical string, attempt long, made string")


def settle(entities: DataFrame, key: bytes) -> tuple[DataFrame, list[DataFrame]]:
    """Distinct surrogates for distinct (kind, canonical): rows (kind, canonical, attempt) of those whose first one clashes, and the tables written on the way.

    A clash is a surrogate that two entities of a type share, or one that is an
    entity of the corpus itself.  Of those that share one, the first in order
    (attempt, canonical, kind) keeps it and the others move on, until no clash
    is left; surrogates grow longer on the way, so there is an end.
    """
    group = F.split("kind", ":")[0].alias("g")
    own = entities.select(group, F.col("canonical").alias("made")).distinct()
    now = written(_made(entities.select("kind", "canonical", F.lit(0).cast("long").alias("attempt")), key), "surrogates")
    made = [now]
    while True:
        # One row for a surrogate, found by a grouped minimum, so that a name that many would get is no task's burden.
        first = now.groupBy(group, "made").agg(F.min(F.struct("attempt", "canonical", "kind")).alias("w"))
        stays = first.join(own, ["g", "made"], "left_anti").select("w.kind", "w.canonical")
        clash = written(now.join(stays, ["kind", "canonical"], "left_anti").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt")), "clashes")
        made.append(clash)
        if is_empty(clash):
            return now.where("attempt > 0").select("kind", "canonical", "attempt"), made
        now = written(now.join(clash, ["kind", "canonical"], "left_anti").unionByName(_made(clash, key)), "surrogates")
        made.append(now)


#: A name's mentions are dealt to so many tasks when its attempt is looked up.
_DEAL = 16


def _moved_by_doc(seen: DataFrame, key: bytes) -> DataFrame | None:
    """(doc, moved) with tag and attempt of the entities of a text that don't take their first surrogate; None if there are none."""
    entities = written(seen.where("kind NOT LIKE 'initial%'").select("kind", "canonical").distinct(), "entities")  # initials can't clash
    moved, _ = settle(entities, key)
    lists = None
    if not is_empty(moved):
        dealt = moved.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(_DEAL - 1))))
        found = seen.withColumn("deal", F.pmod(F.xxhash64("doc"), F.lit(_DEAL)).cast("int")).join(dealt, ["kind", "canonical", "deal"])

        def tagged(batches: Iterator[pd.DataFrame]):
            for b in batches:
                yield pd.DataFrame({"doc": b["doc"], "tag": [entity_tag(key, k, c) for k, c in zip(b["kind"], b["canonical"], strict=True)], "attempt": b["attempt"]})

        tags = found.select("doc", "kind", "canonical", "attempt").mapInPandas(lean(tagged), "doc string, tag binary, attempt long")
        lists = written(tags.groupBy("doc").agg(F.collect_set(F.struct("tag", "attempt")).alias("moved")), "moved")
    return lists


def with_surrogates(df: DataFrame, key: bytes, text_col: str = "text", spans: bool = True) -> DataFrame:
    """``df`` with its texts replaced, and (unless ``spans`` is off) n_entities and entities.

    entities lists begin, end (in the new text), kind and surrogate.  All
    columns of ``df`` stay, whatever their names; if one is called n_entities or
    entities the new one gets underscores before it.  Null texts stay null and
    have no entities; texts without entities stay as they are.  Repeated rows
    and null identifiers are rows like others.  An empty table gives no rows.
    Tables with entities in clear are removed from the shared folder before
    this returns, or fails; what stays there names them by keyed tags.
    """
    doc = F.md5(F.col(f"`{text_col}`").cast("string").cast("binary"))
    with only_results(df.sparkSession) as keep:
        seen = written(_seen(df.select(doc.alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))).distinct(), "mentions")
        lists = _moved_by_doc(seen, key)
        keep.extend([lists] if lists is not None else [])
    columns = df.columns
    names = {n: spare_name(df, n) for n in ("n_entities", "entities", "moved", "doc")}
    if lists is None:
        source = df.withColumn(names["moved"], F.lit(None).cast("array<struct<tag:binary,attempt:bigint>>"))
    else:
        source = df.join(lists.toDF(names["doc"], names["moved"]), doc == F.col(names["doc"]), "left").drop(names["doc"])
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))
        for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            changed, listed = [], []
            for t, m in zip(batch.column(at), batch.column(len(columns)), strict=True):
                if not t.is_valid:
                    changed.append(None)
                    listed.append([])
                    continue
                attempts = {x["tag"]: x["attempt"] for x in m.as_py()} if m.is_valid else {}
                text, where = replace(t.as_py(), key, attempts)
                changed.append(text)
                listed.append([dict(zip(("begin", "end", "kind", "surrogate"), w, strict=True)) for w in where])
            arrays = [batch.column(k) for k in range(len(columns))]
            arrays[at] = pa.array(changed, pa.string())
            if spans:
                arrays += [pa.array([len(x) for x in listed], pa.int32()), pa.array(listed, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    fields = [T.StructField(f"c{k}", T.StringType() if k == at else f.dataType) for k, f in enumerate(df.schema.fields)]
    extra = [names["n_entities"], names["entities"]] if spans else []
    if spans:
        fields += [T.StructField(f"c{len(columns)}", T.IntegerType()), T.StructField(f"c{len(columns) + 1}", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("surrogate", T.StringType())])))]
    done = source.select(*[F.col(f"`{c}`") for c in columns], names["moved"]).mapInArrow(lean(run), T.StructType(fields))
    return done.toDF(*columns, *extra)


#: Where a session names no key of its own, this one makes results repeatable, and lets anybody undo them.
DEMO_KEY = b"marketloom surrogates"
KEY_SETTING = "spark.marketloom.surrogateKey"


def session_key(spark: SparkSession) -> bytes:
    """The key in the session's setting ``KEY_SETTING``; DEMO_KEY if it has none."""
    told = spark.conf.get(KEY_SETTING, None)
    return told.encode() if told else DEMO_KEY


def op9_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_surrogates(docs, session_key(spark))
    return out.select("doc_id", "text", "n_entities", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["begin"], e["end"])), ",").alias("spans"))


ORACLE: dict[str, str] = {}
