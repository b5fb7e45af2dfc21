"""Surrogates for personal data: keyed, of the same type and format, distinct and coreferent.

Every entity found (mail address, phone, card, bank account, network address, social security
number, secret, name of a person) gets a surrogate that is a function of a secret key and of the
entity's canonical value, so all its mentions, however written, get the same one in their own
format.  Values with a format are permuted within it: a keyed Feistel network over exactly the
values of that format (letters stay letters of their script and case, digits digits, check digits
hold, addresses stay of their kind), which maps different values to different ones.  Names are composed of
syllables of their script, with endings of their gender: the one that most titles of the name tell over the
whole corpus, or without any, the one its own ending tells.  A name has one surrogate whatever its title,
and without one wherever its text has it with a title too.

The distinct entities of the corpus are then checked: two of one type must not share a surrogate,
and none may be a value that occurs in the corpus.  Those that do are drawn again with the next
attempt until none is left; the few with a later attempt travel to the documents that mention them.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latelane.llm.common import small, unused
from latelane.session import materialise

#: Rounds of drawing again; a format so full that this is not enough keeps the plain permutation (distinct, not new).
ATTEMPTS = 12
#: Rounds for names, which grow by a syllable every second round.
NAME_ATTEMPTS = 40
#: Longest value that is permuted; longer secrets are shifted by a stream keyed by the whole value.
PERMUTED = 64

# --- finding entities ----------------------------------------------------------------------

_MAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}", re.U)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)", re.A)
_DIGIT_RUN = re.compile(r"(?<![\d.+])\d+(?:[ -]\d+)*", re.A)
_DIGITS = re.compile(r"\d+", re.A)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A)
_PHONE = re.compile(r"(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])", re.A)
_DIALLED = re.compile(r"(?<![\w+])\+\d+(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d+)*", re.A)
# Country codes and how many digits follow them.
_NATIONAL = {
    "1": (10,), "7": (10,), "20": (9, 10), "27": (9,), "30": (10,), "31": (9,), "32": (8, 9), "33": (9,), "34": (9,), "36": (8, 9),
    "39": (8, 9, 10, 11), "40": (9,), "41": (9,), "43": (7, 8, 9, 10, 11), "44": (9, 10), "45": (8,), "46": (7, 8, 9), "47": (8,), "48": (9,),
    "49": (7, 8, 9, 10, 11), "51": (8, 9), "52": (10,), "54": (10, 11), "55": (10, 11), "56": (9,), "57": (8, 10), "60": (8, 9, 10), "61": (9,),
    "62": (8, 9, 10, 11), "63": (8, 10), "64": (8, 9, 10), "65": (8,), "66": (8, 9), "81": (9, 10), "82": (8, 9, 10), "84": (9, 10),
    "86": (10, 11), "90": (10,), "91": (10,), "92": (9, 10), "351": (9,), "353": (7, 8, 9), "358": (7, 8, 9, 10), "380": (9,), "420": (9,),
    "421": (9,), "966": (8, 9), "971": (8, 9), "972": (8, 9),
}
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)
_SECRET = re.compile(
    r"(?i:\b(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|private[_-]?key)\b[\"']?\s*[:=]\s*)"
    r"(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([^\s\"',;]{5,}[^\s\"',;.!?)]))"
    r"|\b((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})\b"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----([^-]+)-----END", re.A,
)
_SECRET_HINT = re.compile(r"(?i)pass|pwd|token|secret|key|AKIA|ASIA|gh[pousr]_|sk-|xox")
# Titles and the gender that they tell; a doctor or professor may be either.
_TITLES = {
    **dict.fromkeys(("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Г-н", "Κύριος"), "m"),
    **dict.fromkeys(("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "Госпожа", "Г-жа", "Κυρία"), "f"),
    **dict.fromkeys(("Dr", "Prof", "Доктор"), "x"),
}
_NAME = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_PERSON = re.compile(rf"\b({'|'.join(sorted(map(re.escape, _TITLES), key=len, reverse=True))})\b\.?[ \u00a0]({_NAME}(?: {_NAME}){{0,2}})")
_TITLE_HINT = re.compile("|".join(map(re.escape, _TITLES)))
_WORD = re.compile(_NAME)
_POSSESSIVE = re.compile("['’]s\\Z")
#: Shorter parts of a name are looked for only within the whole name.
LEAST_NAME = 3


def luhn(digits: str) -> int:
    """The digit sum that is a multiple of ten for valid card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def _is_card(value: str) -> bool:
    prefix = value[0] in "3456" or "2221" <= value[:4] <= "2720"
    return 13 <= len(value) <= 19 and prefix and luhn(value) == 0 and len(set(value)) > 1


def _cards(text: str) -> list[tuple[int, int, str]]:
    """Card numbers among digit groups with single blanks or hyphens between them.

    A number may begin and end at any group, so a neighbour does not hide it.  Of overlapping ones that are all valid, one
    group wins over several, then sixteen digits over another length, then the longer, then the earlier one.
    """
    found = []
    for run in _DIGIT_RUN.finditer(text):
        groups = [(m.start(), m.end(), m[0]) for m in _DIGITS.finditer(text, run.start(), run.end())]
        for i, (a, _, first) in enumerate(groups):
            if first[0] not in "23456" or text[a - 1 : a] == "-":
                continue
            value = ""
            for j in range(i, len(groups)):
                value += groups[j][2]
                if len(value) > 19:
                    break
                if len(value) >= 13 and text[groups[j][1] : groups[j][1] + 1] != "-" and _is_card(value):
                    found.append((j > i, len(value) != 16, -len(value), a, groups[j][1], value))
    kept: list[tuple[int, int, str]] = []
    for *_, a, b, value in sorted(found):
        if all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, value))
    return kept


def _dialled(text: str, others: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Phone numbers with a country code, out of spans of ``others``.

    Of the groups that follow, a number has as many as its country's numbers have digits; for a country that is not
    listed, all up to 15 digits, but none after a blank once hyphens or dots have parted them.
    """
    found = []
    for run in _DIALLED.finditer(text):
        end = min([run.end(), *(a for a, b in others if run.start() < b and a < run.end())])
        groups = [(m.start(), m.end()) for m in _DIGITS.finditer(text, run.start(), end)]
        if not groups:
            continue
        digits = lambda j: re.sub(r"\D", "", text[groups[0][0] : groups[j][1]])
        first = text[groups[0][0] : groups[0][1]]
        code = next((first[:n] for n in (3, 2, 1) if first[:n] in _NATIONAL), None)
        trunk = "(0)" in text[run.start() : end]
        parted, fits, sizes = False, [], {}
        for j in range(len(groups)):
            between = text[groups[j - 1][1] : groups[j][0]] if j else ""
            if (between == " " and parted) or len(value := digits(j)) > 15:
                break
            parted = parted or between in ("-", ".")
            sizes[j] = len(value) - trunk
            if len(value) >= 7:
                fits.append(j)
        known = [j for j in fits if code and sizes[j] - len(code) in _NATIONAL[code]]
        if known or fits:
            last = (known or fits)[-1]
            found.append((run.start(), groups[last][1], digits(last)))
    return found


def _untitled(text: str, people: list[list[tuple[str, str]]], known: set[int]) -> list[tuple[int, int, str, str]]:
    """Mentions without a title of the ``people`` (kind and value of each part) that the text names with one.

    A whole name counts wherever it stands; a part of it alone counts if it has a capital, ``LEAST_NAME`` letters, and is
    nowhere in the text a word without a capital.  A part that is a surname here and a given name there is taken as a surname.
    ``known`` are the starts of mentions that are found already.
    """
    alone: dict[str, str] = {}
    by_first: dict[str, list] = {}
    for person in people:
        if len(person) > 1:
            by_first.setdefault(person[0][1], []).append(person)
        for kind, value in person:
            if value not in alone or kind.startswith("surname") and not alone[value].startswith("surname"):
                alone[value] = kind
    words = [(m.start(), m.start() + len(name), name) for m in _WORD.finditer(text) if (name := _POSSESSIVE.sub("", m[0])).lower() in alone]
    plain = {name for _, _, name in words if name.islower()}
    out, i = [], 0
    while i < len(words):
        a, b, name = words[i]
        whole = 0
        for person in by_first.get(name.lower(), ()) if a not in known and name[0].isupper() else ():
            run = words[i : i + len(person)]
            joined = all(text[x[1] : y[0]].isspace() and y[2][0].isupper() for x, y in zip(run, run[1:]))
            if joined and [x[2].lower() for x in run] == [value for _, value in person] and len(person) > whole:
                whole, parts = len(person), [(x[0], x[1], kind, value) for x, (kind, value) in zip(run, person)]
        if whole:
            out += parts
        elif a not in known and name[0].isupper() and len(name) >= LEAST_NAME and name.lower() not in plain:
            out.append((a, b, alone[name.lower()], name.lower()))
        i += whole or 1
    return out


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value) of the entities of a text, in order and without overlaps."""
    found = []

    def add(kind, m, value, group=0):
        if m[group]:
            found.append((m.start(group), m.end(group), kind, value))

    if "@" in text:
        for m in _MAIL.finditer(text):
            add("mail", m, m[0].lower())
    if _SECRET_HINT.search(text):
        for m in _SECRET.finditer(text):
            for g in range(1, 6):
                # After a colon, a plain word is prose and no secret.
                if m[g] and not (g == 3 and m[g].isalpha() and "=" not in m[0]):
                    add("secret", m, m[g], g)
    if re.search(r"[0-9]", text):
        for m in _IBAN.finditer(text):
            value = m[0].replace(" ", "")
            if 15 <= len(value) <= 34 and _iban_rest(value) == 1:
                add("iban", m, value)
        cards = _cards(text)
        taken = [(a, b) for a, b, _ in cards]
        found += [(a, b, "card", value) for a, b, value in cards]
        for m in _IP.finditer(text):
            add("ip", m, m[0])
            taken.append(m.span())
        found += [(a, b, "phone", value) for a, b, value in _dialled(text, taken)] if "+" in text else []
        for m in _PHONE.finditer(text):
            add("phone", m, re.sub(r"\D", "", m[0]))
        for m in _SSN.finditer(text):
            if _valid_ssn(value := m[0].replace("-", "")):
                add("ssn", m, value)
    if _TITLE_HINT.search(text):
        people, m = [], _PERSON.search(text)
        while m:
            names = [_POSSESSIVE.sub("", x) for x in re.findall(_NAME, m[2])]
            at, kept = m.start(2), []
            for name in names:  # the name goes on as long as its words have a capital, to the next title
                at = text.index(name, at)
                if not name[0].isupper() or name in _TITLES:
                    break
                kept.append((at, at + len(name), name))
                at += len(name)
            gender = _TITLES[m[1]]
            person = []
            for i, (a, b, name) in enumerate(kept):
                part = "surname" if i == len(kept) - 1 else "given"
                person.append((a, b, f"{part}:{gender if part == 'given' else _surname_gender(gender, name)}:{script(name)}", name.lower()))
            found += person
            people.append([x[2:] for x in person])
            # From the end of the name: what follows may be the next person's title.
            m = _PERSON.search(text, kept[-1][1] if kept else m.end(1))
        found += _untitled(text, [p for p in people if p], {x[0] for x in found})
    order = {k: i for i, k in enumerate(("secret", "mail", "iban", "card", "ip", "phone", "ssn"))}
    found.sort(key=lambda x: (order.get(x[2], 9), x[0]))
    kept, taken = [], []
    for item in found:
        if all(item[1] <= a or item[0] >= b for a, b in taken):
            taken.append(item[:2])
            kept.append(item)
    return sorted(kept)


# --- formats and keyed permutations ---------------------------------------------------------

_RANGES = [  # alphabets: letters stay in theirs, so script and case are kept
    ("0", "9"), ("a", "z"), ("A", "Z"), ("ß", "ö"), ("ø", "ÿ"), ("À", "Ö"), ("Ø", "Þ"), ("α", "ω"), ("Α", "Ρ"), ("Σ", "Ω"), ("а", "я"),
    ("А", "Я"), ("א", "ת"), ("ء", "غ"), ("ぁ", "ゖ"), ("ァ", "ヺ"), ("一", "龥"), ("가", "힣"),
]


@lru_cache(maxsize=100_000)
def _alphabet(c: str) -> tuple[int, int] | None:
    """First code point and size of the alphabet of a character; None if it stays as it is."""
    for a, b in _RANGES:
        if a <= c <= b:
            return ord(a), ord(b) - ord(a) + 1
    return None


def script(name: str) -> str:
    c = name[0].lower()
    return "cyrillic" if "а" <= c <= "я" or c == "ё" else "greek" if "ά" <= c <= "ώ" else "latin" if c < "ɐ" else "other"


def _prf(key: bytes, *parts) -> int:
    message = b"\x00".join(p if isinstance(p, bytes) else str(p).encode("utf-8", "surrogatepass") for p in parts)
    return int.from_bytes(hmac.new(key, message, hashlib.sha256).digest(), "big")


def permuted(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network on the next even number of bits, walked until inside."""
    if size < 2:
        return x
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(8):
            left, right = right, left ^ (_wide(key, half, tweak, r, right) & mask)
        x = left << half | right
        if x < size:
            return x


def _wide(key: bytes, bits: int, *parts) -> int:
    out, i = _prf(key, *parts), 1
    while i * 256 < bits:
        out = out << 256 | _prf(key, *parts, i)
        i += 1
    return out


def _within_format(chars: str, fixed: set[int], key: bytes, tweak: str) -> str:
    """``chars`` with its free places permuted jointly; alphabets and the rest stay."""
    places = [(i, a) for i, c in enumerate(chars) if i not in fixed and (a := _alphabet(c))]
    signature = "".join(c if i in fixed or not (a := _alphabet(c)) else f"\x01{a[0]:x}\x02" for i, c in enumerate(chars))
    x, size = 0, 1
    for i, (first, n) in places:
        x, size = x * n + ord(chars[i]) - first, size * n
    out = list(chars)
    if len(places) > PERMUTED:
        stream = _wide(key, 48 * len(places), "stream", tweak, chars)
        for k, (i, (first, n)) in enumerate(places):
            out[i] = chr(first + (ord(chars[i]) - first + (stream >> 48 * k) % n) % n)
        return "".join(out)
    x = permuted(x, size, key, f"{tweak}\x00{signature}")
    for i, (first, n) in reversed(places):
        x, r = divmod(x, n)
        out[i] = chr(first + r)
    return "".join(out)


# Ranges of addresses with a purpose of their own: private, loopback, local and special ones.
_IP_RANGES = [
    (a << 24 | b << 16, size) for a, b, size in (
        (10, 0, 1 << 24), (172, 16, 1 << 20), (192, 168, 1 << 16), (127, 0, 1 << 24), (169, 254, 1 << 16), (0, 0, 1 << 24),
        (224, 0, 1 << 29))
]


def _ip_range(n: int) -> tuple[int, int] | None:
    return next((r for r in _IP_RANGES if r[0] <= n < r[0] + r[1]), None)


def _valid_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _hex_places(value: str) -> bool:
    return len(value) >= 12 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None and re.search("[a-fA-F]", value) is not None


# Syllables that names are composed of, and the endings that tell a gender.
_SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"],
    "greek": [c + v for c in "βγδκλμνπρστφ" for v in "αεηιο"],
}
_ENDINGS = {
    ("given", "m", "latin"): ("n", "rd", "s", "k"), ("given", "f", "latin"): ("na", "lia", "ra", "tte"),
    ("given", "x", "latin"): ("lin", "ry", "ris", "ley"), ("surname", "x", "latin"): ("son", "er", "mann", "ley"),
    ("given", "m", "cyrillic"): ("н", "р", "слав", "й"), ("given", "f", "cyrillic"): ("на", "ра", "лия", "ся"),
    ("given", "x", "cyrillic"): ("ша", "ня"), ("surname", "m", "cyrillic"): ("ов", "ин", "ский"),
    ("surname", "f", "cyrillic"): ("ова", "ина", "ская"), ("surname", "x", "cyrillic"): ("ко", "ян"),
    ("given", "m", "greek"): ("ος", "ης", "ας"), ("given", "f", "greek"): ("α", "η", "ω"), ("given", "x", "greek"): ("ις",),
    ("surname", "m", "greek"): ("ίδης", "όπουλος"), ("surname", "f", "greek"): ("ίδου", "οπούλου"), ("surname", "x", "greek"): ("άκη",),
}


def _surname_gender(gender: str, name: str) -> str:
    """Surnames have a gender in scripts whose endings tell it."""
    return gender if script(name) in ("cyrillic", "greek") else "x"


def own_gender(part: str, writing: str, name: str) -> str:
    """The gender that a name's own ending tells, where no title does."""
    if part == "surname" and writing not in ("cyrillic", "greek"):
        return "x"
    female = {"latin": ("a", "ette", "ine"), "cyrillic": ("а", "я"), "greek": ("α", "η", "ω", "ού")}.get(writing, ())
    return "f" if name.endswith(female) else "m"


def identity(kind: str) -> tuple[str, str]:
    """(kind without the gender, gender): what a mention's title tells is evidence, not part of who is meant."""
    if ":" not in kind:
        return kind, ""
    part, gender, writing = kind.split(":")
    return f"{part}:{writing}", gender


def _gendered(kind: str, value: str, gender: str) -> str:
    """The kind for :func:`surrogate` of an entity whose gender is settled, or '' for its own."""
    if ":" not in kind:
        return kind
    part, writing = kind.split(":")
    return f"{part}:{gender or own_gender(part, writing, value)}:{writing}"


def format_class(kind: str, value: str) -> str:
    """All values that a surrogate of ``value`` can be: a permutation maps a class onto itself."""
    keep = lambda c: f"{a[0]:x}." if (a := _alphabet(c)) else c
    if kind == "ip":
        own = _ip_range(sum(int(x) << 8 * (3 - i) for i, x in enumerate(value.split("."))))
        return f"ip {own}"
    if kind == "card":
        return f"card {value[0]}{len(value)}"
    if kind == "phone":
        country = max(0, len(value) - 10)
        return f"phone {value[:country]} {value[country] == '0'} {len(value)}"
    if kind == "iban":
        return f"iban {value[:2]} {''.join(map(keep, value[4:]))}"
    if kind == "secret" and _hex_places(value):
        return f"hex {len(value)} {value == value.lower()}"
    if kind == "secret" and re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox", value):
        return f"secret {value[:4]}{''.join(map(keep, value[4:]))}"
    if kind == "mail":
        local, domain = value.rsplit("@", 1)
        labels = domain.split(".")
        same = [i == len(labels) - 1 or x in ("example", "test", "invalid", "localhost") for i, x in enumerate(labels)]
        return f"mail {''.join(map(keep, local))}@{'.'.join(x if s else ''.join(map(keep, x)) for x, s in zip(labels, same))}"
    return f"{kind} {''.join(map(keep, value))}"


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value.  For formats a bijection of values of that format, for each attempt."""
    tweak = f"{kind}:{attempt}"
    if kind == "mail":
        local, domain = value.rsplit("@", 1)
        labels = domain.split(".")
        # The top label, and names reserved for examples, stay.
        kept, at = set(), 0
        for i, label in enumerate(labels):
            if i == len(labels) - 1 or label in ("example", "test", "invalid", "localhost"):
                kept |= set(range(at, at + len(label)))
            at += len(label) + 1
        new = _within_format(domain, kept, key, f"domain:{attempt}")
        return _within_format(local, set(), key, f"{tweak}@{domain}") + "@" + new
    if kind == "phone":
        country = max(0, len(value) - 10)
        fixed = set(range(country)) | ({country} if value[country] == "0" else set())
        return _walk(value, lambda v: _within_format(v, fixed, key, tweak), lambda v: value[country] == "0" or v[country] != "0")
    if kind == "card":
        body = _within_format(value[:-1], {0}, key, tweak)
        return body + str(-luhn(body + "0") % 10)
    if kind == "ssn":
        return _walk(value, lambda v: _within_format(v, set(), key, tweak), _valid_ssn)
    if kind == "iban":
        body = value[:2] + "00" + _within_format(value[4:], set(), key, tweak + value[:2])
        return body[:2] + f"{98 - _iban_rest(body):02d}" + body[4:]
    if kind == "ip":
        n = 0
        for part in value.split("."):
            n = n << 8 | int(part)
        if own := _ip_range(n):
            n = own[0] + permuted(n - own[0], own[1], key, f"{tweak}:{own[0]}")
        else:
            n = _walk(n, lambda x: permuted(x, 1 << 32, key, tweak), lambda x: not _ip_range(x))
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "secret":
        if _hex_places(value):
            digits = "0123456789abcdef" if value == value.lower() else "0123456789ABCDEF"
            if len(value) > 2 * PERMUTED:
                n = _wide(key, 4 * len(value), "hex", tweak, value) % 16 ** len(value)
            else:
                n = permuted(int(value, 16), 16 ** len(value), key, f"{tweak}:{len(value)}:{digits[-1]}")
                # A permuted value without letters would no longer look like one: walk on.
                n = _walk(n, lambda x: permuted(x, 16 ** len(value), key, f"{tweak}:{len(value)}:{digits[-1]}"),
                          lambda x: not f"{x:0{len(value)}x}".isdigit(), started=True)
            return "".join(digits[int(c, 16)] for c in f"{n:0{len(value)}x}")
        fixed = set(range(4)) if re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox", value) else set()
        return _within_format(value, fixed, key, tweak)
    part, gender, writing = kind.split(":")
    if writing not in _SYLLABLES:
        return _within_format(value, set(), key, tweak)
    n = _prf(key, "name", tweak, value)
    out = []
    for _ in range(2 + (part == "surname") + attempt // 2):
        n, r = divmod(n, len(_SYLLABLES[writing]))
        out.append(_SYLLABLES[writing][r])
    endings = _ENDINGS.get((part, gender, writing)) or _ENDINGS[part, "x", writing]
    return "".join(out) + endings[n % len(endings)]


def _walk(x, step, inside, started: bool = False):
    """Apply a permutation until the value is inside its class again; on the class this is a permutation too."""
    if not started:
        x = step(x)
    while not inside(x):
        x = step(x)
    return x


def written(kind: str, mention: str, new: str) -> str:
    """A canonical surrogate in the format of a mention: its separators, its capitals."""
    if kind in ("phone", "card", "iban", "ssn"):
        rest = iter(new)
        return "".join(next(rest) if c.isalnum() else c for c in mention)
    if kind == "mail":
        return "".join(n.upper() if m.isupper() and len(n.upper()) == 1 else n for m, n in zip(mention, new))
    if ":" in kind:
        return new.upper() if len(mention) > 1 and mention.isupper() else new[:1].upper() + new[1:]
    return new


# --- on tables -----------------------------------------------------------------------------

def _mentions(batches):
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
            found = {(*identity(k), v) for _, _, k, v in find(text)} if text else ()
            rows += [(doc, kind, value, gender) for kind, gender, value in found]
        columns = zip(("doc", "kind", "value", "gender"), zip(*rows) if rows else ([],) * 4, (pa.int64(), *(pa.string(),) * 3))
        yield pa.RecordBatch.from_pydict({name: pa.array(values, kind) for name, values, kind in columns})


_ENTITY = "kind string, value string, gender string, attempt int"


def _drawn(key: bytes):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "gender", "attempt")))
            new = [surrogate(_gendered(k, v, g), v, key, a) for k, v, g, a in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "value", "gender", "attempt", "new"])

    return run


def _classes(batches):
    for batch in batches:
        forms = [format_class(k, v) for k, v in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=[*batch.schema.names, "form"])


def settled_genders(mentions: DataFrame) -> DataFrame:
    """The distinct entities ``kind``, ``value``, ``gender``: for a name the one most mentions' titles tell, '' if they tell none or as many."""
    m, f = F.count_if(F.col("gender") == "m"), F.count_if(F.col("gender") == "f")
    return mentions.groupBy("kind", "value").agg(F.when(m > f, "m").when(f > m, "f").otherwise("").alias("gender"))


def assign(entities: DataFrame, key: bytes, attempts: int = ATTEMPTS) -> DataFrame:
    """Surrogates of distinct ``entities`` (kind, value, and gender where it is settled): kind, value, gender, attempt, new.

    Within a kind no two values get the same, and none gets a value of ``entities``.  A draw that
    is taken, by the smaller attempt and then the smaller value, is drawn again; names are, up to ``NAME_ATTEMPTS``
    times, as they grow longer.  What ``attempts`` rounds leave open is of a format that the corpus nearly fills; the values
    of that format, and only they, then keep the first permutation, which is distinct but may name values of the corpus.
    """
    schema = f"{_ENTITY}, new string"
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit(""))
    entities = entities.select("kind", "value", "gender")
    open_rows, settled = entities.withColumn("attempt", F.lit(0)), None
    is_name = F.col("kind").contains(":")
    given_up = None
    for attempt in range(max(attempts, NAME_ATTEMPTS)):
        drawn = materialise(open_rows.mapInArrow(_drawn(key), schema), "surrogates")
        every = drawn if settled is None else settled.unionByName(drawn)
        first = every.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value")).alias("first"))
        checked = every.join(first, ["kind", "new"]).join(
            entities.select("kind", F.col("value").alias("new"), F.lit(True).alias("real")), ["kind", "new"], "left"
        )
        good = F.col("real").isNull() & (F.col("first.value") == F.col("value"))
        checked = materialise(checked.select("kind", "value", "gender", "attempt", "new", good.alias("good")), "surrogates_checked")
        settled = checked.filter("good").drop("good")
        open_rows = checked.filter("not good").select("kind", "value", "gender", F.lit(attempt + 1).alias("attempt"))
        if attempt + 1 == attempts:
            given_up = open_rows.filter(~is_name)
        if attempt + 1 >= attempts:
            open_rows = open_rows.filter(is_name)
        if open_rows.isEmpty():
            break
    left = open_rows if given_up is None else given_up.unionByName(open_rows)
    if left.isEmpty():
        return settled
    classed = f"{_ENTITY}, form string"
    full = materialise(left.mapInArrow(_classes, classed).select("kind", "form").distinct(), "full_formats")
    every = materialise(entities.withColumn("attempt", F.lit(0)).mapInArrow(_classes, classed), "entity_formats")
    plain = every.join(full, ["kind", "form"], "left_semi").drop("form")
    others = settled.join(plain.select("kind", "value"), ["kind", "value"], "left_anti")
    return others.unionByName(plain.mapInArrow(_drawn(key), schema))


def _replaced(key: bytes, text: str, later: str, names: list[str], columns: list[str], count: str | None):
    def run(batches):
        for batch in batches:
            out, counts = [], []
            known: dict[tuple[str, str, str, int], str] = {}
            for old, listed in zip(batch.column(text).to_pylist(), batch.column(later).to_pylist()):
                parts, at, found = [], 0, find(old) if old else []
                settled = {(x["kind"], x["value"]): (x["gender"], x["attempt"]) for x in listed or ()}
                for a, b, kind, value in found:
                    who = identity(kind)[0]
                    entity = (who, value, *settled.get((who, value), ("", 0)))
                    if entity not in known:
                        known[entity] = surrogate(_gendered(*entity[:3]), value, key, entity[3])
                    parts += [old[at:a], written(kind, old[a:b], known[entity])]
                    at = b
                out.append(old if not found else "".join([*parts, old[at:]]))
                counts.append(len(found))
            arrays = [pa.array(out, batch.schema.field(c).type) if c == text else batch.column(c) for c in columns]
            if count:
                arrays.append(pa.array(counts, pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def redact(df: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``df`` with the entities in ``text`` replaced by their surrogates; ``count`` names an added column with their number,
    which replaces a column of that name.

    All other columns stay as they are.  Null and empty texts stay null and empty, texts without
    entities stay unchanged.  The same entity has the same surrogate in all documents, and different
    entities of a type have different ones.  Null keys and repeated rows are treated like others;
    an empty table gives no rows.  Whole texts are read.
    """
    if count and count.lower() in (c.lower() for c in df.columns):
        df = df.drop(count)
    # By the text's hash, a list is bounded by its text's own entities, whatever the keys; texts of one hash share a list.
    doc = F.xxhash64(F.col(f"`{text}`"))
    mentions = df.select(doc.alias("doc"), F.col(f"`{text}`").alias("text")).mapInArrow(_mentions, "doc long, kind string, value string, gender string")
    mentions = materialise(mentions, "mentions")
    entities = materialise(settled_genders(mentions), "entities")
    # What a document cannot tell from its own text: later draws, and genders that titles elsewhere tell.
    told = assign(entities, secret).filter("attempt > 0 or gender <> ''").select("kind", "value", "gender", "attempt")
    told = mentions.select("doc", "kind", "value").distinct().join(told, ["kind", "value"]).groupBy("doc").agg(
        F.to_json(F.collect_list(F.struct("kind", "value", "gender", "attempt"))).alias("listed")
    )
    columns = df.columns
    at, of, listed, later = unused(columns, "__at", "__of", "__listed", "__later")
    told = materialise(told.select(F.col("doc").alias(of), F.col("listed").alias(listed)), "redrawn")
    joined = df.select(*[F.col(f"`{c}`") for c in columns], doc.alias(at)).join(small(told), F.col(at) == F.col(of), "left")
    kind = "array<struct<kind: string, value: string, gender: string, attempt: int>>"
    joined = joined.select(*[F.col(f"`{c}`") for c in columns], F.from_json(listed, kind).alias(later))
    names = [*columns, *([count] if count else [])]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + (f", `{count}` long" if count else "")
    return joined.mapInArrow(_replaced(secret, text, later, names, columns, count), schema)
