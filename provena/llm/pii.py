"""Format-preserving pseudonyms for personal data.

Numbers and dates are found by pattern, validated (check digits, calendar, ranges), turned into an index of the finite
set of all valid values of their format, permuted there by a keyed Feistel network with cycle walking, and written back
in the same format. The permutation depends on the key and the kind of value only, so equal values stay linked in and
across documents, whatever separators they are written with, and two values never become one.

| kind | valid if | kept | permuted |
| card | 13-19 digits, Luhn | first digit, length, separators | the others; the check digit is made anew |
| iban | mod 97 | country, length, groups | account characters in their classes; check digits anew |
| phone | North American plan, or + and 8-15 digits | country code, layout | area, exchange and line in their ranges; other digits |
| ssn | issued ranges | layout | area, group, serial in their ranges |
| ip | four octets | range (public, 10/8, 172.16/12, 192.168/16, other) | the address in its range |
| date | calendar | layout, month's form, leading zeros | the day in its span of 200 years |
| email | has a domain | domain, layout, case, script | local part, letters and digits in their classes |
| secret | AKIA key, value behind password= or password: (any case), token = "" value | prefix, layout, case, script | characters in their classes |

A day has one pseudonym in every layout, and a layout never has one pseudonym for two days. Numbers between slashes are
read month first unless the first is above 12; they are always written month first, because a pseudonym in the other
order would often be read as another day. Letters and digits beyond ASCII are permuted among those of their general
category in the same 256 code points.

Defined results: null stays null and empty stays empty; values that fail validation are left as they are, after spans of
cards and IBANs that end at an earlier blank were tried, and the search goes on behind their first group; repeated rows
get equal results; text around values is untouched; empty tables give empty results. A pseudonym may by chance equal its
value (one in the size of its format, at least 73,049 for dates).
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from datetime import date, timedelta
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.llm.text import release_memory

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS)

PATTERN = re.compile(
    rf"""
    (?P<email>(?<![\w.+%-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)
  | (?P<secret>(?<![A-Za-z0-9])AKIA[0-9A-Z]{{16}}(?![A-Za-z0-9])|(?:(?<=(?i:password)[=:])|(?<=(?i:password)[=:]\ ))[^\s"'<>&;,]+|(?<=token\ =\ ")[^\s"]+)
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))
  | (?P<date>(?<![\w/.-])(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|(?:{_MONTH})\ \d{{1,2}},\ \d{{4}}|\d{{1,2}}\ (?:{_MONTH})\ \d{{4}})(?![\w/-])|(?<![\w/.-])\d{{4}}-\d{{2}}-\d{{2}}(?=T\d))
  | (?P<ip>(?<![\w.])\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?!\.?\w))
  | (?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
  | (?P<phone>(?<![\w+(-])(?:(?:\+?1[ .-]?)?(?:\(\d{{3}}\)[ ]?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}|\+\d(?:[ ().-]{{0,2}}\d){{7,14}})(?!\w|-\d))
  | (?P<card>(?<![\w-])\d(?:[ -]?\d){{12,18}}(?!\w|-\d))
    """,
    re.X,
)
_HINT = re.compile(r"""[0-9@]|(?i:password)[=:]|token = ["]""")


@cache
def _class(c: str) -> str:
    """The characters that c may become; empty for what is neither letter nor digit."""
    if c.isascii():
        return next((s for s in (DIGITS, LOWER, UPPER) if c in s), "")
    kind, row = unicodedata.category(c), ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(max(row, 128), row + 256)) if unicodedata.category(x) == kind) if kind[0] in "LN" else ""


class Permuter:
    """Keyed permutations of finite sets."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def index(self, x: int, size: int, kind: str) -> int:
        """The permuted place of x in range(size): a Feistel network over Z_a x Z_b, walked until it is back in range."""
        if size < 2:
            return x
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            left, right = divmod(x, b)
            for i in range(ROUNDS):
                told = f"{kind}/{size}/{i}/{right if i % 2 == 0 else left}".encode()
                f = int.from_bytes(hashlib.blake2b(told, key=self.key, digest_size=16).digest(), "big")
                if i % 2 == 0:
                    left = (left + f) % a
                else:
                    right = (right + f) % b
            x = left * b + right
            if x < size:
                return x

    def characters(self, value: str, kind: str) -> str:
        """value with its letters and digits permuted within their classes, 64 characters at a time, all else in place."""
        if len(value) > 64:
            return "".join(self.characters(value[i : i + 64], f"{kind}+{i}") for i in range(0, len(value), 64))
        classes = list(map(_class, value))
        x, size = 0, 1
        for c, s in zip(value, classes):
            if s:
                x, size = x * len(s) + s.index(c), size * len(s)
        shape = "".join(s[0] if s else c for c, s in zip(value, classes))
        x = self.index(x, size, f"{kind}/{shape}")
        out = list(value)
        for i in range(len(value) - 1, -1, -1):
            if s := classes[i]:
                x, k = divmod(x, len(s))
                out[i] = s[k]
        return "".join(out)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _refill(layout: str, digits: str) -> str:
    """layout with its letters and digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in layout)


def _card(p: Permuter, value: str) -> str | None:
    d = re.sub(r"\D", "", value)
    if not luhn(d) or len(set(d)) == 1:
        return None
    body = d[0] + str(p.index(int(d[1:-1]), 10 ** (len(d) - 2), f"card/{len(d)}/{d[0]}")).zfill(len(d) - 2)
    return _refill(value, next(body + c for c in DIGITS if luhn(body + c)))


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(p: Permuter, value: str) -> str | None:
    s = value.replace(" ", "")
    if not 15 <= len(s) <= 34 or _mod97(s) != 1:
        return None
    body = p.characters(s[4:], "iban/" + s[:2])
    return _refill(value, f"{s[:2]}{98 - _mod97(s[:2] + '00' + body):02d}{body}")


def _phone(p: Permuter, value: str) -> str | None:
    d = re.sub(r"\D", "", value)
    national = d[-10:]
    if len(d) == 10 and value[0] != "+" or len(d) == 11 and d[0] == "1":
        if national[0] in "01" or national[3] in "01":
            if value[0] != "+":
                return None
            x = int(national)  # outside the plan but written as a phone number: stays outside
            while True:
                x = p.index(x, 10**10, "phone/1x")
                if f"{x:010d}"[0] in "01" or f"{x:010d}"[3] in "01":
                    return _refill(value, f"{d[:-10]}{x:010d}")
        x = ((int(national[:3]) - 200) * 800 + int(national[3:6]) - 200) * 10_000 + int(national[6:])
        x, line = divmod(p.index(x, 800 * 800 * 10_000, "phone/1"), 10_000)
        area, exchange = divmod(x, 800)
        return _refill(value, f"{d[:-10]}{area + 200}{exchange + 200}{line:04d}")
    if value[0] != "+" or not 8 <= len(d) <= 15:
        return None
    return _refill(value, d[:2] + str(p.index(int(d[2:]), 10 ** (len(d) - 2), f"phone/{d[:2]}/{len(d)}")).zfill(len(d) - 2))


def _ssn(p: Permuter, value: str) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(p.index(x, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


#: Private ranges as (first address, bits of the host part).
PRIVATE = [(10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16)]


def _public(x: int) -> bool:
    return not (x >> 24 in (0, 10, 127) or x >> 24 >= 224 or x >> 20 == 0xAC1 or x >> 16 in (0xC0A8, 0xA9FE))


def _ip(p: Permuter, value: str) -> str | None:
    octets = [int(o) for o in value.split(".")]
    if max(octets) > 255:
        return None
    x = int.from_bytes(bytes(octets), "big")
    base, bits = next(((b, n) for b, n in PRIVATE if x >> n == b >> n), (0, 32))
    if bits < 32:
        y = base + p.index(x - base, 1 << bits, f"ip/{base}")
    elif _public(x):
        y = p.index(x, 1 << 32, "ip")
        while not _public(y):
            y = p.index(y, 1 << 32, "ip")
    else:  # loopback, link-local, multicast and the like: within the first octet
        y = (x >> 24 << 24) + p.index(x & 0xFFFFFF, 1 << 24, f"ip/{x >> 24}")
    return ".".join(map(str, y.to_bytes(4, "big")))


def _date(p: Permuter, value: str) -> str | None:
    numbers = re.findall(r"\d+", value)
    n = list(map(int, numbers))
    name = re.search("[A-Z][a-z]+", value)
    if name:
        month = next(i for i, m in enumerate(MONTHS, 1) if m.startswith(name[0][:3]))
        y, m, d = n[1], month, n[0]
    elif "-" in value:
        y, m, d = n
    elif "." in value or n[0] > 12:
        d, m, y = n
    else:
        m, d, y = n
    try:
        first = date(1900 + (y - 1900) // 200 * 200, 1, 1)
        past = (date(y, m, d) - first).days
        span = (date(first.year + 199, 12, 31) - first).days + 1
    except ValueError:
        return None
    t = first + timedelta(p.index(past, span, f"date/{first.year}"))
    if "-" in value:
        return t.isoformat()
    if name:
        word = MONTHS[t.month - 1] if len(name[0]) > 3 or name[0] == "May" else MONTHS[t.month - 1][:3]
        day = f"{t.day:02d}" if numbers[0][0] == "0" else str(t.day)
        return f"{word} {day}, {t.year:04d}" if value[0].isalpha() else f"{day} {word} {t.year:04d}"
    pad = 2 if len(numbers[0]) == len(numbers[1]) == 2 else 1
    a, b, mark = (t.day, t.month, ".") if "." in value else (t.month, t.day, "/")
    return f"{a:0{pad}d}{mark}{b:0{pad}d}{mark}{t.year:04d}"


def _email(p: Permuter, value: str) -> str:
    local, _, domain = value.rpartition("@")
    return f"{p.characters(local, 'email/' + domain.lower())}@{domain}"


def _secret(p: Permuter, value: str) -> str:
    return "AKIA" + p.characters(value[4:], "akia") if value.startswith("AKIA") and len(value) == 20 else p.characters(value, "password")


KINDS = {"card": _card, "date": _date, "email": _email, "iban": _iban, "ip": _ip, "phone": _phone, "secret": _secret, "ssn": _ssn}


#: Length of a country's IBANs.
IBAN_LENGTH = {
    c: int(n)
    for n, cs in {
        "15": "NO", "16": "BE", "18": "DK FI FO GL NL SD", "19": "MK SI", "20": "AT BA EE KZ LT LU XK", "21": "CH HR LI LV", "22": "BG BH CR DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM TL SO",
        "24": "AD CZ ES MD PK RO SA SE SK TN VG", "25": "LY PT ST", "26": "IS TR", "27": "BI DJ FR GR IT MC MR SM", "28": "AL AZ BY CY DO GT HU LB NI PL SV", "29": "BR EG PS QA UA", "30": "JO KW MU", "31": "MT SC", "32": "LC", "33": "RU",
    }.items()
    for c in cs.split()
}


def _ends(kind: str, value: str) -> list[int]:
    """Where the value may end, likeliest first: what a pattern took may run on into the next word or number."""
    if kind not in ("card", "iban"):
        return [len(value)]
    ends = [len(value), *(m.start() for m in reversed(list(re.finditer(" ", value))))]
    n = [sum(map(str.isalnum, value[:e])) for e in ends]
    if kind == "card":
        usual = 15 if value[:2] in ("34", "37") else 16
        return [e for k, e in sorted(zip(n, ends), key=lambda x: x[0] != usual) if k >= 13]
    if usual := IBAN_LENGTH.get(value[:2]):
        return [e for k, e in zip(n, ends) if k == usual] + [len(value)] * (usual not in n[:1])
    return [e for k, e in zip(n, ends) if k >= 15]


_FIRST_GROUP = re.compile(r"[^A-Za-z0-9]*[A-Za-z0-9]*")


def pseudonymise(text: str | None, permuter: Permuter) -> tuple[str | None, Counter]:
    """The text with its values replaced, and how many of each kind."""
    found: Counter = Counter()
    if not text or not _HINT.search(text):
        return text, found

    out, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        kind, value = m.lastgroup, m[0]
        for end in _ends(kind, value):
            new = KINDS[kind](permuter, value[:end])
            if new is not None:
                found[kind] += 1
                out += [text[done : m.start()], new]
                done = at = m.start() + end
                break
        else:
            at = m.start() + _FIRST_GROUP.match(value).end()
    out.append(text[done:])
    return "".join(out), found


def pseudonyms(text: Column, key: bytes) -> Column:
    """struct<text string, kinds string, n int>: the text with pseudonyms, the kinds found (sorted, comma-joined), their number."""

    @F.pandas_udf("text string, kinds string, n int")
    def of(texts: pd.Series) -> pd.DataFrame:
        p = Permuter(key)
        done = [pseudonymise(t, p) for t in texts]
        release_memory()
        return pd.DataFrame({"text": pd.Series([t for t, _ in done], dtype=object), "kinds": [",".join(sorted(c)) for _, c in done], "n": [sum(c.values()) for _, c in done]})

    return of(text)
