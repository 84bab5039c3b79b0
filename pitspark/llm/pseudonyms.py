"""Personal data: format-preserving pseudonyms from a keyed Feistel network.

Values that pass their check (calendar dates, Luhn numbers, IBAN check digits, number
ranges of US social security numbers, octets, phone number lengths) are numbered within the
set of valid values of their format, permuted there and written back with the same punctuation.
The permutation is a balanced Feistel network over the smallest even number of bits that holds
the set, with HMAC-SHA-256 as round function, walked until the result lies in the set again;
check digits are computed anew. It is a bijection for each key and format, so equal values
stay equal in all documents, different ones stay different, and the key's owner can undo it. E-mail
addresses keep their shape: letters and digits of the local part are permuted, and the host name's labels
but for the last. Where the check digits of an IBAN or a card number fail, what follows or stands before may not belong to
it: shorter ends and later starts are tried, so undoing may take in digits behind a pseudonym that pass with it by chance. Credentials (cloud key ids, long hexadecimal strings, assigned passwords)
are permuted within their alphabet. Values of more than 64 signs are permuted in blocks of 64, each place by its own permutation,
so the work is linear in a value's length.

Texts are read whole, each in one task; nothing is shuffled.

Defined results: a null text stays null, an empty one empty; values that fail their check are left alone; equal rows
get equal results; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: signs of a long value that are permuted together
BLOCK = 64
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
_LETTERS, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
_MONTHS = ("january february march april may june july august september october november december").split()


class Feistel:
    """Keyed permutations of 0..size-1, one for each label and size."""

    def __init__(self, key: bytes):
        self.key = key
        self._memo = lru_cache(maxsize=100_000)(self._walk)

    def __reduce__(self):
        return Feistel, (self.key,)

    def permute(self, label: str, size: int, value: int) -> int:
        return self._memo(label, size, value, False)

    def invert(self, label: str, size: int, value: int) -> int:
        return self._memo(label, size, value, True)

    def _walk(self, label: str, size: int, value: int, back: bool) -> int:
        if size < 2:
            return value
        half = max(1, -(-(size - 1).bit_length() // 2))
        while True:
            value = self._once(label, half, value, back)
            if value < size:
                return value

    def _once(self, label: str, half: int, value: int, back: bool) -> int:
        mask = (1 << half) - 1
        left, right = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            side = left if back else right
            message = f"{label}|{half}|{i}|".encode() + side.to_bytes(-(-half // 8), "big")
            wide = b"".join(hmac.new(self.key, message + bytes([n]), hashlib.sha256).digest() for n in range(-(-half // 256)))
            noise = int.from_bytes(wide, "big") & mask
            if back:
                left, right = right ^ noise, left
            else:
                left, right = right, left ^ noise
        return left << half | right


def luhn_digit(body: str) -> str:
    """The check digit that completes ``body``."""
    total = sum((d := int(c) * (2 if i % 2 == 0 else 1)) - 9 * (d > 9) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _refill(pattern: str, symbols: str, wanted: Callable[[str], bool]) -> str:
    """``pattern`` with its wanted characters replaced, in order, by ``symbols``."""
    fresh = iter(symbols)
    return "".join(next(fresh) if wanted(c) else c for c in pattern)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _is_digit(c: str) -> bool:
    return c in _DIGITS


def _number(net: Callable, label: str, digits: str) -> str:
    return str(net(label, 10 ** len(digits), int(digits))).zfill(len(digits)) if digits else ""


def _card(net, m):
    digits = _digits(m.group())
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = digits[0] + _number(net, f"card{digits[0]}", digits[1:-1])
    return _refill(m.group(), body + luhn_digit(body), _is_digit)


def _long_number(net, m):
    """A run of 13 to 19 digits that is no valid card: permuted among the numbers that are none either."""
    digits = _digits(m.group())
    if luhn_digit(digits[:-1]) == digits[-1]:
        return None
    value = digits
    while True:
        value = digits[0] + _number(net, f"number{digits[0]}", value[1:])
        if luhn_digit(value[:-1]) != value[-1]:
            return _refill(m.group(), value, _is_digit)


def _iban(net, m):
    packed = m.group().replace(" ", "")
    country, check, body = packed[:2], packed[2:4], packed[4:]
    if not 15 <= len(packed) <= 34 or int("".join(str(int(c, 36)) for c in body + country + check)) % 97 != 1:
        return None
    fresh = _refill(body, _number(net, "iban", _digits(body)), _is_digit)
    fresh = country + f"{_iban_check(country, fresh):02d}" + fresh
    return _refill(m.group(), fresh, lambda c: c != " ")


def _valid_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(net, m):
    digits = _digits(m.group())
    if not _valid_ssn(digits):
        return None
    fresh = _number(net, "ssn", digits)
    while not _valid_ssn(fresh):
        fresh = _number(net, "ssn", fresh)
    return _refill(m.group(), fresh, _is_digit)


def _address(net, m):
    octets = [int(o) for o in m.group().split(".")]
    if max(octets) > 255:
        return None
    value = net("ipv4", 1 << 32, int.from_bytes(bytes(octets), "big"))
    return ".".join(map(str, value.to_bytes(4, "big")))


def _phone(net, m):
    text, prefix = m.group(), m.group("plus") or ""
    digits = _digits(text[len(prefix):])
    if not 7 <= len(digits) <= 14:
        return None
    return prefix + _refill(text[len(prefix):], _number(net, f"phone{_digits(prefix)}", digits), _is_digit)


def _shift_date(net, year: int, month: int, day: int, late: bool = False) -> date | None:
    """Another day of the calendar; with ``late`` one after the 12th, as the given day is."""
    try:
        ordinal = date(year, month, day).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= ordinal <= LAST_DAY:
        return None
    while True:
        ordinal = FIRST_DAY + net("date", LAST_DAY - FIRST_DAY + 1, ordinal - FIRST_DAY)
        if not late or date.fromordinal(ordinal).day > 12:
            return date.fromordinal(ordinal)


def _iso_date(net, m):
    y, a, mo, b, d = m.group("y", "a", "m", "b", "d")
    fresh = _shift_date(net, int(y), int(mo), int(d)) if a == b else None
    return fresh and f"{fresh.year:04d}{a}{fresh.month:02d}{b}{fresh.day:02d}"


def _numeric_date(net, m):
    """Day first after a point, else month first; the other way round where only that is a date, and then after the 12th again."""
    x, a, y, b, year = m.group("x", "a", "m", "b", "y")
    if a != b:
        return None
    width = 2 if len(x) == len(y) == 2 else 1
    for other_way in (False, True):
        day_first = (a == ".") != other_way
        day, month = (x, y) if day_first else (y, x)
        if fresh := _shift_date(net, int(year), int(month), int(day), late=other_way):
            one, two = (fresh.day, fresh.month) if day_first else (fresh.month, fresh.day)
            return f"{one:0{width}d}{a}{two:0{width}d}{b}{fresh.year:04d}"
    return None


def _named_date(net, m):
    word, day, year = (m.group(n) or m.group(n + "2") for n in ("month", "day", "year"))
    fresh = _shift_date(net, int(year), [n[:3] for n in _MONTHS].index(word[:3].lower()) + 1, int(day))
    if not fresh:
        return None
    name = _MONTHS[fresh.month - 1]
    name = name[:3] if len(word) == 3 and word.lower() != "may" else name
    name = name.capitalize() if word[0].isupper() else name
    return f"{name} {fresh.day}, {fresh.year}" if m.group("month") else f"{fresh.day} {name} {fresh.year}"


def _blocks(text: str) -> list[str]:
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)] or [""]


def _spelled(net, label: str, text: str) -> str:
    """Letters stay letters of their case and digits digits; equal shapes are permuted among each other, block by block."""
    return "".join(_spelled_block(net, f"{label}{i or ''}", part) for i, part in enumerate(_blocks(text)))


def _spelled_block(net, label: str, text: str) -> str:
    shape = "".join("9" if c in _DIGITS else "a" if c in _LETTERS else "A" if c.lower() in _LETTERS else c for c in text)
    size, value = 1, 0
    for c in text:
        if c.lower() in _LETTERS or c in _DIGITS:
            base = 10 if c in _DIGITS else 26
            value = value * base + (int(c) if c in _DIGITS else _LETTERS.index(c.lower()))
            size *= base
    value = net(f"{label}|{shape}", size, value)
    out = []
    for c in reversed(shape):
        if c in "9aA":
            value, digit = divmod(value, 10 if c == "9" else 26)
            out.append(_DIGITS[digit] if c == "9" else _LETTERS[digit] if c == "a" else _LETTERS[digit].upper())
        else:
            out.append(c)
    return "".join(reversed(out))


def _email(net, m):
    local, host = m.group().rsplit("@", 1)
    labels = host.split(".")
    return _spelled(net, "local", local) + "@" + ".".join([*(_spelled(net, "host", x) for x in labels[:-1]), labels[-1]])


def _hex(net, m):
    text = m.group()
    if not any(c in _DIGITS for c in text) or not any(c not in _DIGITS for c in text):
        return None
    fresh = "".join(f"{net(f'hex{len(text)}|{i}', 16 ** len(part), int(part, 16)):0{len(part)}x}" for i, part in enumerate(_blocks(text)))
    return fresh.upper() if text.isupper() else fresh


def _credential(net, m):
    return m.group("name") + _spelled(net, "secret", m.group("value"))


#: kind -> (pattern, what to write instead, or None if the value fails its check); earlier kinds win.
KINDS: dict[str, tuple[str, Callable]] = {
    "email": (r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", _email),
    "credential": (r"(?P<name>\b(?:AKIA|ASIA|ghp_|sk-|xox[bp]-|(?i:password|passwd|secret|token|api[_-]?key)\s?[=:]\s?[\"']?))(?P<value>[A-Za-z0-9_\-]{6,})", _credential),
    "hex": (r"\b(?:[0-9a-f]{24,}|[0-9A-F]{24,})\b", _hex),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b", _iban),
    "iso_date": (r"(?<![\d\-])(?P<y>(?:19|20)\d\d)(?P<a>[\-/.])(?P<m>\d\d)(?P<b>[\-/.])(?P<d>\d\d)(?![\d\-])", _iso_date),
    "date": (r"(?<![\d.\-/])(?P<x>\d{1,2})(?P<a>[\-/.])(?P<m>\d{1,2})(?P<b>[\-/.])(?P<y>(?:19|20)\d\d)(?![\d\-/])", _numeric_date),
    "named_date": (r"(?i)\b(?:(?P<month>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)"
                   r" (?P<day>\d{1,2}), (?P<year>(?:19|20)\d\d)|(?P<day2>\d{1,2}) (?P<month2>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|june|july"
                   r"|august|september|october|november|december) (?P<year2>(?:19|20)\d\d))\b", _named_date),
    "address": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _address),
    "ssn": (r"(?<![\d\-])\d{3}[\- ]\d{2}[\- ]\d{4}(?![\d\-])", _ssn),
    "card": (r"(?<![\d+\-])\d(?:[ \-]?\d){12,18}(?![\d\-])", _card),
    "number": (r"(?<![\d+\-])\d{13,19}(?![\d\-])", _long_number),
    "phone": (r"(?<![\w+(])(?:(?P<plus>\+\d{1,3}[ .\-]?))?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]?\d{3,4}(?![\w])", _phone),
    "international": (r"(?<![\w+])(?P<plus>\+)\d(?:[ .\-()]{0,2}\d){6,13}(?!\w)", _phone),
}
#: Kinds with check digits whose pattern may reach too far: the characters at which a value may end earlier.
GAPS = {"iban": " ", "card": " -"}
#: Characters of an IBAN, by country.
IBAN_LENGTH = {country: length for length, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
_PATTERNS = [(kind, re.compile(pattern), write) for kind, (pattern, write) in KINDS.items()]
_NEED = re.compile(r"[0-9@]|(?i:password|passwd|secret|token|api[_-]?key)\s?[=:]")


def _readings(kind: str, pattern: re.Pattern, text: str, m: re.Match) -> list[re.Match]:
    """The match, and for kinds with check digits all values that begin within it, with every end at a gap: IBANs of their country's
    length first, then those with most characters, then the first."""
    if kind not in GAPS:
        return [m]
    found, longest = [], m
    while longest and longest.start() < m.end():
        ends = [i for i in range(longest.end() - 1, longest.start(), -1) if text[i] in GAPS[kind]]
        found += [longest, *(x for i in ends if (x := pattern.match(text, longest.start(), i)) and x.end() == i)]
        longest = pattern.search(text, longest.start() + 1)

    def rank(x: re.Match):
        size = sum(c not in GAPS[kind] for c in x.group())
        return kind == "iban" and IBAN_LENGTH.get(x.group()[:2]) != size, -size, x.start()

    return sorted(found, key=rank)


def find(text: str) -> list[tuple[int, int, str, re.Match, Callable]]:
    """Spans of personal data that do not overlap, in order; earlier kinds win."""
    if not _NEED.search(text):
        return []
    found: list[tuple] = []
    taken = bytearray(len(text))
    for kind, pattern, write in _PATTERNS:
        at = 0
        while m := pattern.search(text, at):
            for x in _readings(kind, pattern, text, m):
                if taken.find(1, x.start(), x.end()) < 0 and write(lambda _l, _s, v: v, x) is not None:
                    found.append((x.start(), x.end(), kind, x, write))
                    taken[x.start():x.end()] = b"\1" * (x.end() - x.start())
                    at = x.end() if x.start() == m.start() else m.start()  # what stands before it may hold another
                    break
            else:
                at = m.start() + 1
    return sorted(found, key=lambda s: s[0])


def rewrite(text: str, net: Callable) -> tuple[str, list[str]]:
    """``text`` with each value replaced, and the kinds found."""
    out, at, kinds = [], 0, []
    for start, end, kind, m, write in find(text):
        out += [text[at:start], write(net, m)]
        kinds.append(kind)
        at = end
    return "".join(out) + text[at:], kinds


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text with pseudonyms, n_replaced, kinds."""
    feistel = Feistel(key)
    schema = "doc_id long, text string, n_replaced long, kinds array<string>"

    def run(batches):
        for batch in batches:
            texts, kinds = [], []
            for text in batch.column("text").to_pylist():
                fresh, found = rewrite(text, feistel.permute) if text else (text, [])
                texts.append(fresh)
                kinds.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(k) for k in kinds], pa.int64()),
                                              pa.array(kinds, pa.list_(pa.string()))], ["doc_id", "text", "n_replaced", "kinds"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, schema)
