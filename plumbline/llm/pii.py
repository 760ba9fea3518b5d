"""Format-preserving pseudonyms for personal data.

Values are found by pattern and kept only if they validate: cards by Luhn, IBANs by their check number, addresses by their
octets, dates by the calendar, phone numbers by their digit count.  Each is permuted by a keyed Feistel network over exactly the values of
its format (numbers beyond the format are walked on), then written back in the same format with valid check digits.
The permutation has no state, so equal values get equal pseudonyms in every document and task, and with the key
it can be undone.  The same number in another layout of the same kind stays linked as well, and so do dates in layouts of two-digit
days and months with the year or the day first; month-first dates and those with one-digit days or months are permuted within the days
that their layout can hold, each for itself.

Kinds: email (letters and digits of all but the top-level label), phone (the last ten digits; separators and country code stay),
card, iban (digits and letters after the country), ssn, ip, date (years 1000 to 2999; layout and one of three ranges of years kept; month
first only where the second number is above 12), secret (access keys, hexadecimal tokens of 32 characters or more in either case,
values of six characters or more after "password", "passwd" or "pwd" and "=" or ":").

Cases: a null text stays null; texts without personal data are unchanged, byte for byte; long texts are read whole;
repeated rows and null ids are handled alike; an empty table gives no rows; other columns pass through unchanged, and the
added columns take the names of COUNTS, replacing columns of that name.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import slices, table

KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date", "secret")
COUNTS = [f"n_{k}" for k in KINDS]
#: For tests and demonstrations; a job passes its own.
DEMO_KEY = b"plumbline demonstration key"
ROUNDS = 8

_PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-]))
    |(?P<secret>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9]))
    |(?<![A-Za-z0-9])(?i:password|passwd|pwd)["']?[ ]?[=:][ ]?["']?(?P<password>[^\s"'<>]{6,})
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w))
    |(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w/-]|\.\d))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d))
    |(?P<phone>(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-])|(?<![\w.+-])(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]))
    """,
    re.ASCII | re.VERBOSE,
)
#: A text without any of these holds nothing to find.
_HINT = re.compile(r"@|\d[\d .()/+-]{3}|[0-9a-fA-F]{32}|A[KS]IA|(?i:passw|pwd)", re.ASCII)
#: Ranges of years; a date stays in its own.
_ERAS = ((1900, 2099), (1000, 1899), (2100, 2999))
#: Characters of a long value that are permuted at once.
_RUN = 128
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEXES = ("0123456789abcdef", "0123456789ABCDEF")


class Feistel:
    """Keyed permutation of 0..n-1 for any n and context: a balanced network with cycle walking."""

    def __init__(self, key: bytes) -> None:
        self.key = key[:64]

    def _half(self, context: bytes, turn: int, value: int, half: int) -> int:
        size = (half + 7) // 8
        out, block = b"", 0
        while len(out) < size:
            data = context + bytes([turn]) + block.to_bytes(4, "big") + value.to_bytes(size, "big")
            out += hashlib.blake2b(data, key=self.key, digest_size=min(64, max(8, size))).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << half) - 1)

    def _walk(self, x: int, n: int, context: bytes, turns: list[int], back: bool) -> int:
        half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        context = context + b"|" + n.to_bytes((n.bit_length() + 7) // 8, "big")
        while True:
            a, b = x >> half, x & mask
            for t in turns:
                if back:
                    a, b = b ^ self._half(context, t, a, half), a
                else:
                    a, b = b, a ^ self._half(context, t, b, half)
            x = a << half | b
            if x < n:
                return x

    def permute(self, x: int, n: int, context: bytes) -> int:
        return self._walk(x, n, context, list(range(ROUNDS)), False) if n > 1 else x

    def restore(self, x: int, n: int, context: bytes) -> int:
        return self._walk(x, n, context, list(range(ROUNDS))[::-1], True) if n > 1 else x


def luhn(digits: str) -> int:
    """The digit that completes ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


Step = Callable[[int, int, bytes], int]


def _spelled(text: str, step: Step, context: bytes, alphabet: str = "") -> str:
    """Permute the letters and digits of a text within their classes (or all within ``alphabet``); all else stays in place.

    A long text is permuted run by run, each under its number.
    """
    if len(text) > _RUN:
        runs = range(0, len(text), _RUN)
        return "".join(_spelled(text[k : k + _RUN], step, context + b"|%d of %d" % (k, len(text)), alphabet) for k in runs)
    sets = [alphabet if c in alphabet else next((s for s in (_DIGITS, _UPPER, _LOWER) if c in s), "") for c in text]
    shape = "".join("#" if s and s == alphabet else s[:1] or c for s, c in zip(sets, text, strict=True))
    value, n = 0, 1
    for s, c in zip(sets, text, strict=True):
        if s:
            value, n = value * len(s) + s.index(c), n * len(s)
    value = step(value, n, context + b"|" + shape.encode())
    out = []
    for s, c in zip(reversed(sets), reversed(text), strict=True):
        if s:
            value, k = divmod(value, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out))


def _digits(value: str, step: Step, context: bytes) -> str:
    return str(step(int(value), 10 ** len(value), context)).zfill(len(value))


def _refilled(layout: str, symbols: str) -> str:
    """``layout`` with its letters and digits replaced in order."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in layout)


def _email(v: str, step: Step) -> str | None:
    head, _, top = v.rpartition(".")
    return _spelled(head, step, b"email") + "." + top


def _phone(v: str, step: Step) -> str | None:
    d = "".join(c for c in v if c.isdigit())
    if not 7 <= len(d) <= 15:
        return None
    keep = max(0, len(d) - 10)
    if v[0] == "+" and not keep:
        keep = min(2, len(d) - 6)
    return _refilled(v, d[:keep] + _digits(d[keep:], step, b"phone"))


def _card(v: str, step: Step) -> str | None:
    d = "".join(c for c in v if c.isdigit())
    if luhn(d[:-1]) != int(d[-1]) or not any(c != "0" for c in d):
        return None
    body = _digits(d[:-1], step, b"card")
    return _refilled(v, body + str(luhn(body)))


def _iban(v: str, step: Step) -> str | None:
    s = v.replace(" ", "")
    if not 15 <= len(s) <= 34 or iban_check(s[:2], s[4:]) != int(s[2:4]):
        return None
    body = _spelled(s[4:], step, b"iban")
    return _refilled(v, s[:2] + f"{iban_check(s[:2], body):02d}" + body)


def _ssn(v: str, step: Step) -> str | None:
    area, group, serial = (int(x) for x in v.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = (area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
    place, serial = divmod(step(place, 898 * 99 * 9999, b"ssn"), 9999)
    area, group = divmod(place, 99)
    return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(v: str, step: Step) -> str | None:
    parts = v.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = step(int.from_bytes(bytes(int(p) for p in parts), "big"), 1 << 32, b"ip")
    return ".".join(str(b) for b in x.to_bytes(4, "big"))


@lru_cache(maxsize=None)
def _days(era: tuple[int, int], one_digit_day: bool | None, one_digit_month: bool | None, late: bool) -> array:
    """Ordinals of the days that a layout can hold, in order.  None: either; ``late``: only days after the twelfth."""
    first, last = datetime.date(era[0], 1, 1).toordinal(), datetime.date(era[1], 12, 31).toordinal()
    fits = lambda d: (not one_digit_day or d.day < 10) and (not one_digit_month or d.month < 10) and (not late or d.day > 12)
    return array("i", (k for k in range(first, last + 1) if fits(datetime.date.fromordinal(k))))


def _date(v: str, step: Step) -> str | None:
    mark = next(c for c in v if not c.isdigit())
    p = v.split(mark)
    year_first = len(p[0]) == 4
    y, m, d = (p[0], p[1], p[2]) if year_first else (p[2], p[1], p[0])
    month_first = not year_first and int(m) > 12 >= int(d)
    if month_first:
        m, d = d, m
    try:
        day = datetime.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    era = next((e for e in _ERAS if e[0] <= int(y) <= e[1]), None)
    if era is None:
        return None
    days = _days(era, len(d) == 1, len(m) == 1, month_first)
    context = b"date" if len(d) == len(m) == 2 and not month_first else b"date|%d %d %d" % (len(d), len(m), month_first)
    new = datetime.date.fromordinal(days[step(bisect_left(days, day), len(days), context)])
    new_d, new_m = str(new.day).zfill(len(d)), str(new.month).zfill(len(m))
    if year_first:
        return f"{new.year}{mark}{new_m}{mark}{new_d}"
    return f"{new_m if month_first else new_d}{mark}{new_d if month_first else new_m}{mark}{new.year}"


def _secret(v: str, step: Step) -> str | None:
    if v[:4] in ("AKIA", "ASIA") and len(v) == 20:
        return v[:4] + _spelled(v[4:], step, b"secret")
    return _spelled(v, step, b"secret", next((x for x in _HEXES if len(v) >= 32 and all(c in x for c in v)), ""))


_RULES = {"email": _email, "phone": _phone, "card": _card, "iban": _iban, "ssn": _ssn, "ip": _ip, "date": _date, "secret": _secret, "password": _secret}


def pseudonymised(text: str, cipher: Feistel, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its personal data replaced (or restored), and how many values of each kind."""
    found: dict[str, int] = {}
    if not _HINT.search(text):
        return text, found
    step = cipher.restore if back else cipher.permute

    def swap(m: re.Match) -> str:
        kind = m.lastgroup
        new = _RULES[kind](m.group(kind), step)
        if new is None:
            return m.group()
        name = "secret" if kind == "password" else kind
        found[name] = found.get(name, 0) + 1
        return m.group()[: m.start(kind) - m.start()] + new

    return _PATTERN.sub(swap, text), found


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and one count column for each kind."""
    rows = docs.drop(*COUNTS)
    names = rows.columns
    at = names.index("text")
    # plain names on the way, whatever the table's columns are called
    plain = rows.toDF(*[f"c{k}" for k in range(len(names))])
    plain = plain.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    schema = StructType([StructField(f.name, f.dataType) for f in plain.schema] + [StructField(c, LongType()) for c in COUNTS])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Feistel(key)
        for part in slices(batches, f"c{at}"):
            texts, counts = [], [[] for _ in KINDS]
            for t in part.column(at).to_pylist():
                new, found = pseudonymised(t, cipher) if t is not None else (None, {})
                texts.append(new)
                for k, c in zip(KINDS, counts, strict=True):
                    c.append(found.get(k, 0))
            columns = [pa.array(texts, part.schema.field(at).type) if k == at else part.column(k) for k in range(part.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in counts)], [*part.schema.names, *COUNTS])

    return plain.mapInArrow(step, schema).toDF(*names, *COUNTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
