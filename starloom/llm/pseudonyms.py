"""Format-preserving pseudonyms for personal data: validated numbers and dates are permuted under a key.

A value is found by its shape, validated (check digits, calendar, ranges), brought to its plain form, and replaced by
another valid value of the same kind through a keyed Feistel network.  The network is a permutation of the kind's values,
so equal values get equal pseudonyms in all documents, different ones stay different, and whoever has the key can go back.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.text import slices

ROUNDS = 8
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of ``range(left * right)``: halves are added to in turn by a hash of the other one."""

    key: bytes

    def _round(self, label: str, number: int, half: int, size: int) -> int:
        data = f"{label}/{number}/{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=16).digest(), "big") % size

    def permute(self, label: str, value: int, left: int, right: int, back: bool = False) -> int:
        a, b = divmod(value, right)
        sign = -1 if back else 1
        for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if number % 2:
                b = (b + sign * self._round(label, number, a, right)) % right
            else:
                a = (a + sign * self._round(label, number, b, left)) % left
        return a * right + b

    def within(self, label: str, value: int, size: int, back: bool = False) -> int:
        """A permutation of ``range(size)``: steps outside it are walked on, so that it is one."""
        left = int(size**0.5) or 1
        while left * left < size:
            left += 1
        value = self.permute(label, value, left, left, back)
        while value >= size:
            value = self.permute(label, value, left, left, back)
        return value

    def characters(self, label: str, text: str, alphabets: list[str], back: bool = False) -> str:
        """A permutation of the texts whose characters come from the given alphabets."""
        half = len(text) // 2
        sizes = [len(a) for a in alphabets]
        value = left = right = 0
        left = right = 1
        for i, c in enumerate(text):
            value = value * sizes[i] + alphabets[i].index(c)
            if i < half:
                left *= sizes[i]
            else:
                right *= sizes[i]
        value = self.permute(label, value, left, right, back)
        out = []
        for size, alphabet in zip(reversed(sizes), reversed(alphabets)):
            value, place = divmod(value, size)
            out.append(alphabet[place])
        return "".join(reversed(out))


def luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total


def _fill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c in DIGITS else c for c in shape)


def _plain(shape: str) -> str:
    return "".join(c for c in shape if c in DIGITS)


def card(f: Feistel, found: str, back: bool = False) -> str | None:
    """13 to 19 digits with a right check digit; the first digit, which tells the network, stays."""
    digits = _plain(found)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    body = digits[0] + f.characters(f"card{len(digits)}{digits[0]}", digits[1:-1], [DIGITS] * (len(digits) - 2), back)
    return _fill(found, body + str(-_luhn_sum(body + "0") % 10))


def _american(digits: str) -> str:
    """The ten digits of a North American number, whose area and exchange start with 2 to 9."""
    ten = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits if len(digits) == 10 else ""
    return ten if ten and ten[0] >= "2" and ten[3] >= "2" else ""


def phone(f: Feistel, found: str, back: bool = False) -> str | None:
    """A North American number, or 8 to 15 digits behind a plus, of which the first stays."""
    digits = _plain(found)
    american = _american(digits) if found[0] != "+" or digits[0] == "1" else ""
    if american:
        alphabets = [DIGITS[2:], DIGITS, DIGITS, DIGITS[2:], *[DIGITS] * 6]
        return _fill(found, digits[: len(digits) - 10] + f.characters("phone1", american, alphabets, back))
    if found[0] != "+" or not 8 <= len(digits) <= 15 or digits[0] == "0":
        return None
    rest = digits[1:]
    while True:  # what is no North American number stays none, so both kinds are permuted for themselves
        rest = f.characters(f"phone+{digits[0]}", rest, [DIGITS] * len(rest), back)
        if digits[0] != "1" or not _american("1" + rest):
            return _fill(found, digits[0] + rest)


def social(f: Feistel, found: str, back: bool = False) -> str | None:
    """AAA-GG-SSSS with none of the numbers that are never given out."""
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    digits = _plain(found)
    if not valid(digits):
        return None
    digits = f.characters("social", digits, [DIGITS] * 9, back)
    while not valid(digits):
        digits = f.characters("social", digits, [DIGITS] * 9, back)
    return _fill(found, digits)


def address(f: Feistel, found: str, back: bool = False) -> str | None:
    """An IPv4 address; none with a zero in front of another digit."""
    parts = found.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = 0
    for p in parts:
        value = value * 256 + int(p)
    value = f.permute("address", value, 65536, 65536, back)
    return ".".join(str(value >> shift & 255) for shift in (24, 16, 8, 0))


FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def date(f: Feistel, found: str, back: bool = False) -> str | None:
    """A day of 1900 to 2099 as year-month-day, or with the year last as day.month or month/day (day/month if only that is valid)."""
    mark = re.search(r"[-./]", found).group()
    parts = found.split(mark)
    if len(parts[0]) == 4:
        order = (0, 1, 2)
    elif mark == "/" and int(parts[0]) <= 12:
        order = (2, 0, 1)
    else:
        order = (2, 1, 0)
    year, month, day = (int(parts[i]) for i in order)
    if not (1900 <= year < 2100 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
        return None
    # A date written month first stays one; one written day first is kept in those that can only be read so.
    label, early = ("date", False) if order != (2, 1, 0) or mark != "/" else ("late", True)
    value = datetime.date(year, month, day).toordinal() - FIRST_DAY
    while True:
        value = f.within(label, value, DAYS, back)
        new = datetime.date.fromordinal(FIRST_DAY + value)
        if not early or new.day > 12:
            break
    fields = dict(zip(order, (f"{new.year:04d}", new.month, new.day)))
    wide = all(len(parts[i]) == 2 for i in order[1:]) or len(parts[0]) == 4
    return mark.join(x if isinstance(x, str) else f"{x:02d}" if wide else str(x) for x in (fields[i] for i in range(3)))


def account(f: Feistel, found: str, back: bool = False) -> str | None:
    """An IBAN with right check digits; country and kinds of characters stay."""
    plain = found.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    alphabets = [DIGITS if c in DIGITS else LOWER.upper() for c in plain[4:]]
    body = f.characters(f"account{plain[:2]}", plain[4:], alphabets, back)
    plain = f"{plain[:2]}{98 - _mod97(body + plain[:2] + '00'):02d}{body}"
    left = iter(plain)
    return "".join(c if c == " " else next(left) for c in found)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def mail(f: Feistel, found: str, back: bool = False) -> str | None:
    """An address of letters, digits and ``._%+-`` at a domain; letters and digits before the at sign are permuted."""
    name, _, domain = found.partition("@")
    at = [i for i, c in enumerate(name) if c.isalnum()]
    if not at:
        return None
    alphabets = [DIGITS if name[i] in DIGITS else LOWER if name[i] in LOWER else LOWER.upper() for i in at]
    mask = "".join("9" if c in DIGITS else "a" if c in LOWER else "A" if c.isalnum() else c for c in name)
    new = iter(f.characters(f"mail{mask}", "".join(name[i] for i in at), alphabets, back))
    return "".join(next(new) if c.isalnum() else c for c in name) + "@" + domain


def token(f: Feistel, found: str, back: bool = False) -> str | None:
    """32 to 64 hexadecimal digits, with letters of one case and decimal digits among them."""
    letters = {c for c in found if c not in DIGITS}
    if not letters or len(letters) == len(set(found)) or not (letters <= set("abcdef") or letters <= set("ABCDEF")):
        return None
    hexes = DIGITS + ("abcdef" if letters <= set("abcdef") else "ABCDEF")
    return f.characters(f"token{len(found)}{hexes[-1]}", found, [hexes] * len(found), back)


# In order of precedence; a shape that fails its validation is tried as the next ones.
KINDS: list[tuple[str, str, Callable[..., str | None]]] = [
    ("mail", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])", mail),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", account),
    ("token", r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,64}(?![A-Za-z0-9])", token),
    ("card", r"(?<![A-Za-z0-9.])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])", card),
    ("address", r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])", address),
    ("social", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])", social),
    ("date", r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
             r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9]|[./-][0-9])", date),
    ("phone", r"(?<![A-Za-z0-9.+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
              r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![A-Za-z0-9]|[.-][0-9])", phone),
]
_SHAPES = [(kind, re.compile(shape, re.ASCII), change) for kind, shape, change in KINDS]


def spans_of(text: str, f: Feistel, back: bool = False) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and pseudonym of each value in a text, in order; they do not overlap."""
    taken: list[tuple[int, int, str, str]] = []
    covered = bytearray(len(text))
    has_mail = "@" in text
    for kind, shape, change in _SHAPES:
        if kind == "mail" and not has_mail:
            continue
        for m in shape.finditer(text):
            if 1 in covered[m.start() : m.end()]:
                continue
            new = change(f, m.group(), back)
            if new is not None:
                covered[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
                taken.append((m.start(), m.end(), kind, new))
    return sorted(taken)


def replaced(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for start, end, _, new in spans:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


SPAN = "STRUCT<start: INT, end: INT, kind: STRING, pseudonym: STRING>"


def pseudonymised(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """``doc_id, n_values, text, spans``, one row per row of ``docs``; ``back`` undoes it under the same key.

    Spans are in code points of the given text.  A null text stays null with no values.  Ids and other columns are not
    changed or read.  The longest texts are scanned whole.
    """
    f = Feistel(hashlib.blake2b(key, digest_size=32).digest())
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pseudonym", pa.string())])

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            column = piece.column("text")
            # Every kind but the mail address has two digits in a row or parted by one character.
            maybe = pc.match_substring_regex(pc.fill_null(column, ""), "@|[0-9].?[0-9]")
            at = np.flatnonzero(maybe.to_numpy(zero_copy_only=False))
            found: list[list] = [[] for _ in range(piece.num_rows)]
            texts = {}
            for i, text in zip(at.tolist(), column.take(pa.array(at)).to_pylist()):
                spans = spans_of(text, f, back)
                if spans:
                    found[i] = [dict(zip(("start", "end", "kind", "pseudonym"), s)) for s in spans]
                    texts[i] = replaced(text, spans)
            if texts:
                mask = np.zeros(piece.num_rows, bool)
                mask[list(texts)] = True
                column = pc.replace_with_mask(column, pa.array(mask), pa.array([texts[i] for i in sorted(texts)], column.type))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([len(x) for x in found], pa.int32()), column, pa.array(found, pa.list_(span))],
                ["doc_id", "n_values", "text", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(change, f"doc_id BIGINT, n_values INT, text STRING, spans ARRAY<{SPAN}>")


# A key for the query only; a job passes its own, from its secret store.
QUERY_KEY = b"a key that is no secret"


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced."""
    return pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_KEY)
