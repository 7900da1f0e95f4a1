"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

Every find is validated, turned into digits of a mixed radix, permuted by an
alternating Feistel network keyed with BLAKE2b, and written back in its own
format.  Equal values get equal pseudonyms in every document, different values
different ones, and the key's holder can invert them (``restore``).

What is found, how it is validated, and what stays:

* e-mail addresses: letters and digits are permuted; punctuation, case and the last label stay
* dates (y-m-d, d.m.y, d/m/y, m/d/y; real days of 1900 to 2099): permuted among those
  days, so one day written in two formats gets one pseudonym; m/d/y is read only where
  d/m/y isn't a day, and permuted among such days; dates without leading zeros stay so,
  but ``restore`` may give a zero back where both fields of the pseudonym have two digits
* IBAN (length, mod 97): country stays, check digits are made valid again
* card numbers (13 to 19 digits, Luhn): the last digit is made valid again
  where further groups of digits follow a card after a blank or hyphen, and all together
  aren't a card, the longest leading card is taken and the rest read on its own
* account numbers (13 to 19 digits without a valid Luhn digit or leading card): all digits
* US social security numbers (no reserved group): stay unreserved
* telephone numbers (leading ``+``, 8 to 15 digits): the country code's first digit stays
* IPv4 addresses (four octets up to 255)
* quoted or assigned hexadecimal secrets of 24 digits or more

Defined cases: a null text stays null with no finds; empty texts stay empty;
finds never overlap (leftmost, then in the order above); whole texts are read;
other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import fresh, with_fields

ROUNDS = 10
FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), 73049

FINDERS = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]{0,62}[A-Za-z0-9_])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![\w@-])"),
    ("date", r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\w/-]|\.\d)"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w+])\+\d(?:[ .()-]{0,2}\d){7,14}(?!\w)"),
    ("number", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"),
    ("secret", r"(?<![A-Za-z0-9])[0-9a-f]{24,128}(?![A-Za-z0-9])"),
]
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in FINDERS), re.A)
_MAYBE = re.compile(r"[0-9@]")


class Feistel:
    """A keyed permutation of digit strings over given radices."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mask(self, kind: str, step: int, half: int, size: int) -> int:
        said = f"{kind}|{step}|{size}|{half}".encode()
        wide = (size.bit_length() + 7) // 8 + 8
        out, n = b"", 0
        while len(out) < wide:
            out += hashlib.blake2b(said, key=self.key, salt=n.to_bytes(8, "big")).digest()
            n += 1
        return int.from_bytes(out[:wide], "big") % size

    def permute(self, kind: str, digits: list[int], radices: list[int], back: bool = False) -> list[int]:
        """The digits' image; with ``back``, their preimage."""
        if len(digits) == 1:
            shift = self._mask(kind, 0, 0, radices[0])
            return [(digits[0] + (-shift if back else shift)) % radices[0]]
        cut = len(digits) // 2
        sides = [_number(digits[:cut], radices[:cut]), _number(digits[cut:], radices[cut:])]
        sizes = [_product(radices[:cut]), _product(radices[cut:])]
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            a = step % 2
            mask = self._mask(kind, step, sides[1 - a], sizes[a])
            sides[a] = (sides[a] + (-mask if back else mask)) % sizes[a]
        return _digits(sides[0], radices[:cut]) + _digits(sides[1], radices[cut:])

    def within(self, kind: str, value: int, size: int, back: bool = False) -> int:
        """A permutation of 0..size-1: walks the cycle until inside again."""
        bits = max(2, (size - 1).bit_length())
        radices = [1 << (bits // 2), 1 << (bits - bits // 2)]
        while True:
            value = _number(self.permute(kind, _digits(value, radices), radices, back), radices)
            if value < size:
                return value


def _product(radices: list[int]) -> int:
    n = 1
    for r in radices:
        n *= r
    return n


def _number(digits: list[int], radices: list[int]) -> int:
    n = 0
    for d, r in zip(digits, radices, strict=True):
        n = n * r + d
    return n


def _digits(n: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        n, d = divmod(n, r)
        out.append(d)
    return out[::-1]


def luhn_digit(body: str) -> int:
    """The check digit that makes ``body`` valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _refill(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced one by one."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _by_class(f: Feistel, kind: str, said: str, back: bool) -> str:
    """Permutes digits among digits and letters among letters; case stays."""
    digits, radices, at = [], [], []
    for i, c in enumerate(said):
        if c.isascii() and c.isalnum():
            digits.append(int(c) if c.isdigit() else ord(c.lower()) - 97)
            radices.append(10 if c.isdigit() else 26)
            at.append(i)
    out = list(said)
    for i, d in zip(at, f.permute(kind, digits, radices, back), strict=True):
        c = said[i]
        out[i] = str(d) if c.isdigit() else chr((65 if c.isupper() else 97) + d)
    return "".join(out)


def _numeric(f: Feistel, kind: str, digits: str, back: bool) -> str:
    return "".join(map(str, f.permute(kind, [int(c) for c in digits], [10] * len(digits), back)))


def _email(f, said, back):
    head, _, top = said.rpartition(".")
    name, _, host = head.partition("@")
    return f"{_by_class(f, 'email-name', name, back)}@{_by_class(f, 'email-host', host, back)}.{top}"


def _date(f, said, back):
    sign = next(c for c in said if not c.isdigit())
    parts = said.split(sign)
    orders = ["ymd"] if len(parts[0]) == 4 else ["dmy", "mdy"] if sign != "." else ["dmy"]
    for order in orders:
        got = dict(zip(order, map(int, parts), strict=True))
        try:
            n = date(got["y"], got["m"], got["d"]).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if not 0 <= n < DAYS:
            return None
        while True:
            n = f.within(order if order == "mdy" else "date", n, DAYS, back)
            new = date.fromordinal(FIRST_DAY + n)
            if order != "mdy" or new.day > 12:  # else it would read as d/m/y
                break
        pad = "02" if min(map(len, parts)) > 1 else "d"
        values = {"y": f"{new.year:04}", "m": f"{new.month:{pad}}", "d": f"{new.day:{pad}}"}
        return sign.join(values[k] for k in order)
    return None


def _iban(f, said, back):
    flat = said.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _mod97(flat) != 1:
        return None
    new = flat[:2] + "00" + _by_class(f, "iban", flat[4:], back)
    return _refill(said, new[:2] + f"{98 - _mod97(new):02}" + new[4:])


def _ssn(f, said, back):
    area, group, serial = map(int, said.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    n = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    n = f.within("ssn", n, len(areas) * 99 * 9999, back)
    n, serial = divmod(n, 9999)
    area, group = divmod(n, 99)
    return f"{areas[area]:03}-{group + 1:02}-{serial + 1:04}"


def _phone(f, said, back):
    flat = re.sub(r"\D", "", said)
    return _refill(said, flat[0] + _numeric(f, "phone", flat[1:], back))


def _card_end(said: str) -> int:
    """Where the longest leading card ends: at a separator or the end; 0 if there is none."""
    for end in [len(said), *(i for i in reversed(range(len(said))) if not said[i].isdigit())]:
        flat = re.sub(r"\D", "", said[:end])
        if len(flat) > 12 and luhn_digit(flat[:-1]) == int(flat[-1]):
            return end
    return 0


def _card(f, said, back):
    """The pseudonym of a number, or of the card that leads it.

    Cycles go on to the next value that reads the same way, so that it can be restored.
    """
    end = _card_end(said)
    head, rest = (said[:end], said[end:]) if end else (said, "")
    flat = re.sub(r"\D", "", head)
    while True:
        if end:
            body = _numeric(f, "card", flat[:-1], back)
            flat = body + str(luhn_digit(body))
        else:
            flat = _numeric(f, "account", flat, back)
        new = _refill(head, flat)
        if _card_end(new + rest) == end:
            return new


def _ip(f, said, back):
    octets = [int(x) for x in said.split(".")]
    if max(octets) > 255:
        return None
    return ".".join(map(str, f.permute("ip", octets, [256] * 4, back)))


def _secret(f, said, back):
    if said.isalpha() or len(set(said)) < 6:
        return None
    return "".join(f"{d:x}" for d in f.permute("secret", [int(c, 16) for c in said], [16] * len(said), back))


_MAKE = {"email": _email, "date": _date, "iban": _iban, "ssn": _ssn, "phone": _phone, "number": _card, "ip": _ip, "secret": _secret}


def _before_others(text: str, m: re.Match, f: Feistel) -> str:
    """A number up to where a find of another kind starts in it, such as a date after a card."""
    for i in range(m.start() + 13, m.end()):
        if not text[i].isdigit() and sum(c.isdigit() for c in text[m.start() : i]) > 12:
            other = _FIND.match(text, i + 1)
            if other and other.lastgroup != "number" and _MAKE[other.lastgroup](f, other.group(), False) is not None:
                return text[m.start() : i]
    return m.group()


def replace(text: str, f: Feistel, back: bool = False) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and where they stand in it."""
    if not _MAYBE.search(text):
        return text, []
    out, spans, at, size = [], [], 0, 0
    stop = 0
    while m := _FIND.search(text, stop):
        said = _before_others(text, m, f) if m.lastgroup == "number" else m.group()
        new = _MAKE[m.lastgroup](f, said, back)
        stop = m.start() + len(new) if m.lastgroup == "number" else m.end()  # a card may lead a longer number
        if new is None:
            continue
        out += [text[at : m.start()], new]
        size += m.start() - at
        spans.append({"start": size, "stop": size + len(new), "kind": m.lastgroup})
        size += len(new)
        at = stop
    return "".join([*out, text[at:]]), spans


SPANS = "array<struct<start:int,stop:int,kind:string>>"


def pseudonymize(df: DataFrame, key: bytes, text: str = "text", out: str = "text", spans: str = "spans", back: bool = False) -> DataFrame:
    """``df`` with ``out`` holding the text with pseudonyms, and ``spans`` their places."""
    kind = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])))])

    def swap(texts: pa.Array) -> pa.Array:
        f = Feistel(key)
        rows = []
        for t in texts.to_pylist():
            new, found = (None, []) if t is None else replace(t, f, back)
            rows.append({"text": new, "spans": found})
        return pa.array(rows, kind)

    swap.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    made = F.arrow_udf(swap, f"text string, spans {SPANS}")(F.col(text))
    return with_fields(df, made, {"text": out, "spans": spans})


def restore(df: DataFrame, key: bytes, text: str = "text", out: str = "text") -> DataFrame:
    """Inverts ``pseudonymize`` with the same key."""
    spans = fresh("__spans", df)
    return pseudonymize(df, key, text, out, spans, back=True).drop(spans)
