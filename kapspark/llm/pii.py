"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation.

Values that pass their own check (Luhn for cards, mod 97 for IBANs, calendar for dates,
numbering rules for social security numbers, octets for IP addresses, length for
international phone numbers) are replaced by another value of the same format: the same
separators, the same number of digits, a valid check digit, a real date. Mail addresses
and quoted access tokens keep their shape in the same way. A value is read as a number in
the mixed radix of its format, permuted by a balanced Feistel network whose round function
is keyed BLAKE2b, and walked along the cycle until it falls into the format again. So the
mapping is one to one: equal values get equal pseudonyms in all documents, different ones
different pseudonyms, and whoever has the key can turn them back (`reveal`). Upper and
lower case do not matter to the mapping and are kept.

Numbers that fail their check stay as they are, as does all other text. Documents are
independent: one pass, no shuffle, nothing gathered.

Defined cases: null text stays null, with no findings; empty text stays empty; repeated
rows give repeated results; texts are read whole; other columns are carried unless they
have the name of a result column.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date", "token")
DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßœÿ"
HEX = "0123456789abcdef"
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


class Permutation:
    """A keyed one-to-one map of 0..size-1, for any size and each kind of value."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, kind: str, size: int, number: int, half: int, bits: int) -> int:
        out = b""
        seed = f"{kind}|{size}|{number}|{half}".encode()
        while len(out) * 8 < bits:
            out += hashlib.blake2b(seed + b"|%d" % len(out), key=self.key).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _once(self, kind: str, size: int, value: int, bits: int, back: bool) -> int:
        mask = (1 << bits) - 1
        left, right = value >> bits, value & mask
        for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(kind, size, number, left, bits), left
            else:
                left, right = right, left ^ self._round(kind, size, number, right, bits)
        return left << bits | right

    def __call__(self, kind: str, size: int, value: int, back: bool = False) -> int:
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        value = self._once(kind, size, value, bits, back)
        while value >= size:  # walk the cycle; at most four steps are expected
            value = self._once(kind, size, value, bits, back)
        return value


def luhn_digit(digits: str) -> int:
    """The check digit that follows `digits`."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, body: str) -> str:
    """The two check digits of an IBAN."""
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _into_shape(shape: str, symbols: Sequence[str]) -> str:
    """Put symbols in the places of letters and digits of `shape`, with the case of `shape`."""
    out, at = [], 0
    for c in shape:
        if c.isalnum():
            s = symbols[at]
            out.append(s.upper() if c.isupper() and len(s.upper()) == 1 else s)
            at += 1
        else:
            out.append(c)
    return "".join(out)


def _alphabet(c: str) -> str:
    if c in DIGITS:
        return DIGITS
    if c in LETTERS:
        return LETTERS
    return ACCENTED if c in ACCENTED else c


def permute_symbols(p: Permutation, kind: str, text: str, back: bool, alphabet: str | None = None) -> list[str]:
    """Permute the letters and digits of a text, each within its own kind of symbol."""
    symbols = [c.lower() if len(c.lower()) == 1 else c for c in text if c.isalnum()]
    tables = [alphabet if alphabet and c in alphabet else _alphabet(c) for c in symbols]
    size, value = 1, 0
    for c, t in zip(symbols, tables):
        size *= len(t)
        value = value * len(t) + t.index(c)
    # the shape takes part, so values of different shapes have permutations of their own
    shape = "".join(str(len(t)) + "," if len(t) > 1 else c for c, t in zip(symbols, tables))
    value = p(f"{kind}:{shape}", size, value, back) if size > 1 else value
    out = []
    for t in reversed(tables):
        value, k = divmod(value, len(t))
        out.append(t[k])
    return out[::-1]


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _card(p: Permutation, text: str, back: bool) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = "".join(permute_symbols(p, "card", digits[:-1], back))
    return _into_shape(text, body + str(luhn_digit(body)))


def _iban(p: Permutation, text: str, back: bool) -> str | None:
    plain = "".join(text.split()).upper()
    if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    body = "".join(permute_symbols(p, "iban" + plain[:2], plain[4:], back)).upper()
    return _into_shape(text, plain[:2] + iban_check(plain[:2], body) + body)


def _ssn(p: Permutation, text: str, back: bool) -> str | None:
    a, b, c = (int(x) for x in text.split("-"))
    if not 0 < a < 900 or a == 666 or not b or not c:
        return None
    areas = 898  # 001 to 899 without 666
    place = (a - 1 - (a > 666)) * 99 * 9999 + (b - 1) * 9999 + c - 1
    place = p("ssn", areas * 99 * 9999, place, back)
    place, c = divmod(place, 9999)
    a, b = divmod(place, 99)
    a += 1 + (a >= 665)
    return f"{a:03d}-{b + 1:02d}-{c + 1:04d}"


def _phone(p: Permutation, text: str, back: bool) -> str | None:
    digits = _digits(text)
    if text.startswith("+"):
        if not 8 <= len(digits) <= 15:
            return None
        fixed = 1 if digits[0] in "17" else 2  # the country code stays
    else:
        if len(digits) != 10 or digits[0] in "01" or digits[3] in "01":
            return None
        fixed = 0
    return _into_shape(text, digits[:fixed] + "".join(permute_symbols(p, "phone", digits[fixed:], back)))


def _ip(p: Permutation, text: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    value = p("ip", 1 << 32, int.from_bytes(bytes(int(x) for x in parts), "big"), back)
    return ".".join(str(x) for x in value.to_bytes(4, "big"))


def _date(p: Permutation, text: str, back: bool) -> str | None:
    mark = next(c for c in text if not c.isdigit())
    parts = text.split(mark)
    if len(parts[0]) == 4:
        order = "ymd"
    elif mark == "/" and int(parts[1]) > 12:
        order = "mdy"
    else:
        order = "dmy"
    named = dict(zip(order, map(int, parts)))
    try:
        day = dt.date(named["y"], named["m"], named["d"]).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    kind = f"date{order}{mark}"
    value = day - FIRST_DAY
    while True:
        value = p(kind, LAST_DAY - FIRST_DAY + 1, value, back)
        new = dt.date.fromordinal(value + FIRST_DAY)
        # a month-first date must stay readable as one, and a day-first date too
        if mark != "/" or order == "ymd" or (new.day > 12) == (order == "mdy" or named["d"] > 12):
            break
    values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return mark.join(values[c] for c in order)


def _email(p: Permutation, text: str, back: bool) -> str | None:
    name, _, host = text.rpartition("@")
    head, _, top = host.rpartition(".")
    if len(top) < 2 or name.startswith(".") or name.endswith(".") or ".." in name:
        return None
    return _into_shape(name, permute_symbols(p, "email@" + host.lower(), name, back)) + "@" + host


def _token(p: Permutation, text: str, back: bool) -> str | None:
    if text in (text.lower(), text.upper()):
        new = "".join(permute_symbols(p, "token", text.lower(), back, HEX))
        return new.upper() if text != text.lower() else new
    signs = HEX + "ABCDEF"
    size, value = len(signs) ** len(text), 0
    for c in text:
        value = value * len(signs) + signs.index(c)
    while True:  # a token in both cases stays one
        value, new = p("token-mixed", size, value, back), ""
        rest = value
        for _ in text:
            rest, k = divmod(rest, len(signs))
            new = signs[k] + new
        if new not in (new.lower(), new.upper()):
            return new


# One pattern for all kinds; the first group that matches names the kind.
FINDER = re.compile(
    r"(?P<email>(?<![\w.+-])[^\W_][\w.+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+)"
    r"|(?<![A-Za-z0-9])(?P<token>(?<=[\"'])[0-9A-Fa-f]{32,128}(?=[\"']))"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![\d.,+-])(?P<date>\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d-])"
    r"|(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])"
    r"|(?<![\d.])(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\d|\.\d)"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)"
    r"|(?<![\d.,+-])(?P<card>\d(?:[ -]?\d){12,18})(?![\d-])"
)
WORK: dict[str, Callable[[Permutation, str, bool], str | None]] = {
    "email": _email,
    "iban": _iban,
    "card": _card,
    "ssn": _ssn,
    "phone": _phone,
    "ip": _ip,
    "date": _date,
    "token": _token,
}
START = re.compile(r"[0-9@]")
UNBOUNDED = ("email", "token")
# Where a value may begin inside another candidate.
STEP = re.compile(r"(?<![^\W_])[^\W_]|[+(]")


def _put(outer: re.Match, inner: re.Match, new: str) -> str:
    """The outer match's text once the inner match is replaced."""
    at, end = inner.start() - outer.start(), inner.end() - outer.start()
    whole = outer.group()
    return whole[:at] + new[: len(whole) - at] + whole[end:]


def rewrite(text: str, p: Permutation, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and the number of values of each kind."""
    found: dict[str, int] = {}
    if not START.search(text):
        return text, found
    out, at = [], 0
    for a, z in _regions(text):
        a, failed = max(a, at), []
        while m := FINDER.search(text, a, z):
            work = WORK[m.lastgroup]
            new = work(p, m.group(), back)
            if new is None:
                # a value may begin further on in a candidate of bounded length
                step = None if m.lastgroup in UNBOUNDED else STEP.search(text, m.start() + 1, m.end())
                a = step.start() if step else m.end()
                failed.append(m)
                continue
            # candidates that failed must fail with the pseudonym too, or it could not be reversed
            around = [f for f in failed if f.end() > m.start()]
            while any(WORK[f.lastgroup](p, _put(f, m, new), back) is not None for f in around):
                new = work(p, new, back)
            out += [text[at : m.start()], new]
            at = a = m.end()
            failed = []
            found[m.lastgroup] = found.get(m.lastgroup, 0) + 1
    out.append(text[at:])
    return "".join(out), found


# Stretches around digits and @ signs; no value reaches beyond its stretch.
REGION = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: (?:[A-Z]{4} ){0,2}[^\s0-9@]*+[0-9@]\S*+)*")


def _regions(text: str) -> Iterator[tuple[int, int]]:
    for m in REGION.finditer(text):
        yield m.start(), m.end()


def pseudonymise(
    df: DataFrame,
    key: bytes,
    text_col: str = "text",
    keep_cols: Sequence[str] | None = None,
    reveal: bool = False,
) -> DataFrame:
    """`keep_cols` (default: all others), the rewritten text and `n_<kind>` for each of KINDS."""
    counts = [f"n_{k}" for k in KINDS]
    keep = [c for c in (df.columns if keep_cols is None else keep_cols) if c != text_col and c not in counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permutation(key)
        for batch in batches:
            done = [(None, {}) if t is None else rewrite(t, p, reveal) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep),
                    pa.array([t for t, _ in done], pa.string()),
                    *(pa.array([f.get(k, 0) for _, f in done], pa.int32()) for k in KINDS),
                ],
                names=[*keep, text_col, *counts],
            )

    schema = T.StructType(
        [
            *(df.schema[c] for c in keep),
            T.StructField(text_col, T.StringType()),
            *(T.StructField(c, T.IntegerType()) for c in counts),
        ]
    )
    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
