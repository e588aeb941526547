"""Format-preserving pseudonyms for personal data (operator 9).

Found values are checked (Luhn, mod 97, calendar, octets, number plans) and then permuted by a keyed Feistel network
inside their own format: a card number stays a valid card number of its length and spacing, a date a date. A
permutation sends equal values to equal pseudonyms, in whatever document they stand, and different ones to different.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import hand_back, small_batches

ROUNDS = 10
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
#: The first and last days of dates that are permuted.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Lengths of IBANs by country, from the public registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27,
    "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33,
    "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: Country codes of one and of two digits in the international number plan; all others have three.
CALLING_CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}


def feistel(values: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of digit strings in which position i counts in radices[i].

    The two halves are numbers in mixed radix; each round adds a keyed hash of one half to the other, modulo its size,
    so each round can be undone. One position alone is shifted.
    """
    cut = len(values) // 2
    sizes, halves = [1, 1], [0, 0]
    for side, part in ((0, range(cut)), (1, range(cut, len(values)))):
        for i in part:
            halves[side] = halves[side] * radices[i] + values[i]
            sizes[side] *= radices[i]
    for r in range(ROUNDS):
        to = r % 2
        n = sizes[to].bit_length() // 8 + 9  # eight bytes over the size leave no visible bias
        seed = hashlib.blake2b(f"{tweak}|{r}|{halves[1 - to]}".encode(), key=key, digest_size=32).digest()
        halves[to] = (halves[to] + int.from_bytes(hashlib.shake_128(seed).digest(n), "big")) % sizes[to]
    out = [0] * len(values)
    for side, part in ((0, range(cut)), (1, range(cut, len(values)))):
        rest = halves[side]
        for i in reversed(part):
            rest, out[i] = divmod(rest, radices[i])
    return out


def permute_text(text: str, key: bytes, tweak: str, alphabets: tuple[str, ...] = (LOWER, UPPER, DIGITS)) -> str:
    """Each character stays in its alphabet; the others stay themselves."""
    where = [(i, a) for i, c in enumerate(text) for a in alphabets if c in a]
    if not where:
        return text
    mask = "".join(next((str(k) for k, a in enumerate(alphabets) if c in a), c) for c in text)
    new = feistel([a.index(text[i]) for i, a in where], [len(a) for _, a in where], key, f"{tweak}|{mask}")
    out = list(text)
    for (i, a), v in zip(where, new, strict=True):
        out[i] = a[v]
    return "".join(out)


def walk(value: str, key: bytes, tweak: str, valid: Callable[[str], bool], alphabets: tuple[str, ...] = (DIGITS,)) -> str:
    """Cycle-walking: permute until the result is valid again, which is a permutation of the valid ones."""
    out = permute_text(value, key, tweak, alphabets)
    while not valid(out):
        out = permute_text(out, key, tweak, alphabets)
    return out


def _into(shape: str, digits: str) -> str:
    """digits in the places of shape's digits."""
    each = iter(digits)
    return "".join(next(each) if c in DIGITS else c for c in shape)


def luhn(digits: str) -> int:
    """The check digit that belongs after digits."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def card(found: str, key: bytes) -> str | None:
    digits = re.sub(r"[ -]", "", found)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = walk(digits[:-1], key, "card", lambda x: len(set(x + str(luhn(x)))) > 1)
    return _into(found, body + str(luhn(body)))


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def iban(found: str, key: bytes) -> str | None:
    flat = found.replace(" ", "")
    if IBAN_LENGTHS.get(flat[:2]) != len(flat) or _mod97(flat) != 1:
        return None
    body = permute_text(flat[4:], key, "iban" + flat[:2], (UPPER, DIGITS))
    new = iter(f"{flat[:2]}{98 - _mod97(f'{flat[:2]}00{body}'):02d}{body}")
    return "".join(c if c == " " else next(new) for c in found)


def address(found: str, key: bytes) -> str | None:
    parts = [int(x) for x in found.split(".")]
    return ".".join(map(str, feistel(parts, [256] * 4, key, "ip"))) if max(parts) <= 255 else None


def address6(found: str, key: bytes) -> str | None:
    """An IPv6 address, read as its eight numbers, so that all its spellings have one pseudonym."""
    try:
        if not any(c in DIGITS for c in found) or len([x for x in found.split(":") if x]) < 2:
            return None
        value = ipaddress.IPv6Address(found)
    except ValueError:
        return None
    parts = [int(x, 16) for x in value.exploded.split(":")]
    return str(ipaddress.IPv6Address(":".join(f"{x:x}" for x in feistel(parts, [1 << 16] * 8, key, "ip6"))))


def phone(found: str, key: bytes) -> str | None:
    """The country code stays, the digits after it are permuted, whatever stands between them; a number without a plus
    is one of the North American plan."""
    digits = re.sub(r"\D", "", found)
    if not 8 <= len(digits) <= 15 or len(set(digits)) == 1:
        return None
    code = next((digits[:n] for n in (1, 2) if digits[:n] in CALLING_CODES), digits[:3]) if found[0] == "+" else ""
    body = digits[len(code) :]
    return _into(found, code + permute_text(body, key, "phone" + (code or "1"), (DIGITS,)))


def social(found: str, key: bytes) -> str | None:
    def valid(x: str) -> bool:
        return x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"

    return walk(found, key, "ssn", valid) if valid(found) else None


def date(found: str, key: bytes) -> str | None:
    """Year first, or day first with dots, or month first with slashes (day first where that alone is a date)."""
    numbers = re.split(r"[-./]", found)
    orders = ("ymd",) if len(numbers[0]) == 4 else ("dmy",) if "." in found else ("mdy", "dmy")
    for order in orders:
        part = dict(zip(order, numbers, strict=True))
        try:
            day = datetime.date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        # walked in a grid of 270 x 271 places, a little more than there are days
        span = LAST_DAY - FIRST_DAY + 1
        at = day - FIRST_DAY
        while True:
            high, low = feistel([at // 271, at % 271], [270, 271], key, "date")
            at = high * 271 + low
            new = datetime.date.fromordinal(FIRST_DAY + at) if at < span else None
            # days beyond the twelfth stay beyond it, in every order, so that what reads as day first still does, and a
            # date has one pseudonym in all its spellings
            if new and (new.day > 12) == (datetime.date.fromordinal(day).day > 12):
                break
        text = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        marks = re.findall(r"[-./]", found)
        return text[order[0]] + marks[0] + text[order[1]] + marks[1] + text[order[2]]
    return None


def email(found: str, key: bytes) -> str | None:
    name, _, domain = found.rpartition("@")
    new = permute_text(name.lower(), key, "email" + domain.lower(), (LOWER, DIGITS))
    return "".join(n.upper() if c in UPPER else n for c, n in zip(name, new, strict=True)) + "@" + domain


def secret(found: str, key: bytes) -> str | None:
    m = _SECRET_VALUE.search(found)
    value = m[1]
    for alphabets in ((HEX,), (HEX.upper(),)):
        if all(c in alphabets[0] for c in value):
            return found[: m.start(1)] + permute_text(value, key, "secret", alphabets) + found[m.end(1) :]
    return found[: m.start(1)] + permute_text(value, key, "secret") + found[m.end(1) :]


_SECRET_VALUE = re.compile(r"""["']?([A-Za-z0-9_+/=-]{16,})["']?$""")
#: What is searched for, in order of precedence where two start at one place.
KINDS: list[tuple[str, str, Callable[[str, bytes], str | None]]] = [
    ("secret", r"""(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b)["']?\s*[:=]\s*["']?[A-Za-z0-9_+/=-]{16,}["']?""", secret),
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", address),
    ("ip6", r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?![\w:])", address6),
    ("date", r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)", date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", social),
    ("phone", r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])", phone),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])", card),
]
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in KINDS))
_CALL = {k: f for k, _, f in KINDS}
_HINT = re.compile(r"[0-9@]|(?i:token|secret|passw|key)")


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every checked value replaced, and (kind, start, end) of each in the new text.

    A match that fails its check is passed over by one character, so that a value that starts inside it is found.
    """
    if not _HINT.search(text):
        return text, []
    out, spans, at, done, size = [], [], 0, 0, 0
    while m := _ANY.search(text, at):
        new = _CALL[m.lastgroup](m[0], key)
        if new is None:
            # the kinds of lower precedence get their turn at the same place
            new, m = _others(text, m, key)
        if new is None:
            at = m.start() + 1
            continue
        out += (text[done : m.start()], new)
        size += m.start() - done
        spans.append((m.lastgroup, size, size + len(new)))
        size += len(new)
        at = done = m.end()
    out.append(text[done:])
    return "".join(out), spans


_SINGLE = [(k, re.compile(f"(?P<{k}>{p})"), f) for k, p, f in KINDS]


def _others(text: str, m: re.Match, key: bytes) -> tuple[str | None, re.Match]:
    after = False
    for kind, pattern, call in _SINGLE:
        if after and (x := pattern.match(text, m.start())) and (new := call(x[0], key)) is not None:
            return new, x
        after |= kind == m.lastgroup
    return None, m


def pseudonyms(docs: DataFrame, key: bytes, *, text_col: str = "text") -> DataFrame:
    """docs with text_col pseudonymised and one more column, pii: array of (kind, start, end), places in the new text.

    key: up to 64 bytes, kept secret; the same key gives the same pseudonyms in every run. A null text stays null, with
    an empty pii; other columns stay as they are (one named pii is replaced); repeated rows give repeated rows, and an
    empty table gives none. There is no shuffle.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("pii")
    spans_type = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("pii", spans_type)])
    at = docs.columns.index(text_col)
    pii = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = [], []
            for text in b.column(at).to_pylist():
                new, found = (None, []) if text is None else pseudonymise(text, key)
                texts.append(new)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pii)], names=[*b.schema.names, "pii"])
        hand_back()

    return docs.mapInArrow(run, schema)
