"""Format-preserving Feistel pseudonyms for personal data in whole texts.

Numbers and dates that pass their own validation are mapped by a keyed permutation of their
format's domain, so a pseudonym is as valid as its original (checksums hold, days exist,
separators and paddings stay), two values never share one, and equal values have the same
pseudonym in every document, however they are punctuated. A phone number's country code stays,
parsed by the list of codes; one in an American grouping without it counts as country 1.

The permutation is a Feistel network of ``ROUNDS`` rounds over the smallest even number of
bits that holds the domain, walked until the value falls into the domain again; its round
function is keyed BLAKE2b, separated by kind and domain.

Kinds: payment card numbers (13 to 19 digits, Luhn), account numbers (IBAN, mod 97), social
security numbers (ranges), phone numbers (8 to 15 digits with a country code or the usual
grouping), IPv4 addresses (four octets), dates from 1800 to 2199 (three orders), e-mail
addresses (letters and digits of every part but the last label), and other runs of 13 to 19
digits. Where two overlap, the earlier start wins, then the order of this list.

Rows: a null text stays null, with nothing found; an empty text stays empty. All other
columns stay as they are. Rows that repeat each get the same result. A text that isn't valid
UTF-8 is handled byte by byte: only ASCII is ever replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.llm.text import buffers, slices

ROUNDS = 8
#: The session's setting that holds the secret key; without a key anyone could invert the pseudonyms.
KEY_SETTING = "spark.ringfold.pseudonym.key"
#: Stands in where the session holds no key, as in tests and on the synthetic tables; it is no secret.
KEY = b"ringfold pseudonyms"

_FIRST_DAY, _LAST_DAY = datetime.date(1800, 1, 1).toordinal(), datetime.date(2199, 12, 31).toordinal()

# The written forms that are looked for.
_FORMS = {
    "email": rb"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date_ymd": rb"(?<![0-9A-Za-z./-])[0-9]{4}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}(?![0-9A-Za-z]|[-/.][0-9])",
    "date_dmy": rb"(?<![0-9A-Za-z./-])[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4}(?![0-9A-Za-z]|[-/.][0-9])",
    "ipv4": rb"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": rb"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": rb"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?P<s3>[ -])[0-9]{4}(?P=s3)[0-9]{4}(?P=s3)[0-9]{4}|[0-9]{4}(?P<s4>[ -])[0-9]{6}(?P=s4)[0-9]{5})(?![0-9A-Za-z]|[.-][0-9])",
    "phone": rb"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}(?P<s5>[.-])[0-9]{3}(?P=s5)[0-9]{4})(?![0-9A-Za-z]|[.-][0-9])",
}
_FIND = re.compile(b"|".join(b"(?P<" + k.encode() + b">" + p + b")" for k, p in _FORMS.items()))


def permute(value: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """The keyed permutation of range(size)."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, person = (1 << half) - 1, hashlib.blake2b(f"{tweak}/{size}".encode(), digest_size=16).digest()
    width = (half + 7) // 8

    def f(r: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(bytes([r]) + x.to_bytes(width, "big"), digest_size=width, key=key[:64], person=person).digest(), "big") & mask

    while True:
        a, b = value >> half, value & mask
        for r in range(ROUNDS)[:: -1 if inverse else 1]:
            a, b = (b ^ f(r, a), a) if inverse else (b, a ^ f(r, b))
        value = a << half | b
        if value < size:
            return value


def luhn(digits: str) -> bool:
    return not sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def _digits(text: str, new: str) -> str:
    """The text with its digits, in turn, replaced by those of ``new``."""
    it = iter(new)
    return "".join(next(it) if "0" <= c <= "9" else c for c in text)


def _number(digits: str, key: bytes, tweak: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{tweak}{len(digits)}")).zfill(len(digits))


def _card(text: str, key: bytes) -> tuple[str, str] | None:
    digits = re.sub(r"[ -]", "", text)
    if not luhn(digits):
        return ("number", _digits(text, _number(digits, key, "number"))) if digits == text else None
    body = _number(digits[:-1], key, "card")
    return "card", _digits(text, next(body + c for c in "0123456789" if luhn(body + c)))


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _by_class(text: str, key: bytes, tweak: str) -> str:
    """Letters and digits permuted as one number over their places; case, classes and other characters stay."""
    size, value, sizes = 1, 0, [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in text]
    for c, n in zip(text, sizes, strict=True):
        if n > 1:
            value = value * n + (int(c) if n == 10 else ord(c.lower()) - 97)
            size *= n
    value, out = permute(value, size, key, f"{tweak}:{''.join('d' if n == 10 else 'a' if n == 26 else c for c, n in zip(text, sizes, strict=True))}"), []
    for c, n in zip(reversed(text), reversed(sizes), strict=True):
        if n == 1:
            out.append(c)
        else:
            value, d = divmod(value, n)
            out.append(str(d) if n == 10 else chr((65 if c.isupper() else 97) + d))
    return "".join(reversed(out))


def _iban(text: str, key: bytes) -> tuple[str, str] | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = _by_class(plain[4:], key, "iban" + plain[:2])
    new = f"{plain[:2]}{98 - _iban_rest(plain[:2] + '00' + body):02d}{body}"
    it = iter(new)
    return "iban", "".join(c if c == " " else next(it) for c in text)


def _day(text: str, key: bytes) -> tuple[str, str] | None:
    separator = next(c for c in text if not c.isdigit())
    parts = text.split(separator)
    if len(parts[0]) == 4:
        orders = [(0, 1, 2)]
    else:
        orders = [(2, 0, 1), (2, 1, 0)] if separator == "/" else [(2, 1, 0), (2, 0, 1)]
    for order in orders:
        try:
            day = datetime.date(*(int(parts[k]) for k in order)).toordinal()
        except ValueError:
            continue
        if not _FIRST_DAY <= day <= _LAST_DAY:
            return None
        new = datetime.date.fromordinal(_FIRST_DAY + permute(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, key, "date"))
        padded = all(len(p) >= 2 for p in parts)
        out = list(parts)
        for k, x in zip(order, (new.year, new.month, new.day), strict=True):
            out[k] = f"{x:02d}" if padded else str(x)
        return "date", separator.join(out)
    return None


def _ipv4(text: str, key: bytes) -> tuple[str, str] | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    new = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ipv4")
    return "ipv4", ".".join(map(str, new.to_bytes(4, "big")))


_AREAS = [a for a in range(1, 900) if a != 666]


def _ssn(text: str, key: bytes) -> tuple[str, str] | None:
    area, group, serial = map(int, text.split("-"))
    if area not in _AREAS or not group or not serial:
        return None
    value = (_AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(permute(value, len(_AREAS) * 99 * 9999, key, "ssn"), 9999)
    return "ssn", f"{_AREAS[rest // 99]:03d}-{rest % 99 + 1:02d}-{serial + 1:04d}"


# The country codes of one and of two digits; all others have three.
_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")


def country_code(digits: str) -> str:
    """The country code that an international number begins with."""
    return next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3])


def _american(number: str) -> bool:
    """Whether ten digits are a number of country code 1: neither area nor exchange begins with 0 or 1."""
    return number[0] > "1" and number[3] > "1"


def _phone(text: str, key: bytes) -> tuple[str, str] | None:
    digits = re.sub(r"[^0-9]", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    # without a country code only American groupings are looked for
    code = country_code(digits) if text.startswith("+") else ""
    own, tweak = digits[len(code) :], f"phone+{code or 1}"
    if not own:
        return None
    new = _number(own, key, tweak)
    if (code or "1") == "1" and len(own) == 10:
        # valid numbers go to valid ones and others to others: the permutation is walked until it is back in the class
        while _american(new) != _american(own):
            new = _number(new, key, tweak)
    return "phone", _digits(text, code + new)


def _email(text: str, key: bytes) -> tuple[str, str]:
    user, _, host = text.partition("@")
    labels, _, top = host.rpartition(".")
    return "email", f"{_by_class(user, key, 'user')}@{_by_class(labels, key, 'host')}.{top}"


_MAKERS: dict[str, Callable[[str, bytes], tuple[str, str] | None]] = {
    "email": _email, "iban": _iban, "date_ymd": _day, "date_dmy": _day, "ipv4": _ipv4, "ssn": _ssn, "card": _card, "phone": _phone,
}


def pseudonymised(text: bytes, key: bytes = KEY) -> tuple[bytes, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, stop) of each original, in bytes of the text."""
    out, found, at, look = [], [], 0, 0
    while m := _FIND.search(text, look):
        made = _MAKERS[m.lastgroup](m[0].decode("ascii"), key)
        if made is None:
            # what looked like one kind may hold another, from its next place on
            look = m.start() + 1
            continue
        out += [text[at : m.start()], made[1].encode()]
        found.append((made[0], m.start(), m.end()))
        at = look = m.end()
    return b"".join([*out, text[at:]]), found


_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"0123456789@")] = True


def session_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING; KEY, with a warning, where it is unset."""
    held = spark.conf.get(KEY_SETTING, None)
    if not held:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms are made with a public key", stacklevel=2)
    return held.encode() if held else KEY


def pseudonymise(docs: DataFrame, key: bytes | None = None, found: str | None = None) -> DataFrame:
    """docs with pseudonyms in ``text``; with ``found``, a column of that name tells kind, start and stop (bytes of the original) of each. The key is the session's unless one is given. All columns go through under private names, so none clashes."""
    key = session_key(docs.sparkSession) if key is None else key
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{place}"):
            body = batch.column(place)
            buf, off = buffers(body)
            marks = np.concatenate([[0], np.cumsum(_SIGNS[buf])])
            marked = marks[off[1:]] > marks[off[:-1]]
            texts, hits = body.to_pylist(), [[] for _ in range(batch.num_rows)]
            for k in np.flatnonzero(marked).tolist():
                if texts[k] is not None:
                    texts[k], hits[k] = pseudonymised(texts[k], key)
            rows = [[{"kind": kind, "start": a, "stop": b} for kind, a, b in h] for h in hits]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _FOUND)], [*batch.schema.names, "found"])

    inside = docs.select(*[(F.col(f"`{c}`").cast("binary") if c == "text" else F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inside.schema.fields)
    made = inside.mapInArrow(run, f"{kinds}, found array<struct<kind: string, start: bigint, stop: bigint>>")
    out = [(F.col(f"c{k}").cast("string") if k == place else F.col(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)]
    return made.select(*out, *([F.col("found").alias(found)] if found else []))


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
