"""Pseudonyms for personal data that keep its format: a keyed Feistel permutation per kind.

A found value is validated (checksum, calendar, ranges), ranked as an integer among all values of
its format, permuted by a Feistel network whose rounds are keyed hashes, and written back in the
format it had. Whatever falls outside the valid values is permuted again until it is inside, so the
map is one-to-one on the valid values of a format: equal values get equal pseudonyms in all
documents, different ones different. Phone numbers with the country code are taken by their written form:
those with digits that no real number has are permuted among themselves. Nobody without the key can tell or undo it.

Kinds: payment cards (Luhn; length and first digit stay), IBANs (country and letter places stay,
check digits follow), US social security numbers, North American phone numbers, IPv4 addresses,
calendar dates of 1900-2099 in three notations, and mail addresses (letters and digits before the
@; the domain stays). Separators stay where they were and do not matter for the value.

Each text is worked on by itself: no shuffle, no state. Null text stays null with no findings;
other columns and ids are not looked at; repeated rows come out alike; an empty table gives an
empty result. Values that do not validate stay as they are.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setspan.llm.common import ship_package

ROUNDS = 8
# For trials and tests alone; a real run passes its own secret.
TRIAL_KEY = b"not a secret"

KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")

# One scan finds the candidates; validation decides.
CANDIDATE = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._+-]{0,62}[A-Za-z0-9])?(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))"
    r"|(?P<date>(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d))"
    r"|(?P<phone>(?<![\d(])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d]|-\d))"
)
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - FIRST_DAY + 1
DATE_FORMS = {"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%m/%d/%Y"}


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1; the tweak separates formats."""
    if size < 2:
        return value
    side = math.isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, side)
        for r in range(ROUNDS):
            seed = hashlib.blake2b(f"{tweak}|{size}|{r}|{right}".encode(), key=key, digest_size=16)
            left, right = right, (left + int.from_bytes(seed.digest(), "big")) % side
        value = left * side + right
        if value < size:  # else walk on: the square is little larger than the size
            return value


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def phone_ok(d: str) -> bool:
    return d[0] in "23456789" and d[3] in "23456789"


def ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def refill(pattern: str, new: str, keep=lambda c: not c.isalnum()) -> str:
    """The characters of ``new`` in the places of ``pattern`` that are not kept."""
    rest = iter(new)
    return "".join(c if keep(c) else next(rest) for c in pattern)


def walk_digits(digits: str, valid, key: bytes, tweak: str) -> str:
    """Permute among the valid strings of so many digits."""
    value, size = int(digits), 10 ** len(digits)
    while True:
        value = permute(value, size, key, tweak)
        found = str(value).zfill(len(digits))
        if valid(found):
            return found


def mixed(text: str, key: bytes, tweak: str) -> str:
    """Permute letters among letters and digits among digits; case and other characters stay."""
    radix = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in text]
    value, size = 0, 1
    for c, r in zip(text, radix):
        digit = ord(c.lower()) - 97 if r == 26 else int(c) if r == 10 else 0
        value, size = value * r + digit, size * r
    shape = "".join("a" if r == 26 else "0" if r == 10 else c for c, r in zip(text, radix))
    value = permute(value, size, key, f"{tweak}|{shape}")
    out = []
    for c, r in zip(reversed(text), reversed(radix)):
        value, digit = divmod(value, r)
        new = chr(97 + digit) if r == 26 else str(digit) if r == 10 else c
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out))


def pseudonym(kind: str, found: str, key: bytes) -> str | None:
    """The pseudonym of a candidate, or None if it does not validate."""
    if kind == "email":
        return mixed(found, key, "email")
    if kind == "ip":
        parts = [int(p) for p in found.split(".")]
        if max(parts) > 255:
            return None
        value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
        return ".".join(str(b) for b in value.to_bytes(4, "big"))
    if kind == "date":
        form = DATE_FORMS[next(c for c in found if not c.isdigit())]
        try:
            day = datetime.datetime.strptime(found, form).date().toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < DAYS:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + permute(day, DAYS, key, "date"))
        return new.strftime(form)
    if kind == "iban":
        plain = found.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = mixed(plain[4:], key, f"iban|{plain[:2]}")
        check = 98 - iban_rest(f"{plain[:2]}00{body}")
        return refill(found, f"{plain[:2]}{check:02d}{body}")
    digits = re.sub(r"\D", "", found)
    if kind == "phone":
        lead, number = digits[:-10], digits[-10:]
        if phone_ok(number):
            return refill(found, lead + walk_digits(number, phone_ok, key, "phone"))
        if not lead:
            return None
        return refill(found, lead + walk_digits(number, lambda d: not phone_ok(d), key, "phone|unassigned"))
    if kind == "ssn":
        return refill(found, walk_digits(digits, ssn_ok, key, "ssn")) if ssn_ok(digits) else None
    if kind == "card":
        if not luhn(digits) or digits[0] == "0":
            return None
        body = walk_digits(digits[1:-1], lambda _: True, key, f"card|{digits[0]}")
        head = digits[0] + body
        return refill(found, next(head + c for c in "0123456789" if luhn(head + c)))
    raise ValueError(kind)


def replace_private(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind there were."""
    counts: dict[str, int] = {}

    def swap(m: re.Match) -> str:
        new = pseudonym(m.lastgroup, m.group(), key)
        if new is None:
            return m.group()
        counts[m.lastgroup] = counts.get(m.lastgroup, 0) + 1
        return new

    return CANDIDATE.sub(swap, text), counts


def pseudonymize(docs: DataFrame, key: bytes = TRIAL_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_private, kinds): every text with its private values replaced."""
    ship_package(docs.sparkSession)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            texts, totals, kinds = [], [], []
            for text, may in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                counts: dict[str, int] = {}
                if may:
                    text, counts = replace_private(text, key)
                texts.append(text)
                totals.append(sum(counts.values()))
                kinds.append(",".join(f"{k}={counts[k]}" for k in KINDS if k in counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(kinds, pa.string())],
                names=[id_col, text_col, "n_private", "kinds"],
            )

    text = F.col(f"`{text_col}`").cast("string")
    # Every kind but a mail address holds several digits close together.
    may = F.coalesce(text.rlike(r"@|\d[ ./()-]{0,2}\d"), F.lit(False))
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField(text_col, T.StringType()),
            T.StructField("n_private", T.LongType()),
            T.StructField("kinds", T.StringType()),
        ]
    )
    return docs.select(F.col(f"`{id_col}`"), text.alias("text"), may.alias("may")).mapInArrow(work, schema)
