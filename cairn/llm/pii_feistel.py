"""Format-preserving pseudonyms for personal data (operator 3).

Numbers and dates are found by pattern, validated (Luhn, mod 97, calendar, octet and area ranges), and replaced by a
keyed permutation of the same format: an unbalanced Feistel network over a x b >= N with cycle walking permutes the
values of a format of N values. The round function is keyed BLAKE2b, tweaked by the kind. Equal values get equal
pseudonyms in every document, different ones stay different, whatever their separators; the key's holder can invert it.
A date written month first
is read back only where its new day is above twelve, so that it stays linked with the same date written otherwise.
E-mail local parts, access keys and assigned secrets go the same way, character class by character class.

The key is the caller's, or the session's setting KEY_SETTING; where neither is given a session draws one by chance, so its
pseudonyms are linked with each other and nobody can invert them later.

Cases: a null text stays null, an empty one empty; very long texts are read whole; rows that share a doc_id, or have none, are
rows of their own; numbers that fail their validation stay as they are; where two kinds
overlap, the one that starts first, then the one listed first in KINDS, holds. Repeated rows give repeated rows; an empty
table gives an empty table; other columns are not read by `pseudonyms` and are kept by `pseudonymised`.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
import secrets

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import arrow_map, documents, slices

KEY_SETTING = "spark.cairn.pseudonyms.key"
ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Permutation:
    """A keyed permutation of 0..n-1."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.a = math.isqrt(max(0, n - 1)) + 1
        self.b = -(-n // self.a)
        self.size = (max(self.a, self.b).bit_length() + 7) // 8 + 8
        self.seed = hashlib.blake2b(f"{tweak}|{n}".encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest()

    @functools.lru_cache(maxsize=4096)  # noqa: B019  a few objects for each worker
    def _round(self, i: int, half: int) -> int:
        said = hashlib.blake2b(i.to_bytes(1, "big") + half.to_bytes(self.size, "big"), key=self.seed, digest_size=min(64, self.size)).digest()
        return int.from_bytes(said, "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + self._round(i, left)) % self.b
            else:
                left = (left + self._round(i, right)) % self.a
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(ROUNDS)):
            if i % 2:
                right = (right - self._round(i, left)) % self.b
            else:
                left = (left - self._round(i, right)) % self.a
        return left * self.b + right

    def apply(self, x: int, back: bool = False) -> int:
        step = self._back if back else self._once
        x = step(x)
        while x >= self.n:  # a and b cover n with less than one row to spare, so the walk is short
            x = step(x)
        return x


def luhn(digits: str) -> int:
    """The sum that a valid number makes divisible by ten."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


class Pseudonymiser:
    """text -> (text with pseudonyms, spans as (start, end, kind) of the original)."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back, self.made = key, back, {}

    def number(self, kind: str, x: int, n: int) -> int:
        p = self.made.get((kind, n))
        if p is None:
            p = self.made[kind, n] = Permutation(self.key, kind, n)
        return p.apply(x, self.back)

    def characters(self, kind: str, text: str, hexadecimal: bool = False) -> str:
        """Each character of a class becomes one of its class; the classes of a value are part of its format."""
        sets = [HEX if hexadecimal and c in HEX else next((s for s in (DIGITS, LOWER, UPPER) if c in s), "") for c in text]
        n, x = 1, 0
        for c, s in zip(text, sets, strict=True):
            if s:
                n, x = n * len(s), x * len(s) + s.index(c)
        if n == 1:
            return text
        form = "".join({DIGITS: "9", LOWER: "a", UPPER: "A", HEX: "f"}.get(s, c) for c, s in zip(text, sets, strict=True))
        x, out = self.number(f"{kind}|{form}", x, n), []
        for c, s in zip(reversed(text), reversed(sets), strict=True):
            if s:
                x, at = divmod(x, len(s))
                c = s[at]
            out.append(c)
        return "".join(reversed(out))

    def digits(self, text: str, new: str) -> str:
        """text with its digits replaced in order; separators stay."""
        rest = iter(new)
        return "".join(next(rest) if c in DIGITS else c for c in text)

    # one method for each kind: the pseudonym, or None if the value is not valid

    def card(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn(digits) % 10:
            return None
        body = f"{self.number('card', int(digits[:-1]), 10 ** (len(digits) - 1)):0{len(digits) - 1}d}"
        return self.digits(m[0], body + str(-luhn(body + "0") % 10))

    def phone(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        if m[0][0] != "+":  # national: ten digits, area and exchange from 200
            if len(digits) != 10 or digits[0] < "2" or digits[3] < "2":
                return None
            digits, lead = "1" + digits, ""
        else:
            if not 8 <= len(digits) <= 15 or digits[0] == "0":
                return None
            lead = digits[0] if digits[0] in "17" else digits[:2]
        if digits[0] == "1":
            if len(digits) != 11 or digits[1] < "2" or digits[4] < "2":
                return None
            x = ((int(digits[1:4]) - 200) * 800 + int(digits[4:7]) - 200) * 10_000 + int(digits[7:])
            x, line = divmod(self.number("phone 1", x, 800 * 800 * 10_000), 10_000)
            area, exchange = divmod(x, 800)
            return self.digits(m[0], f"{lead}{area + 200}{exchange + 200}{line:04d}")
        rest = digits[len(lead) :]
        return self.digits(m[0], f"{lead}{self.number(f'phone {lead}', int(rest), 10 ** len(rest)):0{len(rest)}d}")

    def ip(self, m: re.Match) -> str | None:
        octets = m[0].split(".")
        if any(len(o) > 1 and o[0] == "0" or int(o) > 255 for o in octets):
            return None
        x = self.number("ip", functools.reduce(lambda a, o: a * 256 + int(o), octets, 0), 1 << 32)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def date(self, m: re.Match) -> str | None:
        parts = re.split(r"[-/.]", m[0])
        sep, iso = re.search(r"[-/.]", m[0])[0], len(parts[0]) == 4
        y, mo, d = parts if iso else reversed(parts)
        swapped = not iso and sep == "/" and int(mo) > 12  # month/day/year, where it can be nothing else
        if swapped:
            mo, d = d, mo
        try:
            day = datetime.date(int(y), int(mo), int(d)).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + self.number("date", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))
        if iso:
            return f"{new.year}{sep}{new.month:02d}{sep}{new.day:02d}"
        first, second = (new.month, new.day) if swapped else (new.day, new.month)
        return f"{first:02d}{sep}{second:02d}{sep}{new.year}"

    def ssn(self, m: re.Match) -> str | None:
        area, group, serial = map(int, m[0].split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        area -= 1 + (area > 666)  # 898 areas
        x, serial = divmod(self.number("ssn", (area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999), 9999)
        area, group = divmod(x, 99)
        area += 1 + (area + 1 >= 666)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def iban(self, m: re.Match) -> str | None:
        plain = m[0].replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = self.characters(f"iban {plain[:2]}", plain[4:])
        new = iter(plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + body):02d}" + body)
        return "".join(c if c == " " else next(new) for c in m[0])

    def email(self, m: re.Match) -> str | None:
        local, domain = m[0].rsplit("@", 1)
        return f"{self.characters('email', local)}@{domain}"

    def access_key(self, m: re.Match) -> str | None:
        return m[0][:4] + self.characters("access key", m[0][4:])

    def secret(self, m: re.Match) -> str | None:
        value = m["value"]
        return m[0][: m.start("value") - m.start()] + self.characters("secret", value, hexadecimal=not set(value) - set(HEX)) + m[0][m.end("value") - m.start() :]


#: Kind, what a text must contain for it to be looked for, and its pattern.
KINDS = [
    ("secret", re.compile(r"(?i:token|password|passwd|secret|api[_-]?key)\s*[=:]"), re.compile(r"(?i:\b(?:token|password|passwd|secret|api[_-]?key))\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9_\-+/.]{7,}[A-Za-z0-9])")),
    ("access_key", re.compile("A[KS]IA"), re.compile(r"\bA[KS]IA[A-Z0-9]{16}\b")),
    ("email", re.compile("@"), re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")),
    ("iban", re.compile(r"\d"), re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")),
    ("date", re.compile(r"\d"), re.compile(r"(?<![\w.\-/])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}([./-])\d{2}\1\d{4})(?![\w\-/]|\.\d)")),
    ("ssn", re.compile(r"\d"), re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("ip", re.compile(r"\d"), re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)")),
    ("card", re.compile(r"\d"), re.compile(r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("phone", re.compile(r"\d"), re.compile(r"\+\d[\d ().-]{6,20}\d(?!\w)|(?<![\w+-])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![\w-])")),
]
NAMES = [kind for kind, _, _ in KINDS]
_DIGIT = re.compile(r"\d")


def replace(text: str, keyed: Pseudonymiser) -> tuple[str, list[tuple[int, int, str]]]:
    found, has_digit = [], _DIGIT.search(text) is not None
    for rank, (kind, hint, pattern) in enumerate(KINDS):
        if not has_digit and hint.pattern == r"\d" or hint.search(text) is None:
            continue
        for m in pattern.finditer(text):
            if (new := getattr(keyed, kind)(m)) is not None:
                found.append((m.start(), rank, m.end(), kind, new))
    if not found:
        return text, []
    out, spans, at = [], [], 0
    for start, _, end, kind, new in sorted(found):
        if start >= at:
            out += [text[at:start], new]
            spans.append((start, end, kind))
            at = end
    return "".join([*out, text[at:]]), spans


_drawn = secrets.token_bytes(32)


def key_of(spark: SparkSession) -> bytes:
    """The session's key, or this driver's own, drawn when it started."""
    said = spark.conf.get(KEY_SETTING, None)
    return said.encode() if said else _drawn


def pseudonyms(docs: DataFrame, key: bytes | None = None, back: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, and for each kind how many values were replaced. back: the inverse."""
    key = key or key_of(docs.sparkSession)
    names = ["doc_id", "text", *(f"n_{k}" for k in NAMES)]

    def make():
        keyed = Pseudonymiser(key, back)

        def step(columns: dict) -> dict:
            out: dict = {n: [] for n in names}
            for doc_id, text in zip(columns["doc_id"], columns["text"], strict=True):
                new, spans = replace(text, keyed) if text else (text, [])
                counts = dict.fromkeys(NAMES, 0)
                for _, _, kind in spans:
                    counts[kind] += 1
                for n, v in zip(names, (doc_id, new, *counts.values()), strict=True):
                    out[n].append(v)
            return out

        return step

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, text string" + "".join(f", n_{k} int" for k in NAMES), names)


def pseudonymised(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with the pseudonyms in `text`; all other columns and the schema stay."""
    import pyarrow as pa

    key = key or key_of(docs.sparkSession)

    def run(batches):
        keyed = Pseudonymiser(key)
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            new = [replace(text, keyed)[0] if text else text for text in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(documents(spark, sf_dir)).withColumn("n_replaced", sum((F.col(f"n_{k}") for k in NAMES), F.lit(0)))
