"""Personal data in texts (operator 5): patterns propose, checksums confirm, context adjusts.

Four kinds are base kinds: whatever their pattern and check let pass is a span,
at the score of the kind. Further kinds (IBAN, social security numbers, phone-like
numbers in other writings, long random strings such as keys and tokens) have a base
score that words close by raise or lower, and count from a threshold on.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markerloom.llm.common import by_text, keyed_texts

BASE_KINDS = ("email", "ip", "card", "phone")
#: Characters before and after a span in which context words count.
CONTEXT_CHARS = 40
THRESHOLD = 0.5
SPANS = "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>"

# Possessive and look-behind forms of the plain patterns: the same matches, in linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9.+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_RANDOM = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,256}+={0,2}+(?![A-Za-z0-9_+/=-])")
_TURN = re.compile(r"(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]")
_NEAR_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Check digit of card numbers."""
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        total += digit if i % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Check digits of an IBAN: moved to the end and read as a number, it leaves 1."""
    compact = account.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def random_looking(text: str) -> bool:
    """Whether a long string looks drawn and not written: small and capital letters and digits mixed, and many different ones."""
    body = text.strip("=-_")
    digits = sum(map(str.isdigit, body))
    return len(body) >= 20 and 0 < digits < len(body) and len(set(body)) >= 10 and len(_TURN.findall(body)) * 6 >= len(body)


@dataclass(frozen=True)
class Kind:
    """A further kind: pattern, check, score without context, and the words that change it."""

    name: str
    pattern: re.Pattern
    score: float
    valid: Any = None
    raising: frozenset[str] = frozenset()
    lowering: frozenset[str] = frozenset()


FURTHER_KINDS = (
    Kind("iban", _IBAN, 0.9, mod97, frozenset({"iban", "account", "bank", "konto", "compte", "cuenta"})),
    Kind("ssn", _SSN, 0.45, None, frozenset({"ssn", "social", "security", "tax", "taxpayer"}), frozenset({"isbn", "order", "part", "serial", "version"})),
    Kind("secret", _RANDOM, 0.4, random_looking, frozenset({"key", "token", "secret", "password", "passwd", "pwd", "apikey", "api", "bearer", "auth", "credential", "credentials", "private"}), frozenset({"sha", "commit", "checksum", "digest", "hash", "uuid"})),
    Kind("local_phone", _NATIONAL, 0.4, None, frozenset({"phone", "call", "tel", "telephone", "mobile", "fax", "contact"}), frozenset({"isbn", "order", "part", "serial", "version"})),
)
RAISED, LOWERED = 0.35, -0.35


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each at-sign: the part before it is the run that ends there."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _is_local(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def _is_local(char: str) -> bool:
    return char.isascii() and (char.isalnum() or char in "._%+-")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    ips, cards = [], []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            ips.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append(("card", m.start(), m.end()))
    out += ips + cards
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def further_spans(text: str, taken: list[tuple[str, int, int]], threshold: float = THRESHOLD) -> Iterator[tuple[str, int, int, float]]:
    """Spans of the further kinds that no base span overlaps, if their score with context reaches the threshold."""
    covered: set[int] = {i for _, a, b in taken for i in range(a, b)}
    for kind in FURTHER_KINDS:
        for m in kind.pattern.finditer(text):
            if kind.valid and not kind.valid(m[0]) or not covered.isdisjoint(range(m.start(), m.end())):
                continue
            near = text[max(0, m.start() - CONTEXT_CHARS) : m.start()] + " " + text[m.end() : m.end() + CONTEXT_CHARS]
            words = {w.lower() for w in _NEAR_WORD.findall(near)}
            score = kind.score + RAISED * bool(words & kind.raising) + LOWERED * bool(words & kind.lowering)
            if score >= threshold:
                yield kind.name, m.start(), m.end(), round(min(1.0, score), 3)


_SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7}


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    base = base_spans(text)
    return [(k, a, b, _SCORES[k]) for k, a, b in base] + list(further_spans(text, base))


def find_spans(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans``: base kinds first in their order, then the further ones, each by start.

    Places are code points, ends exclusive. Null and empty texts have no spans;
    null keys and repeated rows are kept as they are; long texts are read whole
    in linear time; no documents give no rows.
    """

    def work(keys: list[int | None], texts: list[str]) -> Iterable[dict[str, Any]]:
        rows = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans_of(t)] for t in texts]
        yield {"doc_id": keys, "spans": rows}

    return by_text(keyed_texts(documents, key, text), SPANS, work)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    if not text:
        return text
    found = sorted((a, -b, k) for k, a, b, _ in spans_of(text))
    if not found:
        return text
    out, free, at = [], 0, 0
    while at < len(found):
        start, end, kind = found[at][0], -found[at][1], found[at][2]
        at += 1
        while at < len(found) and found[at][0] < end:
            end = max(end, -found[at][1])
            at += 1
        out += [text[free:start], f"<{kind.upper()}>"]
        free = end
    return "".join(out) + text[free:]


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with personal data in ``text`` replaced; all columns and rows are kept, null texts stay null."""

    @F.pandas_udf(T.StringType())
    def cleaned(texts):
        return texts.map(redact_text, na_action="ignore")

    return documents.withColumn(text, cleaned(F.col(f"`{text}`").cast("string")))
