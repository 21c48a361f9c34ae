"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (``email``, ``ip``, ``card``, ``phone``) follow fixed patterns and
checks and are always reported. Added kinds are reported when the score of the
proposal, its checksum and the words around it reaches ``MIN_SCORE``:

* ``iban``: country, check digits and account, confirmed by the remainder 97;
* ``ssn``: nine digits in groups 3-2-4 outside the ranges never issued, which
  need a context word, as they have no checksum;
* ``secret``: a long quoted or bare hexadecimal value after a name such as token.

Every span carries its score, so a caller can set a stricter limit.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import free_name, map_columns, table

NAME = "op10_pii"
ORACLE_SQL = None  # offsets of pattern matches; tests use a brute-force version

# Fixed values of the contract: kinds in order, patterns, limits.
BASE_KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ADDED_KINDS = ("iban", "ssn", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?([0-9a-f]{20,})")

#: Score of a proposal by kind, what a passed checksum adds, and what a context word nearby adds.
PROPOSAL = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4, "ssn": 0.4, "secret": 0.7}
CHECKSUM_BONUS = 0.4
CONTEXT_BONUS = 0.2
CONTEXT_CHARS = 40
MIN_SCORE = 0.6
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "secret": (),
}
_CONTEXT = {kind: re.compile(r"(?i)\b(?:" + "|".join(words) + r")", re.A) if words else None for kind, words in CONTEXT.items()}
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit)
        if i % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of international account numbers: moved to the end, letters as numbers, remainder 1."""
    compact = account.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _ssn_issued(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def find_spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind as listed; offsets are code points, ends exclusive.

    Null or empty: no spans. A pattern is only tried on a text that has a
    character it cannot match without.
    """
    if not text:
        return []
    found: list[tuple[int, int, str, float]] = []

    def propose(kind: str, start: int, end: int, confirmed: bool = False) -> None:
        score = PROPOSAL[kind] + CHECKSUM_BONUS * confirmed
        near = _CONTEXT[kind]
        if near and (near.search(text[max(0, start - CONTEXT_CHARS) : start]) or near.search(text[end : end + CONTEXT_CHARS])):
            score += CONTEXT_BONUS
        if kind in BASE_KINDS or score >= MIN_SCORE:
            found.append((start, end, kind, round(min(score, 1.0), 3)))

    if "@" in text:
        for start, end in _emails(text):
            propose("email", start, end)
    if _DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")):
                    propose("ip", *m.span())
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                propose("card", *m.span(), confirmed=True)
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    propose("phone", *m.span())
        for m in IBAN.finditer(text):
            value = m[0]
            while value and not mod97(value):  # a following word in capitals may look like a last group
                value = value[: value.rfind(" ")] if " " in value else ""
            if value:
                propose("iban", m.start(), m.start() + len(value), confirmed=True)
        if "-" in text:
            for m in SSN.finditer(text):
                if _ssn_issued(m[0]):
                    propose("ssn", *m.span())
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            propose("secret", *m.span(1))
    found.sort(key=lambda span: (span[0], KINDS.index(span[2])))
    return found


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str):
    """The matches of ``EMAIL``, found from each @ outwards, so that texts are not scanned character by character."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = EMAIL.match(text, start) if start < at else None
        if match:
            yield match.span()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def _spans(texts):
    rows = [find_spans(text) for text in texts]
    yield {"spans": [[{"start": s, "end": e, "kind": k, "score": v} for s, e, k, v in row] for row in rows]}


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (start, end, kind, score) of the whole text.

    Null and empty texts have an empty array. A narrow pass: no shuffle, so no
    key can be hot. An existing column ``spans`` is replaced.
    """
    docs = docs.drop("spans")
    schema = "spans array<struct<start: long, end: long, kind: string, score: double>>"
    return map_columns(docs, [text], schema, _spans, docs.columns)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    (out,) = free_name(docs, "redacted")

    def convert(texts):
        yield {out: [None if value is None else _redacted(value) for value in texts]}

    kept = map_columns(docs, [text], f"`{out}` string", convert, docs.columns)
    return kept.withColumn(text, F.col(out)).drop(out)


def _redacted(text: str) -> str:
    parts, done = [], 0
    for start, end, kind, _ in find_spans(text):
        if start >= done:
            parts += [text[done:start], f"<{kind}>"]
            done = end
    return "".join([*parts, text[done:]])


def _of_kinds(*kinds: str):
    return lambda span: span["kind"].isin(*kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", _of_kinds(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[
            F.size(F.filter("spans", _of_kinds(kind))).cast("long").alias(f"n_{kind}")
            for kind in BASE_KINDS
        ],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
