"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns and are kept as they are. The method adds spans that those patterns
miss or lose: cards and phones inside a longer run of digits, IBANs (mod 97), and numbers that only count with a context word near by.
A proposed span has a prior by kind, a passed checksum raises it, a context word within ``CONTEXT_CHARS`` raises it again; spans of at least
``MIN_SCORE`` are kept. Offsets are code points, ends exclusive.

Null texts count as empty and have no spans. Rows keep their id, null included; repeated rows give repeated results. Matching is linear in
the length of the text, so very long texts need no special care.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.batches import slices

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]
CONTEXT_CHARS = 40
MIN_SCORE = 0.5
#: Score of a proposed span, and what a passed checksum and a context word add.
PRIOR = {"card": 0.2, "phone": 0.3, "iban": 0.1, "ssn": 0.2}
CHECKSUM, CONTEXT = 0.5, 0.3

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its start only: a match that fails there fails at its other digits too.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_PHONE_START = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
_GROUPS = re.compile(r"[0-9]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_CONTEXT = {
    "card": re.compile(r"(?i)card|visa|mastercard|credit|debit|karte|carte|tarjeta"),
    "phone": re.compile(r"(?i)phone|\btel\b|call|mobile|telefon|téléphone|teléfono|handy"),
    "iban": re.compile(r"(?i)iban|account|bank|konto|compte|cuenta"),
    "ssn": re.compile(r"(?i)ssn|social security|insurance number"),
}

Span = tuple[str, int, int, float, bool]


def luhn(digits: str) -> bool:
    """The last digit checks the others: every second digit from the right is doubled."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Country and check digits moved to the end, letters as 10 to 35: the number leaves 1 modulo 97."""
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(_GROUPS.findall(text))


def _cards_inside(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Numbers of 14 to 19 digits that pass Luhn, made of whole groups of a longer run."""
    groups = [(m.start(), m.end()) for m in _GROUPS.finditer(text, start, end)]
    i = 0
    while i < len(groups):
        size, step = 0, 1
        for j in range(i, len(groups)):
            size += groups[j][1] - groups[j][0]
            if size > 19:
                break
            if size >= 14 and luhn(_digits(text[groups[i][0] : groups[j][1]])):
                yield groups[i][0], groups[j][1]
                step = j - i + 1
                break
        i += step


def base_spans(text: str) -> tuple[list[Span], list[tuple[str, int, int]]]:
    """Spans of the base kinds, and the runs of digits that matched a pattern but failed its test."""
    out: list[Span] = [("email", a, b, 1.0, True) for a, b in _emails(text)]
    failed = []
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (g.lstrip("0") for g in m.groups())):
            out.append(("ip", m.start(), m.end(), 1.0, True))
    for m in _DIGITS.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end(), 1.0, True))
        elif len(digits) > 14:
            failed.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        n = sum(map(str.isdigit, m[0]))
        if 10 <= n <= 15:
            out.append(("phone", m.start(), m.end(), 1.0, True))
        elif n > 15:
            failed.append(("phone", m.start(), m.end()))
    return out, failed


def find_spans(text: str) -> list[Span]:
    """All spans as (kind, start, end, score, base), by start, then kind."""
    out, failed = base_spans(text)

    def near(kind: str, start: int, end: int) -> bool:
        return bool(_CONTEXT[kind].search(text[max(0, start - CONTEXT_CHARS) : start]) or _CONTEXT[kind].search(text[end : end + CONTEXT_CHARS]))

    taken = bytearray(len(text))  # a mark per character, so a text with very many spans takes no longer per span

    def mark(start: int, end: int) -> None:
        taken[start:end] = b"\1" * (end - start)

    for _, a, b, _, _ in out:
        mark(a, b)

    def add(kind: str, start: int, end: int, checked: bool) -> None:
        score = PRIOR[kind] + CHECKSUM * checked + CONTEXT * near(kind, start, end)
        if score >= MIN_SCORE and taken.find(1, start, end) < 0:
            out.append((kind, start, end, round(score, 2), False))
            mark(start, end)

    for kind, start, end in failed:
        if kind == "card":
            for a, b in _cards_inside(text, start, end):
                add("card", a, b, checked=True)
        elif m := _PHONE_START.match(text, start, end):
            add("phone", m.start(), m.end(), checked=10 <= sum(map(str.isdigit, m[0])) <= 15)
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            add("iban", m.start(), m.end(), checked=True)
    for m in _SSN.finditer(text):
        add("ssn", m.start(), m.end(), checked=False)
    for m in _LOCAL_PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            add("phone", m.start(), m.end(), checked=False)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``, an array of (kind, start, end, score, base)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            maybe = pc.match_substring_regex(texts, "[0-9@]").to_pylist()
            found = [
                [dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in find_spans(texts[i].as_py())] if hit else []
                for i, hit in enumerate(maybe)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, SPANS)], names=["doc_id", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double, base: boolean>>")


def redact(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with every span replaced by its kind in brackets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                at, parts = 0, []
                for kind, start, end, _, _ in find_spans(text):
                    if start >= at:
                        parts += [text[at:start], f"[{kind}]"]
                        at = end
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, text string")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and all spans as text."""

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
