r"""Personal data in texts: patterns propose, checksums confirm, context scores.

A regular expression proposes spans of each kind.  Validators confirm them: the
parts of an IP address, Luhn for cards, mod 97 for IBANs, digit counts for phone
numbers.  A score starts from how telling the pattern is, rises with a passed
checksum and with context words within ``CONTEXT`` code points before or after
the span, and spans from ``THRESHOLD`` up are returned.  The four base kinds
(email, ip, card, phone) score at least the threshold once they are valid, so
context can never remove one; iban, ssn and local_phone are added by the method.

All scans are linear in the text: runs are matched greedily once and never
retried from their middle.  Offsets are code points, ends exclusive.

Defined results: null counts as empty, an empty text has no span; ids may repeat
or be null (a row each); an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import map_slices, table, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "local_phone")
CONTEXT = 40
THRESHOLD = 0.6

_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Words that make a kind likelier when they stand near a span.
CONTEXT_WORDS = {
    "email": re.compile(r"\b(?:e-?mail|contact|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|visa|mastercard|payment|karte|tarjeta|carte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|tel[ée]fono|t[ée]l[ée]phone)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|cuenta|compte)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
    "local_phone": re.compile(r"\b(?:phone|tel|call|mobile|fax)\b", re.I),
}
#: Score of a valid span, and what a passed checksum and context add.
SCORES = {"email": (0.8, 0.0, 0.1), "ip": (0.6, 0.0, 0.2), "card": (0.4, 0.4, 0.2), "phone": (0.6, 0.0, 0.2),
          "iban": (0.3, 0.5, 0.2), "ssn": (0.4, 0.0, 0.4), "local_phone": (0.4, 0.0, 0.4)}
_HAS_CHECKSUM = {"card", "iban"}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part reaches back from an @ over its characters, as far as the
    last match's end; every @ is looked at once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start, last = at, max(end, 0)
        while start > last and text[start - 1] in _LOCAL_PART:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Every four parts of a dotted run of numbers are a candidate."""
    for m in _DOTTED.finditer(text):
        run = m.group()
        if run.count(".") < 3:
            continue
        parts, at = run.split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + length
            at += length + 1


def _matches(text: str, kind: str) -> Iterator[tuple[int, int]]:
    if kind == "email":
        yield from _emails(text)
    elif kind == "ip":
        yield from _ips(text)
    elif kind == "card":
        for m in _DIGITS.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    yield m.span()
    elif kind == "phone":
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                yield m.span()
    elif kind == "iban":
        for m in _IBAN.finditer(text):
            if mod97(m.group().replace(" ", "")):
                yield m.span()
    elif kind == "ssn":
        yield from (m.span() for m in _SSN.finditer(text))
    else:
        yield from (m.span() for m in _LOCAL_PHONE.finditer(text))


def _score(text: str, kind: str, start: int, end: int) -> float:
    base, checksum, context = SCORES[kind]
    near = text[max(0, start - CONTEXT):start] + " \x00 " + text[end:end + CONTEXT]
    return base + checksum * (kind in _HAS_CHECKSUM) + context * bool(CONTEXT_WORDS[kind].search(near))


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text, by kind as listed, then start."""
    has_digit = any(d in text for d in "0123456789")
    out = []
    for kind in BASE_KINDS + ADDED_KINDS:
        if (kind == "email" and "@" not in text) or (kind == "phone" and "+" not in text) or (
                kind != "email" and not has_digit):
            continue
        for start, end in _matches(text, kind):
            score = _score(text, kind, start, end)
            if kind in BASE_KINDS or score >= THRESHOLD:
                out.append((kind, start, end, score))
    return out


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and its spans (kind, start, end, score)."""
    def per_slice(ids, texts):
        return ids, [[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t)] for t in texts]

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(F.col(id_col), text_of(F.col(text_col)).alias("text")), per_slice,
                      f"`{id_col}` {id_type}, spans array<struct<kind:string,start:bigint,`end`:bigint,score:double>>")


def op1_pii(spark, sf_dir):
    spans = pii_spans(table(spark, sf_dir, "documents"))
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return spans.select("doc_id", *map(count, BASE_KINDS),
                        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def sha256_of(spans: list[tuple]) -> str:
    """The digest of base spans as the query states it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans if k in BASE_KINDS).encode()).hexdigest()
