"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Defined results: a null text counts as empty; an empty text has no spans;
repeated rows each give their row; an empty table gives an empty table; of
added spans that tie with a base span the base one stays.  Scans are linear in
the length of the text, and spans are merged in order of place, so a very long
text costs no more for its length.  Only the named columns are read; others
cannot clash, and ``redact`` keeps them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import map_text, sha256_hex

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "national", "local")
#: a proposed span of an added kind is kept from this score on
THRESHOLD = 0.5
#: characters on either side in which context words are looked for
CONTEXT = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])")
_WORDS = {
    "email": re.compile(r"\b(?:mail|e-mail|email|contact|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|ping)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|debit|karte|tarjeta|carte)\b", re.I),
    "phone": re.compile(r"\b(?:tel|phone|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|konto|cuenta|compte|bank)\b", re.I),
    "national": re.compile(r"\b(?:ssn|social security|tax id|national id)\b", re.I),
}
_WORDS["local"] = _WORDS["phone"]
#: score before context; what a checksum confirmed starts higher
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national": 0.25, "local": 0.25}
_GAIN = 0.35


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    rest = 0
    for c in compact[4:] + compact[:4]:
        rest = (rest * 10 + ord(c) - 48 if c.isdigit() else rest * 100 + ord(c) - 55) % 97
    return rest == 1


def _emails(text: str) -> Iterable[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            low = m.end()
            yield start, low
        at = text.find("@", at + 1)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four base kinds, leftmost and non-overlapping per kind, by kind as listed and then by start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _united(spans: Iterable[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans' union, in order of place."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans with their scores: base kinds always, added kinds from THRESHOLD on unless they meet a base span."""
    spans = base_spans(text)
    starts, ends = _united(spans)
    if _DIGIT.search(text):
        for kind, pattern in (("iban", _IBAN), ("national", _NATIONAL), ("local", _LOCAL_PHONE)):
            for m in pattern.finditer(text):
                if kind == "iban" and not mod97(m[0]):
                    continue
                at = bisect_left(starts, m.end()) - 1  # the last that starts before this one ends
                if at < 0 or ends[at] <= m.start():
                    spans.append((kind, m.start(), m.end()))
    out = []
    for kind, start, end in spans:
        near = text[max(0, start - CONTEXT) : start] + "\n" + text[end : end + CONTEXT]
        score = min(1.0, _PRIOR[kind] + (_GAIN if _WORDS[kind].search(near) else 0.0))
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append((kind, start, end, score))
    return out


def join_spans(spans: Iterable[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def redact_text(text: str) -> str:
    """Replaces each run of overlapping spans by the upper-cased kind of its first span in angle brackets."""
    spans = sorted((s, e, k) for k, s, e, _ in find(text))
    if not spans:
        return text
    parts, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        parts += [text[at:start], f"<{kind.upper()}>"]
        at, i = end, i + 1
    return "".join(parts) + text[at:]


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, entities array<struct<kind,start,end,score>>: every span of every whole text, in code points."""
    entity = "array<struct<kind:string,start:int,end:int,score:double>>"

    def one(t: str) -> tuple:
        return ([{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find(t)],)

    return map_text(docs, key, text, one, [("entities", entity)])


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    def one(t: str) -> tuple:
        spans = find(t)
        base = [s for s in spans if s[0] in BASE_KINDS]
        counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
        return (*counts, sha256_hex(join_spans(base).encode()), join_spans(spans))

    return map_text(docs, key, text, one, [("n_email", "long"), ("n_ip", "long"), ("n_card", "long"), ("n_phone", "long"), ("base_sha256", "string"), ("spans", "string")])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced; null texts stay null.  n_chars, if there, follows the text."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(redact_text, na_action="ignore")

    out = docs.withColumn(text, clean(F.col(text)))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
