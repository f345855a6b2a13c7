"""Text functions as Column expressions; Python only where an order-dependent fold needs it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: ligatures and what they stand for
LIGATURES = [("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl")]
_BLANK = r"[ \t\n\r\x00\x0B]"


def trim_ascii(text: Column) -> Column:
    """Trims blanks, tabs, line ends, zero bytes and vertical tabs."""
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def let(value: Column, body) -> Column:
    """Binds a value once for a body that uses it more than once, where the optimizer would repeat the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prose(lines: Column) -> Column:
    """Lines as one, words that a hyphen parts joined."""
    prose = F.array_join(F.transform(lines, trim_ascii), "\n")
    prose = F.regexp_replace(prose, r"(?<=\p{L})-[ \t]*\n[ \t]*(?=\p{Ll})", "")
    return trim_ascii(F.regexp_replace(F.translate(prose, "\n", " "), r"[ \t]+", " "))


def _structured(lines: Column) -> Column:
    """Whether two lines or more are set in columns, as a list or with bars."""
    often = lambda test: F.size(F.filter(lines, test)) >= 2
    return often(lambda s: s.rlike(r"\S[ \t]{2,}\S")) | often(lambda s: s.rlike(r"^\s*(?:[-*]|\d+[.)])\s+\S")) | often(lambda s: F.instr(s, " | ") > 0)


def _block(block: Column) -> Column:
    lines = F.transform(F.split(block, "\n"), lambda s: F.regexp_replace(s, f"{_BLANK}+$", ""))
    lines = F.filter(lines, lambda s: s.rlike(f"[^{_BLANK[1:]}"))
    return let(lines, lambda some: F.when(F.size(some) == 1, _prose(some)).when(_structured(some), F.array_join(some, "\n")).otherwise(_prose(some)))


def normalise(text: Column) -> Column:
    """Page text with plain line ends, blanks and ligatures; prose blocks become one line, structured blocks keep theirs."""
    out = F.translate(F.regexp_replace(text, "\r\n?", "\n"), "\u00a0\u202f\u00ad", "  ")
    for sign, letters in LIGATURES:
        out = F.replace(out, F.lit(sign), F.lit(letters))
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    blocks = F.split(trim_ascii(out), r"\n[ \t]*\n+")
    return F.array_join(F.filter(F.transform(blocks, _block), lambda b: b != ""), "\n\n")


def margin_text(text: Column) -> Column:
    """Text of a margin line without zero-width and soft-hyphen signs, blanks collapsed."""
    return F.trim(F.regexp_replace(F.translate(text, "\u200b\u00ad", ""), r"(?U)[\s\u00a0\u202f]+", " "))


def query_terms(query: Column) -> Column:
    """Distinct lower-cased words of two or more letters or digits, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1))


def split_list(text: Column) -> Column:
    """Entries of a comma or line separated list: trimmed, none empty, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[\r\n,]+"), lambda t: F.trim(t)), lambda t: t != ""))


def strip_tags(html: Column) -> Column:
    """Text without comments and tags; quoted attribute values may hold '>'."""
    return F.trim(F.regexp_replace(html, r"""(?s)<!--.*?-->|</?[A-Za-z!?](?:"[^"]*"|'[^']*'|[^'">])*>""", ""))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def join_blocks(blocks: Column) -> Column:
    """Blocks with blank lines between; a hyphen before a block that starts in lower case joins its word."""

    def add(done: Column, block: Column) -> Column:
        joins = done.rlike(r"\p{L}-$") & block.rlike(r"^\p{Ll}")
        return F.when(done == "", block).when(joins, F.concat(F.regexp_replace(done, "-$", ""), block)).otherwise(F.concat(done, F.lit("\n\n"), block))

    return F.aggregate(F.filter(F.transform(blocks, lambda b: F.trim(b)), lambda b: b != ""), F.lit(""), add)


def windows_of(text: str, terms: list[str], size: int, most: int) -> list[str]:
    """The ``most`` best windows of ``size`` characters about the terms, none overlapping, by place.

    Without terms or hits it is the text's start, untrimmed; with no size, the whole text.
    """
    if size <= 0:
        return [text]
    found = {max(0, m.start() - size // 2) for t in terms for m in re.finditer(re.escape(t), text, re.I)}
    if not found:
        return [text[:size]]

    def worth(at: int) -> tuple[int, int]:
        part = text[at : at + size].lower()  # scored and let go; only the chosen ones are cut in the end
        return -sum(t in part for t in terms), at

    ranked = sorted(found, key=worth)
    taken: list[int] = []
    for at in ranked:
        end = min(len(text), at + size)
        if all(at >= min(len(text), x + size) or end <= x for x in taken):
            taken.append(at)
            if len(taken) >= max(1, most):
                break
    return [text[at : at + size].strip(" \t\n\r\0\x0b") for at in sorted(taken)]


def excerpts(text: Column, query: str, size: int, most: int = 1) -> Column:
    """array<string>: ``windows_of`` each text; Arrow batches, since choosing windows is a fold."""
    terms = list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if len(t) > 1))

    @F.pandas_udf("array<string>")
    def choose(texts):
        return texts.map(lambda t: windows_of(t, terms, size, most), na_action="ignore")

    return choose(text)
