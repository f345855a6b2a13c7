"""Text of content-stream commands beside the text that a parser decoded for them."""

from __future__ import annotations

import json
import re

import numpy as np

from quire.pages.bulk import steps

# fixed values: operators that show text, and those that set a new position
SHOWS = ("Tj", "TJ", "'", '"')
RUNS = ("Tj", "TJ")
PLACES = ("BT", "ET", "Td", "TD", "Tm", "T*", "'", '"')
#: UTF-8 read as Latin-1
MOJIBAKE = re.compile("(?:Ã.|Â.|â[\u0080-¿])")
LONG_HEX, HEX_GROUP = 16, 4
#: as far as a run may lie from where the one before started, to go on from it
NEAR = 0.5
_HEX = re.compile(r"[0-9A-Fa-f]+\Z")


def shown(operand) -> str:
    """Text of an operand, however deep its lists: strings count, numbers between them do not."""
    if isinstance(operand, str):
        return operand
    if isinstance(operand, list):
        return "".join(map(shown, operand))
    if isinstance(operand, dict):
        return shown(operand.get("c")) if operand.get("t") in ("(", "<") else ""
    return ""


def shown_json(text: str | None) -> str:
    """As ``shown``, of an operand that is written as JSON; other text stands for itself."""
    try:
        return shown(json.loads(text)) if text is not None else ""
    except ValueError:
        return text


def usable(raw: bytes, decoded: str | None) -> bool:
    """Whether a command's own bytes say more than the text that its font decodes to."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return usable_text(text, decoded)


def usable_text(text: str, decoded: str | None) -> bool:
    if not text.isascii() and MOJIBAKE.search(text) and not MOJIBAKE.search(decoded or ""):
        return False
    if len(text) >= HEX_GROUP and _HEX.match(text):
        if len(text) >= LONG_HEX and len(text) % 2 == 0 and not _HEX.match(decoded or ""):
            return False
        if len(text) % HEX_GROUP == 0 and not (decoded is not None and decoded.isascii()):
            return False
    return True


def chosen(raw: bytes | None, operand: str | None, decoded: str | None) -> str | None:
    """The text of an entry: its command's bytes, or else its operand, if usable."""
    try:
        text = shown_json(operand) if raw is None else raw.decode("utf-8")
        if raw is None and not text.isascii():
            text.encode()
    except UnicodeError:
        return decoded
    return text if usable_text(text, decoded) else decoded


def goes_on(page: np.ndarray, number: np.ndarray, shows: np.ndarray, runs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each command, in order, whether it goes on from the last show of its page: it is a run and no position was set since."""

    def before(flags: np.ndarray) -> np.ndarray:
        at = np.maximum.accumulate(np.where(flags, np.arange(len(page)), -1))
        at = np.append(-1, at[:-1])[: len(page)]
        return np.where((at >= 0) & (page[at] == page), number[at], -1) if len(page) else at

    shown = before(shows)
    return runs & (shown >= 0) & (shown > before(places))


def carried(kept: tuple[np.ndarray, np.ndarray], raw: tuple[np.ndarray, np.ndarray], flags: np.ndarray) -> np.ndarray:
    """For each kept entry (page, entry_idx), in order, the flag of the same raw entry where both have the same entry before them."""
    if not len(raw[0]) or not len(kept[0]):
        return np.zeros(len(kept[0]), bool)
    keys = [(page.astype(np.int64) << 33) + index + (1 << 31) for page, index in (kept, raw)]
    first = [np.append(True, page[1:] != page[:-1]) for page, _ in (kept, raw)]
    before = [np.append(-1, key[:-1]) for key in keys]
    at = np.minimum(np.searchsorted(keys[1], keys[0]), len(keys[1]) - 1)
    return (keys[1][at] == keys[0]) & flags[at] & ~first[0] & ~first[1][at] & (before[0] == before[1][at])


def advanced(page: np.ndarray, index: np.ndarray, goes: np.ndarray, x: np.ndarray, y: np.ndarray, advance: np.ndarray) -> np.ndarray:
    """Where each entry, in order, starts: its chain's first place and the advances since, summed up from there."""
    linked = np.zeros(len(page), bool)
    near = lambda v: np.abs(v[1:] - v[:-1]) <= NEAR
    linked[1:] = goes[1:] & (page[1:] == page[:-1]) & (index[1:] == index[:-1] + 1) & near(y) & near(x)
    chain = np.cumsum(~linked)
    out, moved = x.astype(np.float64), None
    for m, at in steps(chain):
        if moved is None:
            start, moved = x[at], np.zeros(m)
            continue
        moved = moved[:m] + advance[at - 1]
        out[at] = start[:m] + moved
    return out


def continuations(operators: list[str]) -> list[bool]:
    """For each showing command whether it goes on from the one before, without a new position between."""
    out, reset = [], True
    for op in operators:
        if op in SHOWS:
            out.append(op in RUNS and not reset)
            reset = False
        elif op in PLACES:
            reset = True
    return out
