"""Reading many pages at once: what ``geometry`` and ``overlap`` do with objects, over arrays of the entries of a batch of pages.

Rules that go from entry to entry are followed one place further at a time, on
all pages (rows) of the batch together, so results are those of a page alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.pages import overlap
from quire.pages.geometry import CENTRE, GLYPH, LEAST_GLYPH, LEAST_PART, LEAST_ROW, PART, ROW, SKEW, _TIGHT

_CENT = Decimal("0.01")


@dataclass(slots=True)
class Runs:
    """Upright, non-blank entries; ``at`` is the place of each among those given, equal texts have equal codes."""

    page: np.ndarray
    at: np.ndarray
    index: np.ndarray
    x: np.ndarray
    y: np.ndarray
    size: np.ndarray
    h_scale: np.ndarray
    v_scale: np.ndarray
    centre: np.ndarray
    text: pa.Array
    code: np.ndarray

    def take(self, order: np.ndarray) -> Runs:
        return Runs(*(v.take(pa.array(order)) if isinstance(v, pa.Array) else v[order] for v in (getattr(self, n) for n in self.__slots__)))

    @property
    def end(self) -> np.ndarray:
        return self.x + np.maximum(LEAST_GLYPH * self.size, GLYPH * self.size * pc.utf8_length(self.text).to_numpy(zero_copy_only=False))


def numbers(column: pa.Array, kind=np.float64) -> np.ndarray:
    if column.null_count:
        raise TypeError("an entry has no place")
    return column.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each value the number of its first appearance among different ones, and these."""
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Codes of pairs of codes."""
    return _codes(pa.array(a * (int(b.max(initial=0)) + 1) + b))[0]


def _hypot(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.where(v == 0, np.abs(u), np.abs(v))
    for i in np.flatnonzero((u != 0) & (v != 0)).tolist():
        out[i] = math.hypot(u[i], v[i])
    return out


def runs(page: np.ndarray, get: Callable[[str], pa.Array], trim: Callable[[pa.Array], pa.Array] = pc.utf8_trim_whitespace) -> Runs:
    """As ``geometry.atom_of``, of the entries whose fields ``get`` gives, in order of page and entry_idx."""
    a, b, c, d, x, y = (numbers(get(n)) for n in "abcdxy")
    text = trim(pc.fill_null(get("text"), ""))
    kept = np.flatnonzero(~((np.abs(b) > SKEW * np.abs(a)) | (np.abs(c) > SKEW * np.abs(d))) & (pc.binary_length(text).to_numpy(zero_copy_only=False) > 0))
    index = numbers(get("entry_idx"), np.int64)
    if len(kept) and ((np.diff(page[kept]) < 0) | ((np.diff(page[kept]) == 0) & (np.diff(index[kept]) < 0))).any():
        kept = kept[np.lexsort((index[kept], page[kept]))]
    if len(kept) < len(page) or (np.diff(kept) != 1).any():
        page, index, a, b, c, d, x, y = (v[kept] for v in (page, index, a, b, c, d, x, y))
        text = text.take(pa.array(kept))
    declared = get("font_size").take(pa.array(kept))
    missing = declared.is_null().to_numpy(zero_copy_only=False)
    declared, height = np.abs(pc.fill_null(declared, 1.0).to_numpy(zero_copy_only=False)), np.abs(d)
    size = np.where(missing, np.maximum(1.0, height), np.where((declared <= 1.01) & (height > 1.01), height, np.maximum(1.0, declared)))
    h_scale = np.maximum(0.01, declared * np.maximum(0.01, _hypot(a, b)))
    v_scale = np.maximum(0.01, declared * np.maximum(0.01, _hypot(c, d)))
    return Runs(page, kept, index, x, y, size, h_scale, v_scale, y + CENTRE * v_scale, text, _codes(text)[0])


def printed(value: float) -> str:
    return f"{value:.2f}"


def half_up(value: float) -> float:
    """To two digits, halves of what the number is written as away from zero, as Spark's ``round``."""
    return float(Decimal(repr(value)).quantize(_CENT, ROUND_HALF_UP)) + 0.0 if math.isfinite(value) else value


def _places(values: np.ndarray, rounded: Callable) -> np.ndarray:
    bits, different = _codes(pa.array(values.view(np.int64)))
    made = pa.array([rounded(v) for v in different.to_numpy().view(np.float64).tolist()])
    return _codes(made)[0][bits]


def firsts(found: Runs, rounded: Callable = printed) -> Runs:
    """Of overprinted copies, one text of a page at one rounded place, the first."""
    same = _paired(found.page, found.code)
    twice = np.flatnonzero(np.bincount(same)[same] > 1) if len(same) else same
    if not len(twice):
        return found
    key = _paired(_paired(same[twice], _places(found.x[twice], rounded)), _places(found.y[twice], rounded))
    # codes count up with what appears first
    again = key[1:] <= np.maximum.accumulate(key)[:-1]
    gone = twice[1:][again]
    return found.take(np.delete(np.arange(len(found.page)), gone)) if len(gone) else found


def steps(group: np.ndarray):
    """(how many, places): for 0, 1, ... the places of the members of that number of each group that has one, longest groups first."""
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if len(group) else np.zeros(0, np.int64)
    lengths = np.diff(starts, append=len(group))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
    for k, m in enumerate(live.tolist()):
        yield m, starts[:m] + k


def row_starts(found: Runs) -> np.ndarray:
    """Which entries, in reading order, start an optical row; as ``geometry.rows_of``."""
    out = np.ones(len(found.page), bool)
    mean = top = n = None
    for m, at in steps(found.page):
        c, v = found.centre[at], found.v_scale[at]
        if mean is None:
            mean, top, n = c, v, np.ones(m)
            continue
        mean, top, n = mean[:m], top[:m], n[:m]
        joins = np.abs(c - mean) <= np.maximum(LEAST_ROW, ROW * np.minimum(top, v))
        n = np.where(joins, n + 1, 1)
        mean, top = np.where(joins, mean + (c - mean) / n, c), np.where(joins, np.maximum(top, v), v)
        out[at] = ~joins
    return out


def part_starts(row: np.ndarray, x: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which entries, from left to right in each row, start a part; as ``geometry.parts_of``."""
    out = np.ones(len(row), bool)
    last = most = None
    for m, at in steps(row):
        if last is None:
            last, most = end[at], size[at]
            continue
        last, most = last[:m], most[:m]
        cut = x[at] - last > np.maximum(LEAST_PART, PART * np.maximum(size[at], most))
        last, most = np.maximum(last, end[at]), np.where(cut, size[at], np.maximum(most, size[at]))
        out[at] = cut
    return out


def _joined(pieces: pa.Array, starts: np.ndarray) -> pa.Array:
    offsets = pa.array(np.append(starts, len(pieces)).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pieces), "")


def visual_rows(page: np.ndarray, get: Callable[[str], pa.Array]) -> tuple[np.ndarray, list[pa.Array]]:
    """(page, [row_no, y, text, parts]) of the optical rows of each page; of none an empty list."""
    found = firsts(runs(page, get))
    found = found.take(np.lexsort((found.index, found.x, -found.centre, found.page)))
    if not len(found.page):
        return found.page, []
    row = np.cumsum(row_starts(found))
    found = found.take(np.lexsort((found.x, row)))
    first = np.flatnonzero(np.diff(row, prepend=0))
    end = found.end
    begins = part_starts(row, found.x, end, found.size)
    part = np.flatnonzero(begins)
    tight = pc.is_in(pc.utf8_slice_codeunits(found.text, 0, 1), pa.array(sorted(_TIGHT))).to_numpy(zero_copy_only=False) | pc.equal(found.text, "-").to_numpy(zero_copy_only=False)
    tight[1:] |= pc.ends_with(found.text, "-").to_numpy(zero_copy_only=False)[:-1]
    between = np.where(begins | tight, 0, 1)
    whole = between.copy()
    whole[part] = 2
    whole[first] = 0
    signs = pa.array(["", " ", " | "])
    pieces = lambda sign: pc.binary_join_element_wise(signs.take(pa.array(sign)), found.text, "")
    parts = pa.StructArray.from_arrays([pa.array(found.x[part]), pa.array(np.maximum.reduceat(end, part)), pa.array(np.maximum.reduceat(found.size, part)), _joined(pieces(between), part)], ["x_min", "x_max", "size", "text"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(part, first), len(part)).astype(np.int32)), parts)
    pages = found.page[first]
    number = np.arange(len(first)) - np.searchsorted(pages, pages) + 1
    return pages, [pa.array(number.astype(np.int32)), pa.array(np.maximum.reduceat(found.y, first)), _joined(pieces(whole), first), lists]


def overlaps(page: np.ndarray, get: Callable[[str], pa.Array], most: int) -> tuple[np.ndarray, list[pa.Array]]:
    """(page, [first, second, overlap, number]) as ``overlap.pairs``."""
    found = runs(page, get)
    found = found.take(np.lexsort((found.y, found.page)))
    reach = np.maximum(overlap.Y_LEAST, overlap.Y_NEAR * found.size)
    end, every = found.end, []
    left, k = np.arange(len(found.page)), 0
    while len(left):
        k += 1
        left = left[left + k < len(found.page)]
        right = left + k
        left = left[(found.page[right] == found.page[left]) & (found.y[right] - found.y[left] <= reach[left])]
        right = left + k
        least = np.minimum(found.size[left], found.size[right])
        near = (found.code[left] != found.code[right]) & (np.abs(found.y[left] - found.y[right]) <= np.maximum(overlap.Y_LEAST, overlap.Y_NEAR * least))
        near &= np.abs(found.x[left] - found.x[right]) <= np.maximum(overlap.X_LEAST, overlap.X_NEAR * least)
        a, b = left[near], right[near]
        share = (np.minimum(end[a], end[b]) - np.maximum(found.x[a], found.x[b])) / np.maximum(1.0, np.minimum(end[a] - found.x[a], end[b] - found.x[b]))
        much = share >= overlap.COVERED
        every.append((a[much], b[much], share[much]))
    a, b, share = (np.concatenate(v) for v in zip(*every)) if every else (left, left, np.zeros(0))
    pages, first, second = found.page[a], np.minimum(found.index[a], found.index[b]), np.maximum(found.index[a], found.index[b])
    apart = ~_one_run(page, get, pages, first, second)
    pages, first, second, share = (v[apart] for v in (pages, first, second, share))
    order = np.lexsort((share, second, first, pages))
    pages, first, second, share = (v[order] for v in (pages, first, second, share))
    number = np.arange(len(pages)) - np.searchsorted(pages, pages) + 1
    kept = number <= most
    percent = [round(100 * s, 1) for s in share[kept].tolist()]
    return pages[kept], [pa.array(first[kept].astype(np.int32)), pa.array(second[kept].astype(np.int32)), pa.array(percent, "float64"), pa.array(number[kept].astype(np.int32))]


def _one_run(page: np.ndarray, get: Callable[[str], pa.Array], pages: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether every entry_idx after the first, up to the second, is one of an entry that goes on; of one given twice the last counts."""
    key = lambda p, i: (p << 33) + i + (1 << 31)
    flags = get("continues")
    told = np.flatnonzero(flags.is_valid().to_numpy(zero_copy_only=False))
    at = key(page, numbers(get("entry_idx"), np.int64))[told]
    order = np.argsort(at, kind="stable")
    at, goes = at[order], pc.fill_null(flags, False).to_numpy(zero_copy_only=False)[told][order]
    at = at[goes & np.append(at[1:] != at[:-1], True)[: len(at)]]
    return np.searchsorted(at, key(pages, second), "right") - np.searchsorted(at, key(pages, first), "right") == second - first
