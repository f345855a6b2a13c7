"""Regions of a page: where the layout changes from top to bottom, what each band is, and its text in reading order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quire.pages import columns as C
from quire.pages import tables as T
from quire.pages.geometry import Part, Row, extent, row_gaps, split_rows, upper_median

# fixed values: shares of the width, sizes and points
GAP, GAP_LEAST, GAP_DEFAULT = 2.25, 24.0, 12.0
FULL, FULL_MAJORITY = 0.58, 0.65
MARK_CHARS, MARK = 2, 0.08
INNER, INNER_LEAST = 0.08, 20.0
SAME, SAME_LEAST, SAME_FONT = 0.04, 12.0, 1.35
LEAD = 1.6
BREAK_LEAST, BREAK_MOST, BREAK, RUN, BESIDE = 42.0, 80.0, 1.75, 3, 0.45
WIDE_OVERLAP = 0.7
HEAD_GAP, HEAD_GAP_LEAST, HEAD_SHORT = 1.55, 18.0, 0.75
COMPACT = 0.72
DEPTH = 2
PLAIN = 0.9

COLUMN_TYPES = frozenset({"multi-column-blocks", "side-by-side-tables", "nested-columns", "column-blocks", "columns"})
_OPEN_WORD = re.compile(r"[^\W\d_]-\Z")


@dataclass(slots=True)
class Region:
    type: str
    rows: list[Row]
    splits: list[float] = field(default_factory=list)
    #: splits inside the columns, from left to right
    inner: list[float] = field(default_factory=list)
    column_count: int = 1

    @property
    def all_splits(self) -> list[float]:
        return sorted({*self.splits, *self.inner})

    @property
    def top(self) -> float:
        return self.rows[0].y

    @property
    def bottom(self) -> float:
        return self.rows[-1].y


@dataclass(slots=True)
class Page:
    layout: str
    column_count: int
    table_rows: int
    confidence: float
    text: str
    regions: list[Region]


def join_blocks(blocks: list[str]) -> str:
    """Blocks with blank lines between; a hyphen before a block that starts in lower case joins its word.  Blank blocks are left out."""
    out = ""
    for block in blocks:
        block = block.strip()
        if not block:
            continue
        if not out:
            out = block
        elif _OPEN_WORD.search(out) and block[0].islower():
            out = out[:-1] + block
        else:
            out += "\n\n" + block
    return out


class _Reader:
    """What stands where on one page, in relation to its split."""

    def __init__(self, rows: list[Row], split: float | None):
        self.rows, self.split = rows, split
        low, high = extent(rows)
        self.width = high - low
        self.gap = max(GAP_LEAST, GAP * upper_median(row_gaps(rows), GAP_DEFAULT))
        self.usual = upper_median(row_gaps(rows), GAP_DEFAULT)

    def crosses(self, part: Part) -> bool:
        """Whether the part runs across the split without a gap inside, over much of the width."""
        if part.x_min >= self.split or part.x_max <= self.split + max(C.ACROSS_LEAST, C.ACROSS * self.width) or part.width < FULL * self.width:
            return False
        return all(b.x - a.end <= max(INNER_LEAST, INNER * self.width) for a, b in zip(part.atoms, part.atoms[1:]))

    def kind(self, row: Row) -> str:
        """full, left, right or both."""
        if self.split is None:
            return "full"
        if len(row.parts) == 1:
            part = row.parts[0]
            middle = (part.x_min + part.x_max) / 2
            if len(part.text) <= MARK_CHARS and part.width <= MARK * self.width and abs(middle - self.split) <= MARK * self.width:
                return "full"
        if any(map(self.crosses, row.parts)):
            return "full"
        right = [p.x_min >= self.split for p in row.parts]
        return "right" if all(right) else "both" if any(right) else "left"

    def same_column(self, part: Part, others: list[Part]) -> bool:
        """Whether a part begins where the last of the others does, in a like size."""
        if not others:
            return False
        last = others[-1]
        sizes = sorted((part.size, last.size))
        return abs(part.x_min - last.x_min) <= max(SAME_LEAST, SAME * self.width) and sizes[1] <= SAME_FONT * sizes[0]

    def three_from(self, at: int) -> C.Columns | None:
        """The three columns that a band of rows, which begins here, shares."""
        if len(self.rows[at].parts) < 3:
            return None
        ahead = [self.rows[at]]
        for r in self.rows[at + 1 : at + 8]:
            if ahead[-1].y - r.y > self.gap:
                break
            ahead.append(r)
        return C.three_columns(ahead) if sum(len(r.parts) >= 3 for r in ahead) >= 3 else None


def _fits(row: Row, starts: list[float], near: float) -> bool:
    return all(any(abs(p.x_min - s) <= near for s in starts) for p in row.parts)


def segment(rows: list[Row], split: float | None) -> list[list[Row]]:
    """Rows from top to bottom in bands: a wide gap or a change of the mode begins a new one.

    Modes are full, columns and three.  A row that runs across the split goes on
    with its column if it begins where that does and both columns are there; a
    band of right-hand rows joins the columns below that go on with it, and
    left-hand rows that stand off above columns are a band of their own.
    """
    see = _Reader(rows, split)
    near = 2 * C.anchor_tolerance(see.width)
    out: list[list[Row]] = []
    modes: list[str] = []
    starts: list[float] = []
    left: list[Part] = []
    right: list[Part] = []
    for i, row in enumerate(rows):
        three = see.three_from(i)
        kind = see.kind(row)
        gap = rows[i - 1].y - row.y if i else None
        mode = "three" if three else "full" if kind == "full" else "columns"
        fresh = gap is None or gap > see.gap
        if not fresh and modes[-1] == "three":
            if three or _fits(row, starts, near):
                mode = "three"
            else:
                fresh = True
        elif not fresh and mode == "three":
            # a heading right above belongs to the cards
            if all(len(r.parts) == 1 for r in out[-1]) and len(out[-1]) <= 2 and abs(out[-1][-1].x_min - row.x_min) <= max(SAME_LEAST, SAME * see.width):
                modes[-1] = "three"
            else:
                fresh = True
        elif not fresh and mode != modes[-1]:
            goes_on = modes[-1] == "columns" and left and right and see.same_column(row.parts[0], left)
            if mode == "full" and goes_on and not _full_band(see, rows, i):
                mode, kind = "columns", "left"
            else:
                fresh = True
        if fresh:
            out.append([])
            modes.append(mode)
            left, right = [], []
        if three:
            starts = [p.x_min for p in row.parts]
        out[-1].append(row)
        for p in row.parts:
            (left if split is None or p.x_min < split or kind == "left" else right).append(p)
    return _joined(see, out, modes) if split is not None else out


def _full_band(see: _Reader, rows: list[Row], at: int) -> bool:
    """Whether three rows from here on run across the split and no right-hand row follows closely."""
    run = 0
    for a, r in zip(rows[at - 1 :], rows[at:]):
        if a.y - r.y > see.gap:
            break
        if see.kind(r) in ("right", "both"):
            return False
        run += see.kind(r) == "full"
    return run >= 3


def _runs(rows: list[Row], limit: float) -> list[list[Row]]:
    """Rows of one side in runs that no gap beyond the limit breaks; short ones are left out."""
    out: list[list[Row]] = []
    for r in rows:
        if out and out[-1][-1].y - r.y <= limit:
            out[-1].append(r)
        else:
            out.append([r])
    return [run for run in out if len(run) >= RUN]


def beside(left: list[Row], right: list[Row], gap: float) -> tuple[list[Row], list[Row]] | None:
    """The runs of the two sides that stand beside each other most: by shared height and rows; the first of equals."""
    limit = max(BREAK_LEAST, min(BREAK_MOST, BREAK * gap))
    best = None
    for a in _runs(left, limit):
        for b in _runs(right, limit):
            shared = min(a[0].y, b[0].y) - max(a[-1].y, b[-1].y)
            shorter = min(a[0].y - a[-1].y, b[0].y - b[-1].y)
            if shared <= 0 or shared < BESIDE * shorter:
                continue
            score = shared * min(len(a), len(b))
            if best is None or score > best[0]:
                best = (score, a, b)
    return best and best[1:]


def _joined(see: _Reader, bands: list[list[Row]], modes: list[str]) -> list[list[Row]]:
    out: list[list[Row]] = []
    for i, band in enumerate(bands):
        kinds = [see.kind(r) for r in band]
        if modes[i] == "columns" and {"left", "both"} & set(kinds) and {"right", "both"} & set(kinds):
            first = next(k for k, kind in enumerate(kinds) if kind != "left")
            if 0 < first and band[first - 1].y - band[first].y > LEAD * see.usual:
                out.append(band[:first])
                band = band[first:]
            elif out and modes[i - 1] == "columns" and all(see.kind(r) == "right" for r in out[-1]):
                left, right = split_rows(out[-1] + band, see.split)
                found = beside(left, right, see.gap)
                own = next(p for r in band for p in r.parts if p.x_min >= see.split)
                if found and found[1][0].y >= out[-1][-1].y and see.same_column(own, [out[-1][-1].parts[0]]):
                    band = out.pop() + band
        out.append(band)
    return out


def _detached_heading(rows: list[Row], shared: list[int]) -> bool:
    """Whether the first row of three cells stands off from the next and is shorter."""
    if len(shared) < 3:
        return False
    first, second = rows[shared[0]], rows[shared[1]]
    usual = upper_median([rows[a].y - rows[b].y for a, b in zip(shared[1:], shared[2:])])
    length = lambda r: sum(len(p.text) for p in r.parts)
    return first.y - second.y >= max(HEAD_GAP_LEAST, HEAD_GAP * usual) and length(first) < HEAD_SHORT * length(second)


def _columns_from(rows: list[Row], splits: list[float]) -> list[list[tuple[int, Part]]]:
    """For each column its (row number, part)."""
    out: list[list[tuple[int, Part]]] = [[] for _ in range(len(splits) + 1)]
    for i, r in enumerate(rows):
        for p in r.parts:
            out[sum(p.x_min >= s for s in splits)].append((i, p))
    return out


def _compact_heading(found: list[list[tuple[int, Part]]]) -> bool:
    """Whether every column begins with a line far shorter than the next ones."""

    def short(column: list[tuple[int, Part]]) -> bool:
        body = [len(p.text) for _, p in column[1:4]]
        return bool(body) and len(column[0][1].text) < COMPACT * sum(body) / len(body)

    return all(map(short, found))


def _staggered(found: list[list[tuple[int, Part]]]) -> bool:
    """Whether columns begin within a row of each other and all end in different rows."""
    firsts, lasts = [c[0][0] for c in found], [c[-1][0] for c in found]
    return max(firsts) - min(firsts) <= 1 and len(set(lasts)) >= 3


def _three(rows: list[Row]) -> C.Columns | None:
    """Three columns that are read one after the other, and no table."""
    found = C.three_columns(rows)
    if found is None:
        return None
    shared = [i for i, r in enumerate(rows) if len(r.parts) >= 3]
    body = rows[shared[0] :] if shared else rows
    cells = _columns_from(body, found.splits)
    if len(shared) < 2 or not all(cells):
        return None
    if T.table_of(rows) is None or _detached_heading(rows, shared) or _compact_heading(cells) or _staggered(cells):
        return found
    return None


def classify(rows: list[Row], split: float | None, width: float, see: _Reader | None = None) -> Region:
    """What a band is; the first kind that fits, in the order of the types."""
    three = _three(rows)
    if three:
        return Region("multi-column-blocks", rows, three.splits, column_count=3)
    table = T.table_of(rows)
    if split is not None:
        see = see or _Reader(rows, split)
        left, right = split_rows(rows, split)
        kinds = [see.kind(r) for r in rows]
        both = sum(k == "both" for k in kinds)
        full = sum(k == "full" for k in kinds)
        wide = table is not None and table.anchors >= T.WIDE and both >= WIDE_OVERLAP * len(rows)
        if left and right and full < FULL_MAJORITY * len(rows):
            if T.side_by_side(left, right):
                return Region("side-by-side-tables", rows, [split], column_count=2)
            if not wide and C.parallel(left, right) and not any(len(r.parts) >= 3 for r in rows if len(rows) == 1):
                enough = min(len(left), len(right)) >= C.MIN_LINES
                inner = [C.nested_splits(half) for half in (left, right)] if enough else [[], []]
                if any(inner):
                    return Region("nested-columns", rows, [split], sorted(inner[0] + inner[1]), max(2, *(len(x) + 1 for x in inner if x)))
                return Region("columns" if enough else "column-blocks", rows, [split], column_count=2)
    return Region("table" if table else "full-width", rows)


def _read_columns(rows: list[Row], splits: list[float], depth: int) -> list[str]:
    """Blocks of one column after the other; what has columns of its own is read by its bands."""
    out: list[str] = []
    rest = rows
    for split in [*splits, float("inf")]:
        own, rest = split_rows(rest, split)
        inner = C.nested_splits(own) if depth < DEPTH else []
        if inner:
            for band in C.bands(own):
                out += _read_columns(band, inner, DEPTH)
        else:
            out.append(T.cells_text(own) if depth < DEPTH and T.table_of(own) else T.plain_text(own))
    return out


def render(region: Region) -> str:
    if region.type == "multi-column-blocks":
        first = next(i for i, r in enumerate(region.rows) if len(r.parts) >= 3)
        blocks = [T.cells_text(region.rows[:first])]
        found = _columns_from(region.rows[first:], region.splits)
        return join_blocks(blocks + ["\n".join(p.text for _, p in column) for column in found])
    if region.type == "side-by-side-tables":
        return join_blocks([T.records_text(half) for half in split_rows(region.rows, region.splits[0])])
    if region.type in COLUMN_TYPES:
        return join_blocks(_read_columns(region.rows, region.splits, 0 if region.type == "nested-columns" else DEPTH))
    return T.cells_text(region.rows) if region.type == "table" else T.plain_text(region.rows)


def regions_of(rows: list[Row], found: C.Columns | None) -> list[Region]:
    """The page's regions from top to bottom; without columns the middle of the page parts left from right."""
    if not rows:
        return []
    low, high = extent(rows)
    split = found.splits[0] if found and len(found.splits) == 1 else None
    see = _Reader(rows, split)
    if split is None:
        return [classify(band, (low + high) / 2 if found is None else None, high - low) for band in segment(rows, None)]
    return [classify(band, split, see.width, see) for band in segment(rows, split)]


def diagnose(rows: list[Row]) -> list[Region]:
    """Regions of a page for its diagnosis, whatever its layout."""
    return regions_of(rows, C.two_columns(rows))


def analyse(rows: list[Row]) -> Page:
    """Layout and text of a page."""
    if not rows:
        return Page("empty", 0, 0, 0.0, "", [])
    table, found = T.table_of(rows), C.two_columns(rows)
    three = _three(rows)
    wide = table is not None and table.anchors >= T.WIDE
    if found and wide and not three:
        left, right = C.sides(rows, found.splits[0])
        if len(left & right) >= WIDE_OVERLAP * len(rows) and not T.side_by_side(*split_rows(rows, found.splits[0])):
            found = None
    if found or three:
        regions = regions_of(rows, found)
        kinds = [r.type in COLUMN_TYPES for r in regions]
        if any(kinds):
            sure = max(c.confidence for c in (found, three) if c)
            n_table = sum(len(r.rows) for r in regions if r.type == "table")
            return Page("columns" if all(kinds) else "mixed", max(r.column_count for r in regions), n_table, sure, join_blocks([render(r) for r in regions]), regions)
    if table:
        return Page("table", 1, table.rows, table.confidence, T.cells_text(rows), [Region("table", rows)])
    return Page("plain", 1, 0, PLAIN, T.plain_text(rows), [Region("full-width", rows)])
