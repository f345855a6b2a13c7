"""What a page's diagnosis shows: boxes of its texts, lines and regions, and where its texts stand in the extracted text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field, replace

from quire.pages.geometry import Atom, DESCENT, Entry, Row, atom_of, part_of, read
from quire.pages.regions import Region

# fixed values: shares of sizes, points and degrees
PAD, PAD_LEAST, PAD_MOST = 0.08, 0.75, 1.5
ASCENT, HEIGHT, HEIGHT_LEAST = 0.82, 1.02, 0.6
LINE_GAP, LINE_GAP_LEAST = 1.3, 12.0
REGION_PAD = 4.0
HUE, REGION_HUE, REGION_SHIFT = 47, 67, 190
MOVED = 0.5
_SIGN = re.compile(r"[^\W_]")
_SPLIT_WORD = re.compile(r"-[ \t]*\Z")


@dataclass(slots=True)
class Box:
    """Percent of the page, from its upper left corner."""

    left: float
    top: float
    width: float
    height: float


@dataclass(slots=True)
class Mark:
    id: str
    number: int
    text: str
    box: Box
    hue: int
    index: int = -1
    x: float = 0.0
    row: int = 0
    #: code points of the extracted text, end exclusive
    start: int | None = None
    stop: int | None = None


@dataclass(slots=True)
class Visualization:
    regions: list[Mark] = field(default_factory=list)
    lines: list[Mark] = field(default_factory=list)
    layout: list[tuple[str, Box, int]] = field(default_factory=list)
    text: str = ""
    line_text: str = ""


def percent(value: float, whole: float) -> float:
    return min(100.0, max(0.0, value / whole * 100.0)) if whole > 0 else 0.0


def _box(left: float, top: float, width: float, height: float) -> Box:
    return Box(round(left, 4), round(top, 4), round(min(width, 100.0 - left), 4), round(min(height, 100.0 - top), 4))


def drawn_width(atom: Atom, units: float | None) -> float:
    """Width by the font's own metrics (thousandths), if there are any, else by its size."""
    if units is not None and units > 0:
        return max(0.25 * atom.size, units / 1000.0 * atom.h_scale)
    return atom.end - atom.x


def text_box(x0: float, x1: float, baseline: float, height: float, size: float, page: list[float]) -> Box:
    """Box about a text from its baseline, with room on both sides."""
    room = max(PAD_LEAST, min(PAD_MOST, PAD * size))
    wide, high = page[2] - page[0], page[3] - page[1]
    return _box(percent(x0 - page[0] - room, wide), percent(high - ((baseline - page[1]) + ASCENT * height), high), percent(x1 - x0 + 2 * room, wide), max(HEIGHT_LEAST, percent(HEIGHT * height, high)))


def region_bounds(rows: list[Row]) -> tuple[float, float, float, float]:
    """left, bottom, right, top of rows, from descender to ascender."""
    atoms = [a for r in rows for a in r.atoms]
    return min(a.x for a in atoms), min(a.y - DESCENT * a.size for a in atoms), max(a.end for a in atoms), max(a.y + a.size for a in atoms)


def layout_box(region: Region, number: int, page: list[float]) -> tuple[str, Box, int]:
    """type, box and hue of a layout region."""
    left, bottom, right, top = region_bounds(region.rows)
    wide, high = page[2] - page[0], page[3] - page[1]
    box = _box(percent(left - page[0] - REGION_PAD, wide), percent(high - (top - page[1]) - REGION_PAD, high), percent(right - left + 2 * REGION_PAD, wide), percent(top - bottom + 2 * REGION_PAD, high))
    return region.type, box, (number * REGION_HUE + REGION_SHIFT) % 360


def upright(page: list[float] | None, rotate: int) -> bool:
    """Whether boxes can be placed: the page's box is known and it is not turned."""
    return bool(page) and len(page) >= 4 and rotate % 360 == 0


def moved(entries: list[Entry], units: dict[int, float], flags: dict[int, bool]) -> list[Entry]:
    """Entries whose runs go on from the one before, moved to where that ended."""
    out: list[Entry] = []
    before: tuple[Entry, float] | None = None  # the entry as recorded, and where its run ended
    for e in sorted(entries, key=lambda e: e.index):
        atom = atom_of(replace(e, text=e.text or " "))
        x = e.x
        if before and flags.get(e.index) and e.index == before[0].index + 1 and abs(e.y - before[0].y) <= MOVED and abs(e.x - before[0].x) <= MOVED:
            x = before[1]
        before = (e, x + (drawn_width(atom, units.get(e.index)) if atom else 0.0))
        out.append(replace(e, x=x))
    return out


def column_of(x: float, splits: list[float]) -> int:
    return sum(x >= s for s in splits)


def splits_at(y: float, layout: list[Region]) -> list[float]:
    """Splits of the first region that a baseline lies in."""
    return next((r.all_splits for r in layout if r.bottom <= y <= r.top), [])


def line_groups(row: Row, splits: list[float], units: dict[int, float]) -> list[list[Atom]]:
    """Atoms of a row in lines: a change of column ends one, or, without columns, a wide gap."""
    out: list[list[Atom]] = []
    end, column = 0.0, 0
    for a in sorted(row.atoms, key=lambda a: a.x):
        own = column_of(a.x, splits)
        if out and (own != column if splits else a.x - end > max(LINE_GAP_LEAST, LINE_GAP * a.size)):
            out.append([a])
            end = 0.0
        elif out:
            out[-1].append(a)
        else:
            out.append([a])
        column, end = own, max(end, a.x + drawn_width(a, units.get(a.index)))
    return out


def occurrences(text: str, needle: str) -> list[int]:
    """Places of a text; one or two signs must stand as a word, and longer ones do not overlap themselves."""
    if not needle:
        return []
    if len(needle) <= 2:
        return [m.start() for m in re.finditer(rf"(?<![^\W_]){re.escape(needle)}(?![^\W_])", text)]
    return [m.start() for m in re.finditer(re.escape(needle), text)]


def needles(text: str) -> list[str]:
    """The text, and without the hyphen that it ends with."""
    bare = _SPLIT_WORD.sub("", text)
    return [text, bare] if bare and bare != text else [text]


def match(text: str, marks: list[Mark]) -> None:
    """Sets where each mark stands in the text: the longest choose first, and none takes what another has.

    A mark keeps between its linked neighbours on the same row, if it can.
    """
    taken: list[tuple[int, int]] = []
    rows: dict[int, list[Mark]] = {}
    for m in marks:
        rows.setdefault(m.row, []).append(m)
    for m in sorted(marks, key=lambda m: (-len(m.text.encode()), m.number)):
        free = [(at, at + len(n)) for n in needles(m.text) for at in occurrences(text, n)]
        free = [(a, b) for a, b in free if all(b <= s or a >= e for s, e in taken)]
        if not free:
            continue
        linked = [o for o in rows[m.row] if o.start is not None]
        before = max((o for o in linked if o.x < m.x), key=lambda o: o.x, default=None)
        after = min((o for o in linked if o.x > m.x), key=lambda o: o.x, default=None)
        low = before.stop if before else None
        high = after.start if after else None
        between = [(a, b) for a, b in free if (low is None or a >= low) and (high is None or b <= high)] or free
        far = lambda c: (abs(c[0] - low) if low is not None else 0) + (abs(high - c[1]) if high is not None else 0)
        m.start, m.stop = min(between, key=lambda c: (far(c), c[0], -(c[1] - c[0])))
        taken.append((m.start, m.stop))


def annotate(text: str, marks: list[Mark]) -> str:
    """HTML of the text with each linked mark as an element; of marks that overlap the first stays."""
    out, at = [], 0
    for m in sorted((m for m in marks if m.start is not None), key=lambda m: (m.start, -(m.stop - m.start))):
        if m.start < at:
            continue
        out += [html.escape(text[at : m.start]), f'<mark data-region-id="{html.escape(m.id)}" style="--hue:{m.hue}">{html.escape(text[m.start : m.stop])}</mark>']
        at = m.stop
    return "".join(out) + html.escape(text[at:])


def visualize(entries: list[Entry], page: list[float] | None, rotate: int, text: str, number: int, layout: list[Region], units: dict[int, float] | None = None, flags: dict[int, bool] | None = None) -> Visualization:
    """Boxes of texts, lines and regions of a page and the extracted text with both marked; a turned page has the plain text only."""
    plain = html.escape(text)
    if not upright(page, rotate):
        return Visualization(text=plain, line_text=plain)
    units = units or {}
    rows = read(moved(entries, units, flags or {}))
    regions: list[Mark] = []
    lines: list[Mark] = []
    for n, row in enumerate(rows):
        for a in row.atoms:
            if _SIGN.search(a.text):
                k = len(regions) + 1
                regions.append(Mark(f"page-{number}-region-{k}", k, a.text, text_box(a.x, a.x + drawn_width(a, units.get(a.index)), a.y, a.v_scale, a.size, page), k * HUE % 360, a.index, a.x, n))
        for group in line_groups(row, splits_at(row.y, layout), units):
            joined = part_of(group)
            if _SIGN.search(joined.text):
                k = len(lines) + 1
                height = max(a.v_scale for a in group)
                end = max(a.x + drawn_width(a, units.get(a.index)) for a in group)
                lines.append(Mark(f"page-{number}-line-{k}", k, joined.text, text_box(joined.x_min, end, max(a.y for a in group), height, height, page), k * HUE % 360, group[0].index, joined.x_min, n))
    match(text, regions)
    match(text, lines)
    shown = sorted(layout, key=lambda r: -r.top)
    return Visualization(regions, lines, [layout_box(r, k, page) for k, r in enumerate(shown, 1)], annotate(text, regions), annotate(text, lines))
