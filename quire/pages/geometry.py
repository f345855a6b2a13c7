"""Reading a page: entries become atoms, atoms optical rows, rows parts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from operator import attrgetter

# fixed values: shares of sizes, and points
SKEW = 0.2
CENTRE, ROW, LEAST_ROW = 0.3, 0.28, 1.5
GLYPH, LEAST_GLYPH = 0.58, 0.25
PART, LEAST_PART = 1.25, 10.0
DESCENT = 0.25
_TIGHT = frozenset(",.;:!?%)]}")


@dataclass(slots=True)
class Entry:
    """One show-text operation: its matrix, text and font."""

    index: int
    a: float
    b: float
    c: float
    d: float
    x: float
    y: float
    text: str
    size: float | None = None
    font: str | None = None


@dataclass(slots=True)
class Atom:
    x: float
    y: float
    size: float
    h_scale: float
    v_scale: float
    centre: float
    text: str
    index: int
    font: str | None = None
    raw: str = ""
    end: float = field(init=False, default=0.0)

    def __post_init__(self) -> None:
        self.end = self.x + estimated_width(self.text, self.size)


@dataclass(slots=True)
class Part:
    x_min: float
    x_max: float
    text: str
    atoms: list[Atom]

    @property
    def width(self) -> float:
        return self.x_max - self.x_min

    @property
    def size(self) -> float:
        return max(a.size for a in self.atoms)


@dataclass(slots=True)
class Row:
    y: float
    parts: list[Part] = field(default_factory=list)

    @property
    def x_min(self) -> float:
        return self.parts[0].x_min

    @property
    def x_max(self) -> float:
        return max(p.x_max for p in self.parts)

    @property
    def atoms(self) -> list[Atom]:
        return [a for p in self.parts for a in p.atoms]


def estimated_width(text: str, size: float) -> float:
    return max(LEAST_GLYPH * size, GLYPH * size * len(text))


def font_size(declared: float | None, height: float) -> float:
    """The size that a run is drawn in: a declared size of one stands for the matrix."""
    if declared is None:
        return max(1.0, abs(height))
    declared = abs(declared)
    if declared <= 1.01 and abs(height) > 1.01:
        return abs(height)
    return max(1.0, declared)


def atom_of(e: Entry) -> Atom | None:
    """The entry's atom; None if it is turned or blank."""
    if abs(e.b) > SKEW * abs(e.a) or abs(e.c) > SKEW * abs(e.d):
        return None
    text = e.text.strip()
    if not text:
        return None
    size = font_size(e.size, e.d)
    declared = 1.0 if e.size is None else abs(e.size)  # the matrix scales what is declared
    h_scale = max(0.01, declared * max(0.01, math.hypot(e.a, e.b)))
    v_scale = max(0.01, declared * max(0.01, math.hypot(e.c, e.d)))
    return Atom(e.x, e.y, size, h_scale, v_scale, e.y + CENTRE * v_scale, text, e.index, e.font, e.text)


def atoms_of(entries: Iterable[Entry]) -> list[Atom]:
    """Upright, non-blank entries in reading order; of overprinted copies the first stays."""
    seen, out = set(), []
    for e in sorted(entries, key=lambda e: e.index):
        atom = atom_of(e)
        if atom is not None and (key := (f"{atom.x:.2f}", f"{atom.y:.2f}", atom.text)) not in seen:
            seen.add(key)
            out.append(atom)
    return sorted(out, key=lambda a: (-a.centre, a.x, a.index))


def part_of(atoms: list[Atom]) -> Part:
    if len(atoms) == 1:
        return Part(atoms[0].x, atoms[0].end, atoms[0].text, atoms)
    text = before = ""
    for a in atoms:
        if text and a.text[0] not in _TIGHT and a.text != "-" and not before.endswith("-"):
            text += " "
        text += a.text
        before = a.text
    return Part(atoms[0].x, max(a.end for a in atoms), text, atoms)


_x = attrgetter("x")


def parts_of(atoms: list[Atom]) -> list[Part]:
    """Atoms of one row, from left to right, cut at wide gaps."""
    if len(atoms) == 1:
        return [part_of(atoms)]
    out: list[Part] = []
    run: list[Atom] = []
    end, size = 0.0, 0.0
    for a in sorted(atoms, key=_x):
        if run:
            if a.x - end > LEAST_PART and a.x - end > PART * (a.size if a.size > size else size):
                out.append(part_of(run))
                run, size = [], 0.0
            if a.end > end:
                end = a.end
        else:
            end = a.end
        run.append(a)
        if a.size > size:
            size = a.size
    if run:
        out.append(part_of(run))
    return out


def rows_of(atoms: list[Atom]) -> list[Row]:
    """Optical rows from top to bottom; atoms come in reading order, so only the last row can still take one."""
    groups: list[tuple[list[Atom], list[float]]] = []  # atoms, [mean centre, greatest vertical scale]
    for a in atoms:
        if groups:
            items, state = groups[-1]
            if abs(a.centre - state[0]) <= max(LEAST_ROW, ROW * min(state[1], a.v_scale)):
                items.append(a)
                state[0] += (a.centre - state[0]) / len(items)
                state[1] = max(state[1], a.v_scale)
                continue
        groups.append(([a], [a.centre, a.v_scale]))
    return [Row(max(a.y for a in items), parts_of(items)) for items, _ in groups]


def read(entries: Iterable[Entry]) -> list[Row]:
    return rows_of(atoms_of(entries))


def split_row(row: Row, inside: Callable[[Atom], bool]) -> Row:
    """The row's atoms that fit, as parts built anew; a part without atoms vanishes."""
    return Row(row.y, parts_of([a for a in row.atoms if inside(a)]))


def split_rows(rows: list[Row], at: float) -> tuple[list[Row], list[Row]]:
    """Rows left of ``at`` and rows from there on; rows without atoms on a side are left out there."""
    left, right = [], []
    for r in rows:
        parts, n = r.parts, 0
        while n < len(parts) and parts[n].x_min < at:
            n += 1
        # parts that lie on one side stay as they are, if no text from the left reaches over the first of the right
        before = not n or parts[n - 1].atoms[-1].x < at
        after = before and (not n or n == len(parts) or max([p.x_max for p in parts[:n]]) <= parts[n].atoms[0].end)
        own = Row(r.y, parts[:n]) if before else split_row(r, lambda a: a.x < at)
        other = Row(r.y, parts[n:]) if after else split_row(r, lambda a: a.x >= at)
        if own.parts:
            left.append(own)
        if other.parts:
            right.append(other)
    return left, right


def extent(rows: list[Row]) -> tuple[float, float]:
    """Least start and greatest end, the latter never below 0; (0, 0) without rows."""
    parts = [p for r in rows for p in r.parts]
    return (min(p.x_min for p in parts), max(0.0, max(p.x_max for p in parts))) if parts else (0.0, 0.0)


def width_of(rows: list[Row]) -> float:
    low, high = extent(rows)
    return max(0.0, high - low)


def upper_median(values: Iterable[float], default: float = 0.0) -> float:
    ordered = sorted(values)
    return ordered[len(ordered) // 2] if ordered else default


def clusters(values: Iterable[float], tolerance: float) -> list[tuple[float, int]]:
    """(mean, count): each value joins the first cluster whose running mean is near, or starts one."""
    out: list[list[float]] = []
    for v in values:
        for c in out:
            if abs(v - c[0]) <= tolerance:
                c[1] += 1
                c[0] += (v - c[0]) / c[1]
                break
        else:
            out.append([v, 1])
    return [(m, int(n)) for m, n in out]


def row_gaps(rows: list[Row]) -> list[float]:
    """Distances between neighbouring rows; those of half a point or less say nothing."""
    return [g for a, b in zip(rows, rows[1:]) if (g := a.y - b.y) > 0.5]
