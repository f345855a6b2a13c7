"""Tables: rows of cells under shared starts, tables side by side, keys with values."""

from __future__ import annotations

from dataclasses import dataclass

from quire.pages.geometry import Part, Row, clusters, upper_median, width_of

# fixed values: counts, shares and points
MIN_ROWS, MOST_CELLS, STABLE, WIDE = 3, 8, 3, 4
NEAR, NEAR_LEAST, NEAR_MOST = 0.012, 3.0, 8.0
COVERAGE, FILL, CELL = 0.45, 0.52, 24
SIDE_NEAR = 8.0


@dataclass(slots=True)
class Table:
    rows: int
    anchors: int
    coverage: float
    confidence: float


def table_of(rows: list[Row], width: float | None = None) -> Table | None:
    """The table that rows of 2 to 8 parts form, if enough of them stand on at least two shared starts.

    Coverage is their share among the candidate rows; fill is the share of a
    row's own span that its cells take.
    """
    width = width_of(rows) if width is None else width
    cells = [r for r in rows if 2 <= len(r.parts) <= MOST_CELLS]
    if len(cells) < MIN_ROWS:
        return None
    near = min(NEAR_MOST, max(NEAR_LEAST, NEAR * width))
    anchors = [m for m, n in clusters((p.x_min for r in cells for p in r.parts), near) if n >= STABLE]
    on = [r for r in cells if sum(any(abs(p.x_min - m) <= near for m in anchors) for p in r.parts) >= 2]
    coverage = len(on) / len(cells)
    if len(on) < MIN_ROWS or coverage < COVERAGE:
        return None
    fill = upper_median(sum(p.width for p in r.parts) / max(1.0, r.x_max - r.x_min) for r in on)
    length = upper_median(len(p.text) for r in on for p in r.parts)
    if len(anchors) < WIDE and not (fill < FILL and length <= CELL):
        return None
    return Table(len(on), len(anchors), coverage, min(0.99, 0.45 + 0.3 * coverage + min(0.2, 0.04 * len(anchors))))


def side_by_side(left: list[Row], right: list[Row]) -> bool:
    """Whether each side is a table of its own with two shared starts or more."""
    steady = lambda half: sum(n >= STABLE for _, n in clusters((p.x_min for r in half for p in r.parts), SIDE_NEAR)) >= 2
    return all(steady(half) and table_of(half) is not None for half in (left, right))


def cells_text(rows: list[Row]) -> str:
    return "\n".join(" | ".join(p.text for p in r.parts) for r in rows)


def plain_text(rows: list[Row]) -> str:
    return "\n".join(" ".join(p.text for p in r.parts) for r in rows)


def records(rows: list[Row]) -> list[tuple[str, str]]:
    """(key, value) from the two leftmost starts: each value goes to the key whose row is nearest, ties to the upper one.

    Empty if the rows have fewer than two starts or no key.
    """
    starts = sorted(clusters((p.x_min for r in rows for p in r.parts), SIDE_NEAR))[:2]
    if len(starts) < 2:
        return []
    (first, _), (second, _) = starts
    keys: list[tuple[float, Part]] = []
    values: list[tuple[float, Part]] = []
    for r in rows:
        for p in r.parts:
            # as near to one as to the other counts as a key
            (keys if abs(p.x_min - first) <= abs(p.x_min - second) else values).append((r.y, p))
    keys.sort(key=lambda k: -k[0])
    own: list[list[str]] = [[] for _ in keys]
    if keys:
        for y, p in sorted(values, key=lambda v: (-v[0], v[1].x_min)):
            own[min(range(len(keys)), key=lambda i: abs(keys[i][0] - y))].append(p.text)
    return [(k.text, " ".join(v)) for (_, k), v in zip(keys, own)]


def records_text(rows: list[Row]) -> str:
    """Lines of ``key | value``; the cells as they are if there are no records."""
    found = records(rows)
    return "\n".join(f"{k} | {v}" if v else k for k, v in found) if found else cells_text(rows)
