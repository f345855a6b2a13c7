"""Columns: where a page, or part of it, is divided from top to bottom."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from quire.pages.geometry import Row, clusters, extent, row_gaps, split_rows, upper_median

# fixed values: counts, shares of the width, and points
MIN_PARTS, MIN_LINES = 8, 4
ANCHOR, ANCHOR_LEAST, ANCHOR_MOST = 0.015, 4.0, 9.0
CENTRAL, PAIR = (0.40, 0.65), 0.3
INSET, INSET_LEAST = 0.025, 12.0
GAP, GAP_LEAST = 0.02, 12.0
GAP_NEAR, GAP_NEAR_LEAST = 0.025, 6.0
GUTTER, GUTTER_LEAST = 0.03, 12.0
ACROSS, ACROSS_LEAST = 0.06, 20.0
THREE_GUTTER, THREE_GUTTER_LEAST, THREE_WIDTH, THREE_APART = 0.055, 18.0, 0.16, 0.2
THREE_PARTS_A_ROW = 9
NESTED, NESTED_LEAST = 0.18, 30.0
OVERLAP = 0.5


@dataclass(slots=True)
class Columns:
    """Splits from left to right; none for one column."""

    splits: list[float]
    confidence: float

    @property
    def count(self) -> int:
        return len(self.splits) + 1


def anchor_tolerance(width: float) -> float:
    return min(ANCHOR_MOST, max(ANCHOR_LEAST, ANCHOR * width))


def inset(width: float) -> float:
    return max(INSET_LEAST, INSET * width)


def sides(rows: list[Row], split: float) -> tuple[set[int], set[int]]:
    """Numbers of the rows with a part that starts left of the split, and of those with one right of it."""
    left = {i for i, r in enumerate(rows) if any(p.x_min < split for p in r.parts)}
    right = {i for i, r in enumerate(rows) if any(p.x_min >= split for p in r.parts)}
    return left, right


def across(rows: list[Row], split: float, width: float) -> int:
    """Parts that start left of the split and end well beyond it."""
    beyond = split + max(ACROSS_LEAST, ACROSS * width)
    return sum(p.x_min < split and p.x_max > beyond for r in rows for p in r.parts)


def gap_clusters(rows: list[Row], width: float) -> list[tuple[float, int, float]]:
    """(middle, count, summed size) of the gaps between neighbouring parts; the most frequent first, then the widest."""
    tolerance = max(GAP_NEAR_LEAST, GAP_NEAR * width)
    found: list[list[float]] = []
    for r in rows:
        for a, b in zip(r.parts, r.parts[1:]):
            size = b.x_min - a.x_max
            if size < max(GAP_LEAST, GAP * width):
                continue
            middle = (a.x_max + b.x_min) / 2
            for c in found:
                if abs(c[0] - middle) <= tolerance:
                    c[1] += 1
                    c[0] += (middle - c[0]) / c[1]
                    c[2] += size
                    break
            else:
                found.append([middle, 1, size])
    return [(m, int(n), s) for m, n, s in sorted(found, key=lambda c: (-c[1], -c[2]))]


def start_splits(rows: list[Row], low: float, width: float) -> list[float]:
    """Splits before a start that many parts share: central starts first, then the right one of two far apart."""
    found = sorted(c for c in clusters(sorted(p.x_min for r in rows for p in r.parts), anchor_tolerance(width)) if c[1] >= MIN_LINES)
    central = [c for c in found if CENTRAL[0] * width <= c[0] - low <= CENTRAL[1] * width]
    pairs = [(a, b) for a, b in combinations(found, 2) if b[0] - a[0] >= PAIR * width]
    ordered = [c[0] for c in sorted(central, key=lambda c: -c[1])] + [b[0] for a, b in sorted(pairs, key=lambda p: -min(p[0][1], p[1][1]))]
    return [x - inset(width) for x in ordered]


def two_columns(rows: list[Row]) -> Columns | None:
    """A split where a start that many parts share begins the right column, else where most gaps lie."""
    parts = [p for r in rows for p in r.parts]
    if len(parts) < MIN_PARTS:
        return None
    low, high = extent(rows)
    width = high - low
    gaps = [m for m, n, _ in gap_clusters(rows, width) if n >= MIN_LINES and MIN_LINES <= sum(p.x_min < m for p in parts) <= len(parts) - MIN_LINES]
    for split in start_splits(rows, low, width) + gaps:
        left, right = sides(rows, split)
        spanning = across(rows, split, width)
        if min(len(left), len(right)) >= MIN_LINES and spanning <= len(rows) / 2:
            coverage, both = len(left | right) / len(rows), len(left & right) / len(rows)
            return Columns([split], max(0.5, min(0.98, 0.5 + 0.2 * coverage + 0.25 * both - 0.005 * spanning)))
    return None


def three_columns(rows: list[Row]) -> Columns | None:
    """Two splits between three starts that rows share, with real gutters and columns wide enough, relative to the rows' own width."""
    if not rows or sum(len(r.parts) for r in rows) > THREE_PARTS_A_ROW * len(rows):
        return None
    low, high = extent(rows)
    width = high - low
    tolerance = anchor_tolerance(width)
    near = 2 * tolerance  # columns of cards are centred at times
    found = [c for c in clusters(sorted(p.x_min for r in rows for p in r.parts), near) if c[1] >= 3]
    best = None
    for trio in combinations(sorted(found), 3):
        starts = [c[0] for c in trio]
        if min(b - a for a, b in zip(starts, starts[1:])) < THREE_APART * width:
            continue
        columns = [[p for r in rows for p in r.parts if abs(p.x_min - s) <= near] for s in starts]
        ends = [upper_median(p.x_max for p in c) for c in columns]
        gutters = [starts[1] - ends[0], starts[2] - ends[1]]
        if min(gutters) < max(THREE_GUTTER_LEAST, THREE_GUTTER * width) or min(upper_median(p.width for p in c) for c in columns) < THREE_WIDTH * width:
            continue
        shared = sum(all(any(abs(p.x_min - s) <= near for p in r.parts) for s in starts) for r in rows)
        if shared < 2:
            continue
        if best is None or shared > best[0]:
            best = (shared, [starts[1] - gutters[0] / 2, starts[2] - gutters[1] / 2])
    return best and Columns(best[1], min(0.95, 0.6 + 0.05 * best[0]))


def stable_on_both_sides(rows: list[Row], split: float) -> bool:
    """Whether each side has a start that four rows share."""
    tolerance = anchor_tolerance(extent(rows)[1] - extent(rows)[0])
    return all(any(n >= MIN_LINES for _, n in clusters((r.parts[0].x_min for r in half), tolerance)) for half in split_rows(rows, split))


def has_gutter(left: list[Row], right: list[Row], width: float) -> bool:
    """Whether both sides are there and no text of the left comes near the right."""
    return bool(left and right) and min(r.x_min for r in right) - max(r.x_max for r in left) >= max(GUTTER_LEAST, GUTTER * width)


def nested_splits(rows: list[Row]) -> list[float]:
    """Splits inside one column: between starts of atoms that lie far apart, with four rows on each side or a real gutter in two bands."""
    if len(rows) < MIN_LINES:
        return []
    low, high = extent(rows)
    width = high - low
    wide = max(NESTED_LEAST, NESTED * width)
    starts = sorted(a.x for r in rows for a in r.atoms)
    steady = [m for m, n in clusters(starts, anchor_tolerance(width)) if n >= MIN_LINES]
    out = [b - inset(width) / 2 for a, b in zip(steady, steady[1:]) if b - a >= wide]
    if out and all(stable_on_both_sides(rows, s) for s in out):
        return out
    # else the widest jump between neighbouring starts, weighed by the rows that it parts
    best = None
    for a, b in zip(starts, starts[1:]):
        if b - a < wide:
            continue
        left, right = split_rows(rows, b - 1e-6)
        score = (b - a) * min(len(left), len(right))
        if min(len(left), len(right)) >= MIN_LINES and (best is None or score > best[0]):
            best = (score, (max(p.x_max for r in left for p in r.parts if p.x_max < b) + b) / 2 if any(p.x_max < b for r in left for p in r.parts) else b - inset(width))
    if best:
        gapped = [split_rows(band, best[1]) for band in bands(rows)]
        if sum(has_gutter(left, right, width) for left, right in gapped) >= 2:
            return [best[1]]
    return []


def bands(rows: list[Row]) -> list[list[Row]]:
    """Rows in groups between which the gap is far wider than usual."""
    limit = max(24.0, 2.25 * upper_median(row_gaps(rows), 12.0))
    out: list[list[Row]] = []
    for r in rows:
        if out and out[-1][-1].y - r.y <= limit:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def parallel(left: list[Row], right: list[Row]) -> bool:
    """Whether two blocks stand beside each other for half of the shorter one or more."""
    if not left or not right:
        return False
    shared = min(left[0].y, right[0].y) - max(left[-1].y, right[-1].y)
    shorter = min(left[0].y - left[-1].y, right[0].y - right[-1].y)
    return shared >= OVERLAP * shorter if shorter > 0 else shared >= 0
