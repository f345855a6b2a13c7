"""Vector artwork: painted paths of a content stream in bands of the page that hold no text."""

from __future__ import annotations

import re
from collections.abc import Iterable

from quire.pages.geometry import Row

# fixed values: shares of the page, counts and points
EDGE, FREE, PAD, PAD_LEAST = 0.05, 0.14, 0.008, 4.0
BELOW, LINE = 0.3, 10.0
WIDE, HIGH, MARGIN, PATHS = 0.18, 0.08, 0.075, 14
PATH_LEAST, PATH_MOST = (0.001, 0.002), (0.3, 0.1)
_PAINT = frozenset({"S", "s", "f", "F", "f*", "B", "B*", "b", "b*"})
#: how many numbers a path operator takes, of which each two are a point
_POINTS = {"m": 2, "l": 2, "c": 6, "v": 4, "y": 4}

Bounds = tuple[float, float, float, float]
Matrix = tuple[float, float, float, float, float, float]
_SKIPPED = re.compile(r"\bBT\b.*?\bET\b|\bBI\b.*?\bEI\b|%[^\r\n]*|\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>", re.S)
_TOKEN = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)|/?[A-Za-z'\"*]+\d*\*?")
ONE: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def compose(inner: Matrix, outer: Matrix) -> Matrix:
    """The matrix that applies ``inner`` first."""
    a, b, c, d, e, f = inner
    A, B, C, D, E, F = outer
    return (a * A + b * C, a * B + b * D, c * A + d * C, c * B + d * D, e * A + f * C + E, e * B + f * D + F)


def transform(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def union(boxes: Iterable[Bounds]) -> Bounds:
    """left, bottom, right, top of all."""
    left, bottom, right, top = zip(*boxes)
    return min(left), min(bottom), max(right), max(top)


def _around(points: list[tuple[float, float]]) -> Bounds:
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


def painted(content: str) -> list[Bounds]:
    """left, bottom, right, top of each painted path; text and inline images are passed over."""
    out: list[Bounds] = []
    matrix, saved, points, numbers = ONE, [], [], []
    for token in _TOKEN.findall(_SKIPPED.sub(" ", content)):
        if token[0] in "0123456789+-.":
            numbers.append(float(token))
            continue
        if token == "q":
            saved.append(matrix)
        elif token == "Q":
            matrix = saved.pop() if saved else ONE
        elif token == "cm" and len(numbers) >= 6:
            matrix = compose(tuple(numbers[-6:]), matrix)
        elif token == "re" and len(numbers) >= 4:
            x, y, w, h = numbers[-4:]
            points += [transform(matrix, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
        elif token in _POINTS and len(numbers) >= _POINTS[token]:
            given = numbers[-_POINTS[token] :]
            points += [transform(matrix, *p) for p in zip(given[::2], given[1::2])]
        elif token in _PAINT or token == "n":
            if points and token != "n":
                out.append(_around(points))
            points = []
        numbers = []
    return out


def free_bands(rows: list[Row], bottom: float, height: float) -> list[tuple[float, float]]:
    """(bottom, top) of the bands without text that are high enough, from below; text takes its line and some room."""
    low, high = bottom + EDGE * height, bottom + (1 - EDGE) * height
    room = max(PAD_LEAST, PAD * height)
    taken = []
    for r in rows:
        size = max([LINE, *(a.v_scale for a in r.atoms)])
        taken.append((max(low, r.y - BELOW * size - room), min(high, r.y + size + room)))
    out, at = [], low
    for start, end in sorted(t for t in taken if t[1] > t[0]) + [(high, high)]:
        if start - at >= FREE * height:
            out.append((at, start))
        at = max(at, end)
    return out


def detect(rows: list[Row], box: list[float] | None, content: str) -> list[Bounds]:
    """Bounds of the artwork in each text-free band; none where the page's box is not given."""
    if not box or len(box) < 4:
        return []
    left, bottom, width, height = box[0], box[1], box[2] - box[0], box[3] - box[1]
    fits = lambda w, h: PATH_LEAST[0] * width <= w <= PATH_MOST[0] * width and PATH_LEAST[1] * height <= h <= PATH_MOST[1] * height
    paths = [p for p in painted(content) if fits(p[2] - p[0], p[3] - p[1])]
    if len(paths) < PATHS:
        return []
    out = []
    for low, high in free_bands(rows, bottom, height):
        own = [p for p in paths if low <= (p[1] + p[3]) / 2 <= high]
        if len(own) < PATHS:
            continue
        x0, y0, x1, y1 = union(own)
        inside = y0 >= bottom + MARGIN * height and y1 <= bottom + (1 - MARGIN) * height
        if x1 - x0 >= WIDE * width and y1 - y0 >= HIGH * height and inside:
            out.append((max(left, x0), max(low, y0), min(left + width, x1), min(high, y1)))
    return out
