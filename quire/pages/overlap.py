"""Runs that are drawn over each other."""

from __future__ import annotations


from quire.pages.geometry import Atom, Entry, atom_of

# fixed values: shares of sizes and of the shorter run, and points
Y_NEAR, Y_LEAST = 0.2, 1.5
X_NEAR, X_LEAST = 1.5, 8.0
COVERED = 0.72


def _one_run(first: int, second: int, flags: dict[int, bool]) -> bool:
    """Whether every entry after the first, up to the second, goes on from the one before."""
    return all(flags.get(i, False) for i in range(first + 1, second + 1))


def pairs(entries: list[Entry], flags: dict[int, bool], most: int) -> list[tuple[int, int, float]]:
    """(first, second, share in percent) of runs with different texts at nearly the same place, in source order.

    Runs are met in order of height, so each is compared with those within its
    own tolerance only.
    """
    runs = sorted((a for e in entries if (a := atom_of(e)) is not None), key=lambda a: a.y)
    found = []
    for i, a in enumerate(runs):
        reach = max(Y_LEAST, Y_NEAR * a.size)
        j = i + 1
        while j < len(runs) and runs[j].y - a.y <= reach:
            pair = _covered(a, runs[j])
            if pair is not None:
                found.append(pair)
            j += 1
    found.sort()
    return [p for p in found if not _one_run(p[0], p[1], flags)][: max(0, most)]


def _covered(a: Atom, b: Atom) -> tuple[int, int, float] | None:
    if a.text == b.text:
        return None
    least = min(a.size, b.size)
    if abs(a.y - b.y) > max(Y_LEAST, Y_NEAR * least) or abs(a.x - b.x) > max(X_LEAST, X_NEAR * least):
        return None
    share = (min(a.end, b.end) - max(a.x, b.x)) / max(1.0, min(a.end - a.x, b.end - b.x))
    if share < COVERED:
        return None
    return (*sorted((a.index, b.index)), round(100 * share, 1))
