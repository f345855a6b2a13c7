"""Keyset cursors ``<seconds>|<id>`` and timestamps in whole seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(cursor: str | None) -> tuple[int, str]:
    """(seconds, id); a bare number has no id, and what is no number counts as 0."""
    at, _, key = (cursor or "").partition("|")
    at = at.strip()
    return (int(at) if at.lstrip("-").isdigit() else 0), key.strip()


def write(at: int, key: str) -> str:
    return f"{at}|{key}"


def is_after(at: Column, key: Column, cursor: tuple[int, str]) -> Column:
    """Strictly after the cursor in the order of (time, id in byte order)."""
    then, last = cursor
    return (at > then) | ((at == then) & (F.lit(last == "") | (key > F.lit(last))))


def seconds(updated: Column, created: Column | None = None) -> Column:
    """Epoch seconds of the first value that is there; 0 if it is no timestamp."""
    value = updated if created is None else F.coalesce(updated, created)
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(value)), F.lit(0).cast("long"))
