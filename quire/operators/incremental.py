"""Resumable keyset ingest, keyed upserts and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.cursor import is_after


def batch(rows: DataFrame, at: str, key: str, cursor: tuple[int, str], before: int, since: int | None = None, limit: int = 100) -> DataFrame:
    """The next ``limit`` valid rows after the cursor and before the run's start, in cursor order.

    Bounds on the time reach the scan; the order is a top-k, not a sort of all rows.
    """
    t, k = F.col(at), F.col(key).cast("string")
    wanted = (t < before) & is_after(t, k, cursor) & (t > 0) & (F.trim(k) != "")
    if since is not None:
        wanted &= t >= since
    return rows.where(wanted).orderBy(at, k).limit(limit)


def metrics(rows: DataFrame, at: Column, key: Column, active: Column, group: Column, cursor: tuple[int, str]) -> DataFrame:
    """Counters of a dry run for each group: what would be processed, indexed, removed, skipped, and what failed or came late."""
    valid = (F.coalesce(at, F.lit(0)) > 0) & (F.trim(F.coalesce(key, F.lit(""))) != "")
    fresh = valid & is_after(at, key, cursor)
    flags = rows.select(group.alias("config"), valid.alias("valid"), fresh.alias("fresh"), F.coalesce(active, F.lit(True)).alias("active"))
    n = lambda c: F.count_if(c)
    f, a = F.col("fresh"), F.col("active")
    return flags.groupBy("config").agg(n(f).alias("processed"), n(f & a).alias("indexed"), n(f & ~a).alias("removed"), n(f & ~a).alias("skipped"), n(~F.col("valid")).alias("failed"), n(F.col("valid") & ~f).alias("late"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key: one aggregation with partial results before the shuffle, no window sort."""
    others = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("row")
    return rows.groupBy(key).agg(best).select(key, "row.*")


def upsert(stored: DataFrame, changes: DataFrame, key: str, *order: str) -> DataFrame:
    """Stored rows with changes applied; of each key the newest counts."""
    return latest(stored.unionByName(changes), key, *order)


def apply_changes(stored: DataFrame, changes: DataFrame, key: str, active: str, *order: str) -> DataFrame:
    """As ``upsert``, but a key whose newest row is not active is deleted; one that does not say counts as active."""
    return upsert(stored, changes, key, *order).where(F.coalesce(F.col(active), F.lit(True)))


def reconcile(stored: DataFrame, remote: DataFrame, key: str, probe_failed: bool = False) -> DataFrame:
    """Stored rows with status ``skipped`` (still there) or ``removed``; a failed probe removes nothing but raises."""
    if probe_failed:
        raise ValueError("the remote keys could not be read; nothing is removed")
    there = remote.select(F.col(key).alias("_there")).distinct()
    return stored.join(there, F.col(key) == F.col("_there"), "left").withColumn("status", F.when(F.col("_there").isNull(), "removed").otherwise("skipped")).drop("_there")


def keyset(stored: DataFrame, key: str, cursor, limit: int) -> tuple[DataFrame, bool]:
    """The next rows by key, and whether the scan wrapped round to the start."""
    after = stored if cursor is None else stored.where(F.col(key) > cursor)
    wrapped = cursor is not None and after.isEmpty()
    return (stored if wrapped else after).orderBy(key).limit(limit), wrapped
