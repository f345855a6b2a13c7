"""Stored state of resumable runs: cursors, checkpoints, run reports; one row for each connector and indexer.

All indexers of a run advance together: their rows are joined with their
states, numbered in cursor order up to the limit, and summed into the next
states.  So a run needs no loop on the driver, and the limit is each
indexer's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.incremental import latest

KEY = ["connector", "indexer"]
COUNTERS = ("processed", "indexed", "skipped", "failed", "removed", "chunks")
DAY = 86_400


def lookup(states: DataFrame, connector: str, indexer: str) -> DataFrame:
    """The one state of a connector and indexer, if there is one."""
    return states.where((F.col("connector") == connector) & (F.col("indexer") == indexer)).limit(1)


def get_or_create(indexers: DataFrame, states: DataFrame) -> DataFrame:
    """A state for each (connector, indexer): the stored one, or a new one at the start of everything."""
    have = states.select(*KEY, "cursor_at", "cursor_id", "status", "message", *COUNTERS)
    out = indexers.select(*KEY).distinct().join(have, KEY, "left")
    zero = F.lit(0).cast("long")
    return out.select(*KEY, F.coalesce("cursor_at", zero).alias("cursor_at"), F.coalesce("cursor_id", F.lit("")).alias("cursor_id"), F.coalesce("status", F.lit("new")).alias("status"), F.coalesce("message", F.lit("")).alias("message"), *[F.coalesce(c, zero).alias(c) for c in COUNTERS])


def resolve_cursors(states: DataFrame, reset: bool = False, explicit: tuple[int, str] | None = None) -> DataFrame:
    """States with the cursor that a run starts from: none after a reset, else the given one, else the stored one."""
    if not reset and explicit is None:
        return states
    at, key = (0, "") if reset else explicit
    return states.withColumns({"cursor_at": F.lit(at).cast("long"), "cursor_id": F.lit(key)})


def lower_bound(cursor_at: Column, now: int, lookback_days: int, since: int | None = None) -> Column:
    """Least time that a scan asks for: the given one, else the cursor's, else so many days (one at least) before now."""
    if since is not None:
        return F.lit(since).cast("long")
    return F.when(cursor_at > 0, cursor_at).otherwise(F.lit(now - max(1, lookback_days) * DAY).cast("long"))


def plan(products: DataFrame, states: DataFrame, before: int, limit: int = 100, now: int | None = None, lookback_days: int = 1, since: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """connector, indexer, id, at, content_hash, outcome, has_more of what a run takes from ``products``.

    ``products`` is (connector, indexer, id, at, active, content); ``stored``
    (connector, indexer, id, content_hash): documents that did not change are
    skipped.  Rows without id or time have failed and do not move the cursor,
    nor count against the limit; rows up to the cursor are late and left out.
    A row without content has failed as well, an inactive one is removed (and
    counts as skipped, too).
    """
    valid = (F.coalesce("at", F.lit(0)) > 0) & (F.trim(F.coalesce("id", F.lit(""))) != "")
    rows = products.join(states.select(*KEY, "cursor_at", "cursor_id"), KEY)
    after = (F.col("at") > F.col("cursor_at")) | ((F.col("at") == F.col("cursor_at")) & ((F.col("cursor_id") == "") | (F.col("id") > F.col("cursor_id"))))
    bound = lower_bound(F.col("cursor_at"), before if now is None else now, lookback_days, since)
    wanted = valid & after & (F.col("at") < before) & (F.col("at") >= bound)
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("at", "id"))
    room = max(1, limit)
    taken = rows.where(wanted).withColumn("_n", number).where(F.col("_n") <= room + 1)
    taken = taken.withColumn("has_more", F.max("_n").over(Window.partitionBy(*KEY)) > room).where(F.col("_n") <= room)
    taken = taken.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    if stored is None:
        same = F.lit(False)
    else:
        taken = taken.join(stored.select(*KEY, "id", F.col("content_hash").alias("_was")), [*KEY, "id"], "left")
        same = F.coalesce(F.col("_was") == F.col("content_hash"), F.lit(False))
    active = F.coalesce("active", F.lit(True))
    outcome = F.when(~active, "removed").when(F.trim(F.coalesce("content", F.lit(""))) == "", "failed").when(same, "unchanged").otherwise("indexed")
    done = taken.select(*KEY, "id", "at", "content_hash", outcome.alias("outcome"), "has_more")
    bad = rows.where(~valid).select(*KEY, "id", "at", F.lit(None).cast("string").alias("content_hash"), F.lit("invalid").alias("outcome"), F.lit(False).alias("has_more"))
    return done.unionByName(bad)


def advance(states: DataFrame, rows: DataFrame, status: str = "ok", message: str = "", chunks: DataFrame | None = None) -> DataFrame:
    """The states after the rows of ``plan``: cursor at the last processed row, counters of this run, next_cursor and has_more.

    As a checkpoint of a run that goes on, ``status`` is ``running``.  The
    cursor moves to what was processed last, never to what was not.
    """
    done = F.col("outcome") != "invalid"
    n = lambda *which: F.count_if(F.col("outcome").isin(*which))
    sums = rows.groupBy(*KEY).agg(
        F.max(F.when(done, F.struct("at", "id"))).alias("last"), n("indexed", "removed", "unchanged", "failed").alias("processed"), n("indexed").alias("indexed"),
        n("removed", "unchanged").alias("skipped"), n("failed", "invalid").alias("failed"), n("removed").alias("removed"), F.max("has_more").alias("has_more"),
    )
    if chunks is not None:
        own = rows.where("outcome = 'indexed'").select(*KEY, "id")
        sums = sums.join(chunks.join(own, [*KEY, "id"], "left_semi").groupBy(*KEY).agg(F.sum("n").alias("chunks")), KEY, "left")
    else:
        sums = sums.withColumn("chunks", F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    old = states.select(*KEY, "cursor_at", "cursor_id")
    joined = old.join(sums, KEY, "left")
    moved = joined.select(*KEY, F.coalesce("last.at", "cursor_at").alias("cursor_at"), F.coalesce("last.id", "cursor_id").alias("cursor_id"), F.lit(status).alias("status"), F.lit(message).alias("message"), *[F.coalesce(c, zero).alias(c) for c in COUNTERS], F.coalesce("has_more", F.lit(False)).alias("has_more"))
    return moved.withColumn("next_cursor", F.concat(F.col("cursor_at").cast("string"), F.lit("|"), "cursor_id"))


def failed(states: DataFrame, message: str) -> DataFrame:
    """The states after a failure: marked and explained, with cursors and counters where they were, so that the next run resumes there."""
    return states.withColumns({"status": F.lit("error"), "message": F.lit(message)})


def save(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored states with the changed ones put in or in place of the old."""
    columns = [*KEY, "cursor_at", "cursor_id", "status", "message", *COUNTERS]
    both = stored.select(*columns).withColumn("_new", F.lit(0)).unionByName(changed.select(*columns).withColumn("_new", F.lit(1)))
    keyed = both.withColumn("_key", F.struct(*KEY))
    return latest(keyed, "_key", "_new", "cursor_at", "cursor_id").drop("_key", "_new").select(*columns)


def total(states: DataFrame) -> DataFrame:
    """Counters over all indexers, as the report of a whole run counts them."""
    return states.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in COUNTERS], F.coalesce(F.max("has_more"), F.lit(False)).alias("has_more"))


def report(states: DataFrame) -> DataFrame:
    """connector, indexer, json, line: each indexer's run for machines and for people."""
    result = F.to_json(F.struct(*COUNTERS, F.col("next_cursor").alias("nextCursor"), F.col("has_more").alias("hasMore")))
    written = F.to_json(F.struct(F.col("indexer").alias("i")))  # {"i":"..."}
    json = F.concat(F.lit('{"status":"'), "status", F.lit('","indexer":'), written.substr(F.lit(6), F.length(written) - 6), F.lit(',"result":'), result, F.lit("}"))
    shown = lambda c: F.concat(F.lit(c.capitalize() + ": "), F.col(c).cast("string"))
    cursor = F.when(F.col("next_cursor") == "0|", "-").otherwise(F.col("next_cursor"))
    line = F.concat_ws(", ", *[shown(c) for c in COUNTERS], F.concat(F.lit("Next cursor: "), cursor), F.concat(F.lit("Has more: "), F.when(F.col("has_more"), "yes").otherwise("no")))
    return states.select(*KEY, json.alias("json"), line.alias("line"))
