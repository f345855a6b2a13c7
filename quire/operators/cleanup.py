"""Clean-up of stored documents that are gone at their source: batches by key, hashes, deletes and soft deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.incremental import keyset, reconcile

LEAST, MOST = 1, 500


def batch_size(asked: int) -> int:
    return max(LEAST, min(MOST, asked))


def page_size(limit: int) -> int:
    """Rows of one request: one more than the limit shows whether there are more."""
    return max(LEAST, min(MOST, limit + 1))


def source_hashes(computed: Column, stored: Column) -> Column:
    """Hashes under which a document may be stored: trimmed, none empty, each once."""
    every = F.array(F.coalesce(computed, F.lit("")), F.coalesce(stored, F.lit("")))
    return F.array_distinct(F.filter(F.transform(every, lambda h: F.trim(h)), lambda h: h != ""))


def source_hash(kind: Column, source_id: Column, language: Column) -> Column:
    """The hash of a document's source: what it is, where it comes from and its language."""
    return F.sha2(F.concat_ws("|", kind, source_id.cast("string"), F.coalesce(language, F.lit(""))), 256)


def next_batch(stored: DataFrame, remote: DataFrame, key: str, cursor, limit: int, size: int = 100, probe_failed: bool = False) -> DataFrame:
    """The next ``limit`` stored rows after the cursor (from the start, if there are none) with batch, status and has_more.

    Batches are what one lookup asks for.  ``has_more`` says that the limit was
    reached.  Rows that are still there, even if inactive, are skipped.
    """
    rows, _ = keyset(stored, key, cursor, limit)
    place = F.row_number().over(Window.orderBy(key))  # of at most ``limit`` rows
    numbered = rows.withColumns({"batch": F.floor((place - 1) / batch_size(size)).cast("int"), "has_more": F.count("*").over(Window.partitionBy()) >= limit})
    return reconcile(numbered, remote, key, probe_failed)


def counts(rows: DataFrame) -> DataFrame:
    """processed, skipped, removed, has_more, next_cursor of a batch; no rows give zeros and no cursor."""
    return rows.agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "removed").alias("removed"), F.coalesce(F.max("has_more"), F.lit(False)).alias("has_more"))


def soft_delete(stored: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Stored rows, those removed with status ``removed`` and their error cleared."""
    gone = removed.where("status = 'removed'").select(F.col(key).alias("_gone")).distinct()
    joined = stored.join(gone, stored[key] == gone["_gone"], "left")
    out = F.col("_gone").isNotNull()
    return joined.withColumns({"status": F.when(out, "removed").otherwise(F.col("status")), "error": F.when(out, "").otherwise(F.col("error"))}).drop("_gone")


def delete_hashes(vectors: DataFrame, hashes: DataFrame, connected: bool = True, dry_run: bool = False) -> DataFrame:
    """Vectors without those of the given hashes; a dry run and blank hashes delete nothing, and a store must be connected."""
    if dry_run:
        return vectors
    if not connected:
        raise RuntimeError("no vector store is connected")
    gone = hashes.select(F.trim("source_hash").alias("source_hash")).where("source_hash <> ''").distinct()
    return vectors.join(gone, "source_hash", "left_anti")


def put_documents(vectors: DataFrame, chunks: DataFrame, dry_run: bool = False) -> DataFrame:
    """Vectors with those of the chunks' documents replaced by the chunks; (source_hash, number, text) each."""
    if dry_run:
        return vectors
    kept = vectors.join(chunks.select("source_hash").distinct(), "source_hash", "left_anti")
    return kept.select("source_hash", "number", "text").unionByName(chunks.select("source_hash", "number", "text"))
