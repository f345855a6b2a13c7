"""Which configurations a run uses, and why it leaves some out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNKING = ("chunk_size", "chunk_overlap", "max_chunks", "min_chunk_chars")


def base_url(url: Column) -> Column:
    """Trimmed, without slashes at its end."""
    return F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", "")


def resolve(configs: DataFrame, identifier: str, kind: str, fits: Column, uid: int = 0, enabled_only: bool = False) -> DataFrame:
    """The configuration with ``uid``, if given and fitting; else those of the identifier; else fitting ones of the kind.

    Only the first of these that yields any counts.
    """
    rows = configs.where("enabled") if enabled_only else configs
    if uid > 0:
        return rows.where((F.col("uid") == uid) & fits)
    step = F.when(F.col("identifier") == identifier, 1).when((F.col("kind") == kind) & fits, 2)
    ranked = rows.withColumn("_step", step).where("_step IS NOT NULL")
    return ranked.withColumn("_best", F.min("_step").over(Window.partitionBy())).where("_step = _best").drop("_step", "_best")


def resolve_one(configs: DataFrame, identifier: str, uid: int = 0) -> DataFrame:
    """The enabled configuration with ``uid``, else the first enabled one of the identifier; raises if there is none."""
    usable = configs.where("enabled")
    choice = F.when(F.col("uid") == uid, 0).when(F.col("identifier") == identifier, 1) if uid > 0 else F.when(F.col("identifier") == identifier, 1)
    found = usable.withColumn("_choice", choice).where("_choice IS NOT NULL").orderBy("_choice", "uid").limit(1).drop("_choice")
    if found.isEmpty():
        raise ValueError("no enabled configuration was found")
    return found


def guarded(configs: DataFrame) -> DataFrame:
    """Configurations with ``skipped_for``: why a run must leave one out; null if it need not."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    why = F.when(blank("collection"), "no collection").when(blank("base_url") | blank("client_id") | blank("api_key"), "incomplete credentials")
    return configs.withColumn("skipped_for", why)


def chunking(configs: DataFrame, requested: int = 0) -> DataFrame:
    """uid, title and chunk settings of the requested configuration, else of the first; without any, zeros, which stand for the service's own."""
    spark = configs.sparkSession
    own = configs.select("uid", "title", *CHUNKING).withColumn("_at", F.when(F.col("uid") == requested, 0).otherwise(1))
    none = spark.createDataFrame([(0, "service defaults", 0, 0, 0, 0, 2)], "uid int, title string, chunk_size int, chunk_overlap int, max_chunks int, min_chunk_chars int, _at int")
    every = own.select(F.col("uid").cast("int"), "title", *[F.col(c).cast("int") for c in CHUNKING], "_at").unionByName(none)
    return every.orderBy("_at", "uid").limit(1).drop("_at")
