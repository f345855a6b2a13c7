"""Incremental ingest of landed files by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.operators.incremental import latest


def ingest(spark: SparkSession, landing: str, schema, checkpoint: str, key: str, order: tuple[str, ...], apply: Callable[[DataFrame, int], None]):
    """Runs what has landed since the last run, at least once: each micro-batch is reduced to the newest row of each key.

    ``apply`` gets those rows and the batch number and must be idempotent.
    Returns the finished query.
    """

    def each(batch: DataFrame, number: int) -> None:
        apply(latest(batch, key, *order), number)

    stream = spark.readStream.schema(schema).parquet(landing)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query
