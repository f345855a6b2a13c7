"""Chunks with character offsets, and the lines they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import collapse


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 500, overlap: int = 50, most: int = 0, least: int = 1) -> DataFrame:
    """key, number, start, stop, text: windows of ``size`` characters over the text with blanks collapsed, ``overlap`` shared.

    ``most`` bounds the chunks of a document (0: all); chunks below ``least`` characters go.
    Narrow: no shuffle, one pass, offsets in code points.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap between 0 and size")
    flat = docs.select(F.col(key), collapse(F.coalesce(F.col(text), F.lit(""))).alias("_flat")).where("_flat <> ''")
    last = F.greatest(F.lit(0), F.length("_flat") - overlap - 1)
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    if most > 0:
        starts = F.slice(starts, 1, most)
    cut = flat.select(key, "_flat", F.posexplode(starts).alias("_n", "start"))
    body = F.substring(F.col("_flat"), F.col("start") + 1, F.lit(size))
    out = cut.select(key, (F.col("_n") + 1).alias("number"), "start", (F.col("start") + F.length(body)).alias("stop"), body.alias("text"))
    return out.where(F.length("text") >= least)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, start, stop: lines of a text with the offsets they have once blanks are collapsed."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), collapse), lambda s: s != "")
    flat = docs.select(F.col(key), parts.alias("_parts")).select(key, "_parts", F.posexplode("_parts").alias("_i", "_line"))
    before = F.aggregate(F.slice("_parts", F.lit(1), F.col("_i")), F.lit(0), lambda n, s: n + F.length(s) + 1)
    return flat.select(key, (F.col("_i") + 1).alias("line"), before.alias("start"), (before + F.length("_line")).alias("stop"))


def touched_lines(chunks: DataFrame, regions: DataFrame, key: str = "doc_id", bucket: int = 2000) -> DataFrame:
    """key, number, lines: comma list of the lines that each chunk overlaps, in order.

    Half-open intervals are joined by document and by the buckets of offsets
    that they cover, so one very long document is spread over many tasks; a
    pair counts in the bucket where its overlap starts.
    """
    spread = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("stop") - 1) / bucket))))
    a, b = spread(chunks).alias("a"), spread(regions).alias("b")
    near = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._b") == F.col("b._b"))
    overlap = (F.col("b.start") < F.col("a.stop")) & (F.col("b.stop") > F.col("a.start"))
    once = F.floor(F.greatest("a.start", "b.start") / bucket) == F.col("a._b")
    met = a.join(b, near & overlap & once).select(F.col(f"a.{key}").alias(key), F.col("a.number").alias("number"), F.col("b.line").alias("line"))
    return met.groupBy(key, "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x.cast("string")), ",").alias("lines"))
