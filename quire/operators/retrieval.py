"""Search results to scored, limited, query-focused passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import excerpts

TEXT, TITLE, URL = 6000, 500, 2048
#: how much the score falls with each place
STEP = 0.01


def default_score(position: Column) -> Column:
    """For rows without a score: 1 for the first place and a hundredth less for each that follows, not below 0."""
    return F.greatest(F.lit(0.0), 1 - STEP * (position - 1))


def normalise_rows(rows: DataFrame, group: str, order: str, fields: dict[str, str], within: int | None = None) -> DataFrame:
    """One captured row per search result: identifiers, score, cut texts and the place in its group.

    ``fields`` maps id, type, title, text, url and score to columns.  With
    ``within`` only so many places of each group are numbered at all, so that
    a large group is cut down before it is shuffled.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    placed = rows.withColumn("position", place)
    if within is not None:
        placed = placed.where(F.col("position") <= within)
    have = lambda name: F.col(fields[name]) if name in fields else F.lit(None).cast("string")
    uid = F.trim(F.coalesce(have("id").cast("string"), F.lit("")))
    kind = F.coalesce(have("type").cast("string"), F.lit("result"))
    identifier = F.when(uid == "", F.concat(F.lit("result:"), F.col("position").cast("string"))).otherwise(F.concat_ws(":", kind, uid))
    score = F.coalesce(have("score").try_cast("double"), default_score(F.col("position")))
    cut = lambda name, n: F.substring(F.coalesce(have(name), F.lit("")), 1, n)
    return placed.select(F.col(group).alias("result_group"), identifier.alias("id"), F.round(score, 6).alias("score"), cut("text", TEXT).alias("text"), cut("title", TITLE).alias("title"), cut("url", URL).alias("url"), uid.alias("source_uid"), "position")


def add_context(rows: DataFrame, integration: str, query: str) -> DataFrame:
    """Prefixes ids by the integration and adds the query and the group's row count."""
    total = F.count("*").over(Window.partitionBy("result_group"))
    return rows.withColumns({"id": F.concat(F.lit(integration + ":"), "id"), "effective_query": F.lit(query), "total": total})


def select_results(rows: DataFrame, threshold: float, most: int) -> DataFrame:
    """The first ``most`` rows of each group, by place, that reach the threshold and have an id and a text."""
    usable = (F.trim("id") != "") & (F.col("text") != "")
    if threshold > 0:
        usable &= F.coalesce("score", F.lit(0.0)) >= threshold
    place = F.row_number().over(Window.partitionBy("result_group").orderBy("position"))
    return rows.where(usable).withColumn("kept", place).where(F.col("kept") <= most).drop("kept")


def retrieve(rows: DataFrame, query: str, threshold: float, most: int, size: int, per_result: int = 1) -> DataFrame:
    """result_group, id, score, text: one row per passage."""
    chosen = select_results(rows, threshold, most)
    passages = chosen.select("result_group", "id", "score", F.posexplode(excerpts(F.col("text"), query, size, per_result)).alias("n", "passage"))
    return passages.select("result_group", F.concat("id", F.lit("#excerpt-"), (F.col("n") + 1).cast("string")).alias("id"), "score", F.col("passage").alias("text"))
