"""Search results as a browser captures them: JSON rows to canonical results, payloads, gates and groups."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import json_path
from quire.operators.retrieval import TEXT, TITLE, URL, default_score

#: where a field is read from, if a request does not say
FIELDS = {"id": "uid", "title": "title", "text": "text", "url": "url", "type": "type", "pageId": "pageId", "changedAt": "changedAt", "score": "score"}
KIND, UID = 100, 255
_TAG = re.compile(r"""(?s)<!--.*?-->|</?[A-Za-z!?](?:"[^"]*"|'[^']*'|[^'">])*>""")


def utf16_prefix(text: str, units: int) -> str:
    """The first units of UTF-16; half of a pair is left out."""
    if len(text) <= units // 2:
        return text
    return text.encode("utf-16-le", "surrogatepass")[: 2 * units].decode("utf-16-le", "ignore")


def plain(value: str, units: int) -> str:
    """Text of HTML, blanks collapsed and trimmed, cut to so many UTF-16 units."""
    return utf16_prefix(re.sub(r"\s+", " ", html.unescape(_TAG.sub("", value))).strip(), units)


def plain_column(value: Column, units: int) -> Column:
    @F.pandas_udf("string")
    def clean(values):
        return values.map(lambda v: plain(v, units), na_action="ignore")

    return clean(F.coalesce(value, F.lit("")))


def field_mapping(given: dict[str, str] | None) -> dict[str, str]:
    """The fields' places: those that are given and not empty, else the usual ones."""
    return FIELDS | {k: v for k, v in (given or {}).items() if k in FIELDS and v}


def parse_rows(captures: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """result_group, position and the mapped fields of each row of ``rows`` (JSON); anything but a list gives no rows."""
    listed = F.try_variant_get(F.try_parse_json("rows"), "$", "array<variant>")
    rows = captures.select("result_group", F.posexplode(F.coalesce(listed, F.array().cast("array<variant>"))).alias("at", "row"))
    path = lambda p: "$" + "".join(f"['{part}']" for part in p.split("."))
    read = [json_path.scalar(F.try_variant_get("row", path(place), "variant")).alias(name) for name, place in field_mapping(fields).items()]
    return rows.select("result_group", (F.col("at") + 1).alias("position"), *read)


def results(rows: DataFrame, context: str = "") -> DataFrame:
    """result_group, id, score, text, title, url, source_type, source_uid, page_id, changed_at, position of parsed rows."""
    kind, uid = plain_column(F.col("type"), KIND), plain_column(F.col("id"), UID)
    cleaned = rows.withColumns({"source_type": kind, "source_uid": uid, "_text": plain_column(F.col("text"), TEXT), "_title": plain_column(F.col("title"), TITLE), "_url": plain_column(F.col("url"), URL)})
    own = F.when(F.col("source_uid") == "", F.concat(F.lit("result:"), F.col("position").cast("string"))).when(F.col("source_type") == "", F.col("source_uid")).otherwise(F.concat("source_type", F.lit(":"), "source_uid"))
    number = F.when(F.trim("score") != "", F.col("score").try_cast("double"))
    number = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    whole = lambda c: F.coalesce(F.col(c).try_cast("double").try_cast("long"), F.lit(0).cast("long")).alias(name)
    out = []
    for name, c in (("page_id", "pageId"), ("changed_at", "changedAt")):
        out.append(whole(c))
    named = F.concat(F.lit(context + ":"), own) if context else own
    return cleaned.select("result_group", named.alias("id"), F.coalesce(number, F.round(default_score(F.col("position")), 6)).alias("score"), F.col("_text").alias("text"), F.col("_title").alias("title"), F.col("_url").alias("url"), "source_type", "source_uid", *out, "position")


def payloads(found: DataFrame, integration: str, original: str, effective: str | None = None) -> DataFrame:
    """result_group, total, payload: each group's results and queries as JSON, results by place."""
    row = F.struct("position", "id", "score", "text", "title", "url", "source_type", "source_uid", "page_id", "changed_at")
    grouped = found.groupBy("result_group").agg(F.array_sort(F.collect_list(row)).alias("results"))
    total = F.size("results").cast("long").alias("total")
    body = F.struct(F.lit(1).alias("version"), F.lit(integration).alias("integration"), F.lit(original).alias("originalQuery"), F.lit(effective or original).alias("effectiveQuery"), total, "results")
    return grouped.select("result_group", total, F.to_json(body).alias("payload"))


def changed_payloads(stream: DataFrame, session: str = "session", order: str = "at", payload: str = "payload") -> DataFrame:
    """Rows whose payload is not that of the row before, in each session."""
    own = F.xxhash64(payload)
    before = F.lag(own).over(Window.partitionBy(session).orderBy(order))
    return stream.withColumn("_signature", own).withColumn("_before", before).where("_before IS NULL OR _before <> _signature").drop("_signature", "_before")


def may_process(plan: Column, payload: Column, step: str = "search") -> Column:
    """Whether a plan (a list of steps, null for all) allows the step and the payload holds results."""
    some = F.try_variant_get(F.try_parse_json(payload), "$.results", "array<variant>")
    return (plan.isNull() | F.array_contains(plan, step)) & (F.coalesce(F.size(some), F.lit(0)) > 0)


def retrieval_groups(passages: DataFrame, payloads_: DataFrame) -> DataFrame:
    """result_group, n_passages, effective_query, payload: what is stored of a group's retrieval, with the payload as it came."""
    counts = passages.groupBy("result_group").agg(F.count("*").alias("n_passages"))
    query = F.try_variant_get(F.try_parse_json("payload"), "$.effectiveQuery", "string")
    return payloads_.join(counts, "result_group", "left").select("result_group", F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"), query.alias("effective_query"), "payload")
