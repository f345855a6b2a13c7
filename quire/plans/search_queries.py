"""Queries on requests and captured results, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import requests
from quire.operators import captures
from quire.sources.tables import table

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search request for every customer: query string and body, some without query, engine or control."""
    k = F.col("c_custkey")
    own = k.cast("string")
    engine = F.when(k % 7 == 0, "other").otherwise("solr")
    asked = F.concat(F.lit('{"tx_solr":{"q":"'), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("old words "), own)), F.lit('","page":3,"sort":{"by":"t"}},"id":'), own, F.lit("}"))
    body = F.when(k % 2 == 0, F.concat(F.lit('{"tx_solr":{"sort":{"way":"up"}},"more":["'), own, F.lit('"]}')))
    control = F.when(k % 11 == 0, "{}").otherwise(F.concat(F.lit('{"integration":"'), engine, F.lit('","processed":'), F.when(k % 13 == 0, "true").otherwise("false"), F.lit("}")))
    url = F.concat(F.lit("https://site.example/find?id="), own, F.lit("&tx_solr%5Bpage%5D=3&search_control%5Bx%5D=1#top"))
    return table(spark, sf_dir, "customer").select("c_custkey", url.alias("url"), asked.alias("query"), body.alias("body"), control.alias("control"))


@query("""
SELECT c_custkey, '{"id":' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ',"more":["' || c_custkey || '"]' ELSE '' END || ',"tx_solr":{"page":3,"q":"' || CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE 'old words ' || c_custkey END || '","sort":{"by":"t"' || CASE WHEN c_custkey % 2 = 0 THEN ',"way":"up"' ELSE '' END || '}}}' AS parameters,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'old words ' || c_custkey END AS q, '{"id":' || c_custkey || '}' AS emptied FROM customer""")
def request_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _requests(spark, sf_dir)
    merged = requests.parameters_column(F.col("query"), F.col("body"))
    paths = (("tx_solr", "q"), ("tx_solr", "page"), ("tx_solr", "sort", "by"))
    emptied = F.col("query")
    for path in paths:
        emptied = requests.changed_column(emptied, path, None)
    return rows.select("c_custkey", merged.alias("parameters"), requests.at_path(F.col("query"), ("tx_solr", "q")).alias("q"), emptied.alias("emptied"))


@query("""
WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'no control' WHEN c_custkey % 13 = 0 THEN 'processed' WHEN c_custkey % 7 = 0 THEN 'no integration' WHEN c_custkey % 5 = 0 THEN 'no query' ELSE '' END AS reason FROM customer)
SELECT k AS c_custkey, reason, CASE WHEN reason = '' THEN 'old words ' || k ELSE '' END AS query,
  CASE WHEN reason = '' THEN 'https://site.example/find?id=' || k || '&tx_solr%5Bq%5D=old%20words%20' || k || '&tx_solr%5Bsort%5D%5Bby%5D=t' || CASE WHEN k % 2 = 0 THEN '&tx_solr%5Bsort%5D%5Bway%5D=up' ELSE '' END || '&ai=s' || k || '#top' END AS url FROM r""")
def request_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _requests(spark, sf_dir).withColumn("parameters", requests.parameters_column(F.col("query"), F.col("body")))
    out = requests.redirect_column(F.col("url"), F.col("parameters"), F.col("control"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")))
    return rows.select("c_custkey", out.alias("r")).select("c_custkey", "r.*")


# --- what a browser captures
def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer as the rows of a result page, in JSON; of some customers no list."""
    k = F.col("o_orderkey")
    row = F.to_json(F.struct(k.cast("string").alias("uid"), F.when(k % 3 == 0, "").otherwise("order").alias("type"), F.concat(F.lit("<b>Order</b> &amp; "), F.col("o_orderpriority")).alias("title"), F.concat(F.lit("<p>a  "), F.repeat(F.lit("🙂"), (k % 3).cast("int")), F.lit("</p>")).alias("text"), F.when(k % 4 == 0, F.lit("0.25")).when(k % 4 == 1, F.lit("NaN")).otherwise(F.lit("")).alias("score"), F.lit("/x").alias("url"), F.lit("17").alias("pageId"), F.lit("no").alias("changedAt")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))), lambda r: r["row"]), ",")
    grouped = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("result_group")).agg(listed.alias("rows"))
    return grouped.withColumn("rows", F.when(F.col("result_group") % 9 == 0, F.lit('{"rows":1}')).otherwise(F.concat(F.lit("["), "rows", F.lit("]"))))


_CAPTURED = """
o AS (SELECT o_custkey AS result_group, o_orderkey AS k, o_orderpriority AS p, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS position FROM orders WHERE o_custkey % 9 <> 0),
c AS (SELECT result_group, 'solr:' || CASE WHEN k % 3 = 0 THEN '' ELSE 'order:' END || k AS id, CASE WHEN k % 4 = 0 THEN 0.25 ELSE round(greatest(0.0::DOUBLE, 1 - 0.01::DOUBLE * (position - 1)), 6) END AS score, trim('a ' || repeat('🙂', k % 3)) AS text, 'Order & ' || p AS title, '/x' AS url,
  CASE WHEN k % 3 = 0 THEN '' ELSE 'order' END AS source_type, CAST(k AS VARCHAR) AS source_uid, 17::BIGINT AS page_id, 0::BIGINT AS changed_at, position FROM o)
"""


@query(f"WITH {_CAPTURED} SELECT * FROM c")
def browser_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.results(captures.parse_rows(_captures(spark, sf_dir), {"id": "uid", "title": ""}), "solr")


@query(f"""
WITH {_CAPTURED},
t AS (SELECT result_group, count(*) AS total FROM c GROUP BY 1)
SELECT result_group, total, TRUE AS may, result_group % 2 = 0 AS allowed, 'typed words' AS effective_query, total AS n_passages FROM t""")
def retrieval_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's payload, whether it may be processed, and what is stored of it."""
    found = captures.results(captures.parse_rows(_captures(spark, sf_dir)), "solr")
    made = captures.payloads(found, "solr", "typed words")
    stored = captures.retrieval_groups(found.select("result_group"), made)
    plan = F.when(F.col("result_group") % 2 == 0, F.array(F.lit("search"))).otherwise(F.array(F.lit("other")))
    none = F.lit(None).cast("array<string>")
    total = F.try_variant_get(F.try_parse_json("payload"), "$.total", "long")
    return stored.select("result_group", total.alias("total"), captures.may_process(none, F.col("payload")).alias("may"), captures.may_process(plan, F.col("payload")).alias("allowed"), "effective_query", "n_passages")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def payload_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user whose type, as a payload, is not that of the one before."""
    stream = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.to_json(F.struct("event_type")).alias("payload"))
    return captures.changed_payloads(stream, "user_id", "event_id").drop("payload")


@query("SELECT event_id, CASE WHEN json_type(props) = 'OBJECT' AND event_id % 3 <> 0 THEN '{\"k\":' || json_extract(props, '$.k') || '}' ELSE '{}' END AS settings FROM events")
def json_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as they are; lists and text that is no JSON are {}."""
    raw = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, "[1]").otherwise("{no")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", requests.settings(raw).alias("settings"))
