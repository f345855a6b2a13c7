"""Queries on stored state, clean-up and products, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import cleanup, configs, positions, products, state
from quire.plans.sql import AT
from quire.sources import shop
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


BEFORE, LIMIT = 1_704_500_000, 40
_STORED = (1_704_200_000, "50")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changed products of an indexer for each type: some inactive, some without content, some without an id."""
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 97 == 0, " ").otherwise(F.col("event_id").cast("string"))
    content = F.when(F.col("event_id") % 13 == 0, "").otherwise(F.concat(F.lit("body "), (F.col("event_id") % 5).cast("string")))
    return e.select(F.lit("shop").alias("connector"), F.col("event_type").alias("indexer"), key.alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (F.col("value") >= 20).alias("active"), content.alias("content"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored state for each indexer but the first by name, which begins anew."""
    kinds = table(spark, sf_dir, "events").select(F.lit("shop").alias("connector"), F.col("event_type").alias("indexer")).distinct()
    zero = F.lit(0).cast("long")
    stored = kinds.where("indexer > 'click'").select("*", F.lit(_STORED[0]).cast("long").alias("cursor_at"), F.lit(_STORED[1]).alias("cursor_id"), F.lit("ok").alias("status"), F.lit("").alias("message"), *[zero.alias(c) for c in state.COUNTERS])
    return state.get_or_create(kinds, stored)


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir)
    # what a run before this one has stored
    known = changes.where("id <> ' ' AND id % 11 = 0").select("connector", "indexer", "id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))
    return state.plan(changes, _states(spark, sf_dir), BEFORE, LIMIT, now=BEFORE, lookback_days=20_000, stored=known)


_PLAN = f"""
c AS (SELECT event_type AS indexer, CASE WHEN event_id % 97 = 0 THEN ' ' ELSE CAST(event_id AS VARCHAR) END AS id, {AT} AS t, coalesce(value >= 20, TRUE) AS active, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'body ' || (event_id % 5) END AS content, event_id FROM events),
s AS (SELECT DISTINCT event_type AS indexer, CASE WHEN event_type > 'click' THEN {_STORED[0]} ELSE 0 END::BIGINT AS cursor_at, CASE WHEN event_type > 'click' THEN '{_STORED[1]}' ELSE '' END AS cursor_id FROM events),
w AS (SELECT c.*, row_number() OVER (PARTITION BY indexer ORDER BY t, id) AS n FROM c JOIN s USING (indexer)
  WHERE trim(id) <> '' AND (t > cursor_at OR t = cursor_at AND (cursor_id = '' OR id > cursor_id)) AND t < {BEFORE} AND t >= CASE WHEN cursor_at > 0 THEN cursor_at ELSE {BEFORE} - 20000 * 86400 END),
m AS (SELECT indexer, max(n) > {LIMIT} AS has_more FROM w GROUP BY indexer),
p AS (SELECT w.indexer, id, t, sha256(content) AS content_hash, CASE WHEN NOT active THEN 'removed' WHEN content = '' THEN 'failed' WHEN event_id % 11 = 0 THEN 'unchanged' ELSE 'indexed' END AS outcome, has_more FROM w JOIN m USING (indexer) WHERE n <= {LIMIT}
  UNION ALL SELECT indexer, id, t, NULL, 'invalid', FALSE FROM c WHERE trim(id) = ''),
a AS (SELECT s.indexer, coalesce(max(t) FILTER (outcome <> 'invalid'), any_value(cursor_at)) AS cursor_at, coalesce(arg_max(id, t * 1000000 + try_cast(id AS BIGINT)) FILTER (outcome <> 'invalid'), any_value(cursor_id)) AS cursor_id,
  count(*) FILTER (outcome IN ('indexed', 'removed', 'unchanged', 'failed')) AS processed, count(*) FILTER (outcome = 'indexed') AS indexed, count(*) FILTER (outcome IN ('removed', 'unchanged')) AS skipped,
  count(*) FILTER (outcome IN ('failed', 'invalid')) AS failed, count(*) FILTER (outcome = 'removed') AS removed, coalesce(bool_or(has_more), FALSE) AS has_more FROM s LEFT JOIN p USING (indexer) GROUP BY s.indexer)
"""


@query(f"WITH {_PLAN} SELECT 'shop' AS connector, indexer, id, t AS at, content_hash, outcome, has_more FROM p")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir)


@query(f"WITH {_PLAN} SELECT 'shop' AS connector, indexer, cursor_at, cursor_id, 'ok' AS status, '' AS message, processed, indexed, skipped, failed, removed, indexed * 2 AS chunks, has_more, cursor_at || '|' || cursor_id AS next_cursor FROM a")
def incremental_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planned(spark, sf_dir)
    chunks = _changes(spark, sf_dir).where("trim(id) <> ''").select("connector", "indexer", "id", F.lit(2).cast("long").alias("n"))
    return state.advance(_states(spark, sf_dir), rows, chunks=chunks)


@query(f"""WITH {_PLAN} SELECT 'shop' AS connector, indexer,
  '{{"status":"ok","indexer":"' || indexer || '","result":{{"processed":' || processed || ',"indexed":' || indexed || ',"skipped":' || skipped || ',"failed":' || failed || ',"removed":' || removed || ',"chunks":0,"nextCursor":"' || cursor_at || '|' || cursor_id || '","hasMore":' || has_more || '}}}}' AS json,
  'Processed: ' || processed || ', Indexed: ' || indexed || ', Skipped: ' || skipped || ', Failed: ' || failed || ', Removed: ' || removed || ', Chunks: 0, Next cursor: ' || cursor_at || '|' || cursor_id || ', Has more: ' || CASE WHEN has_more THEN 'yes' ELSE 'no' END AS line FROM a""")
def incremental_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.report(state.advance(_states(spark, sf_dir), _planned(spark, sf_dir)))


@query(f"WITH {_PLAN} SELECT CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(indexed) AS BIGINT) AS indexed, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(removed) AS BIGINT) AS removed, 0::BIGINT AS chunks, bool_or(has_more) AS has_more FROM a")
def incremental_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.total(state.advance(_states(spark, sf_dir), _planned(spark, sf_dir)))


@query(f"""
SELECT 'shop' AS connector, indexer, CASE WHEN odd THEN 7 WHEN later THEN {_STORED[0]} ELSE 0 END::BIGINT AS cursor_at, CASE WHEN odd THEN 'x' WHEN later THEN '{_STORED[1]}' ELSE '' END AS cursor_id,
  CASE WHEN odd THEN 'error' WHEN later THEN 'ok' ELSE 'new' END AS status, CASE WHEN odd THEN 'no answer' ELSE '' END AS message
FROM (SELECT DISTINCT event_type AS indexer, event_type > 'click' AS later, length(event_type) % 2 = 1 AS odd FROM events)""")
def saved_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of which some are replaced after a failed run with an explicit cursor."""
    stored = _states(spark, sf_dir)
    changed = state.failed(state.resolve_cursors(stored.where("length(indexer) % 2 = 1"), explicit=(7, "x")), "no answer")
    return state.save(stored, changed).select("connector", "indexer", "cursor_at", "cursor_id", "status", "message")


# --- clean-up
@query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE doc_id > 20 ORDER BY doc_id LIMIT 120),
b AS (SELECT *, count(*) OVER () >= 120 AS has_more FROM r)
SELECT doc_id, source, CAST((n - 1) // 50 AS INTEGER) AS batch, has_more, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped' ELSE 'removed' END AS status FROM b""")
def cleanup_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return cleanup.next_batch(docs, table(spark, sf_dir, "labels"), "doc_id", 20, 120, 50)


@query("""
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'stored' ELSE 'removed' END AS status, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'old error' ELSE '' END AS error FROM documents""")
def soft_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.incremental import reconcile

    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("stored").alias("status"), F.lit("old error").alias("error"))
    gone = reconcile(docs.select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")
    return cleanup.soft_delete(docs, gone, "doc_id")


_HASH = "sha256(concat_ws('|', 'doc', CAST(doc_id AS VARCHAR), coalesce(lang, '')))"


@query(f"""
WITH h AS (SELECT doc_id, {_HASH} AS own FROM documents)
SELECT own AS source_hash, 1 AS number, 'a' AS text FROM h WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id % 2 = 1
UNION ALL SELECT own, 1, 'new ' || doc_id FROM h WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id % 2 = 0
UNION ALL SELECT own, 2, 'more' FROM h WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id % 2 = 0""")
def vector_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents; those that are gone are deleted, and those with even numbers replaced by two chunks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", cleanup.source_hash(F.lit("doc"), F.col("doc_id"), F.col("lang")).alias("own"))
    vectors = docs.select(F.col("own").alias("source_hash"), F.lit(1).alias("number"), F.lit("a").alias("text"))
    here = table(spark, sf_dir, "labels").select("doc_id").distinct()
    gone = docs.join(here, "doc_id", "left_anti").select(F.explode(cleanup.source_hashes(F.col("own"), F.lit(" "))).alias("source_hash"))
    kept = cleanup.delete_hashes(vectors, gone)
    fresh = docs.join(here, "doc_id", "left_semi").where("doc_id % 2 = 0")
    chunk = F.explode(F.array(F.struct(F.lit(1).alias("number"), F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("text")), F.struct(F.lit(2).alias("number"), F.lit("more").alias("text"))))
    return cleanup.put_documents(kept, fresh.select(F.col("own").alias("source_hash"), chunk.alias("c")).select("source_hash", "c.*"))


# --- products
def _products(part: DataFrame) -> DataFrame:
    """Parts as products in JSON: some without name, time or id, some with translations, categories and custom fields."""
    key = F.col("p_partkey")
    text = lambda c: F.to_json(F.struct(c.alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("t")))) - 6)
    pieces = [
        F.concat(F.lit('"id":"'), F.when(key % 50 == 7, "").otherwise(key.cast("string")), F.lit('"')),
        F.concat(F.lit('"updatedAt":'), F.when(key % 40 == 3, F.lit("null")).otherwise(F.lit('"2024-03-01T10:00:00.500+00:00"'))),
        F.when(key % 40 != 3, F.lit('"createdAt":"2020-01-01T00:00:00Z"')),
        F.concat(F.lit('"name":'), text(F.col("p_name"))),
        F.when(key % 3 == 0, F.concat(F.lit('"translated":{"name":'), text(F.concat(F.lit(" T "), F.col("p_name"))), F.lit(',"description":"<p>About <b>it</b></p>"}'))),
        F.concat(F.lit('"productNumber":"N-'), key.cast("string"), F.lit('"')),
        F.concat(F.lit('"manufacturer":{"name":'), text(F.col("p_brand")), F.lit("}")),
        F.concat(F.lit('"categories":[{"name":'), text(F.col("p_type")), F.lit('},{"translated":{"name":"Second"},"name":"x"},{"name":"Second"},{"name":" "}]')),
        F.when(key % 2 == 0, F.concat(F.lit('"customFields":{"phone":"+49 '), F.col("p_size").cast("string"), F.lit('","contact":"Ann","size":'), F.col("p_size").cast("string"), F.lit(',"list":[1],"none":null}'))),
        F.when(key % 5 == 0, F.lit('"active":false')),
        F.concat(F.lit('"properties":[{"group":{"name":"G"},"v":'), F.col("p_size").cast("string"), F.lit('},{"v":true},{"v":{}}]')),
    ]
    return part.select(F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}")).alias("product"))


_PRODUCT = """
t AS (SELECT *, CASE WHEN p_partkey % 50 = 7 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS source_id, CASE WHEN p_partkey % 40 = 3 THEN 0 ELSE 1709287200 END::BIGINT AS changed_at, CASE WHEN p_partkey % 3 = 0 THEN trim('T ' || p_name) ELSE trim(p_name) END AS title FROM part),
body AS (SELECT *, concat_ws(chr(10) || chr(10), title, CASE WHEN p_partkey % 3 = 0 THEN 'About it' END, 'Product number: N-' || p_partkey, 'Manufacturer: ' || trim(p_brand),
  CASE WHEN p_partkey % 2 = 0 THEN 'Custom fields:' || chr(10) || 'phone: +49 ' || p_size || chr(10) || 'size: ' || p_size END,
  'Additional fields:' || chr(10) || 'properties[].v: ' || CASE WHEN p_size = 1 THEN '1' ELSE p_size || ', 1' END || chr(10) || 'productNumber: N-' || p_partkey) AS text FROM t)
"""


@query(f"""
WITH {_PRODUCT}
SELECT source_id, changed_at, p_partkey % 5 <> 0 AS active, CASE WHEN source_id <> '' AND changed_at > 0 THEN text END AS content, CASE WHEN source_id <> '' AND changed_at > 0 THEN sha256(text) END AS content_hash,
  title, 'shop' AS product_title, '["' || trim(p_type) || '","Second"]' AS category, CASE WHEN p_partkey % 2 = 0 THEN '+49 ' || p_size END AS phone, trim(p_type) AS department, CASE WHEN source_id = '' THEN 'https://shop.example/detail/' ELSE 'https://shop.example/detail/' || source_id END AS url FROM body""")
def product_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = positions.spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    made = products.build(_products(dealt), "https://shop.example/", "detail", ["phone", "size"], ["properties[].v", "productNumber", "nothing"], {"product_title": "shop"}, 3)
    names = ("title", "product_title", "category", "phone", "department", "url")
    return made.select("source_id", "changed_at", "active", "content", "content_hash", *[F.col("metadata")[n].alias(n) for n in names])


@query("""
SELECT source_id AS id, title AS name, 'N-' || p_partkey AS product_number, p_partkey % 5 <> 0 AS active, updated AS updated_at, '- ' || source_id || ' | ' || title || ' | N-' || p_partkey || ' | ' || CASE WHEN p_partkey % 5 <> 0 THEN 'active' ELSE 'inactive' END || ' | ' || updated AS line
FROM (SELECT p_partkey, CASE WHEN p_partkey % 50 = 7 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS source_id, CASE WHEN p_partkey % 3 = 0 THEN trim('T ' || p_name) ELSE trim(p_name) END AS title, CASE WHEN p_partkey % 40 = 3 THEN '' ELSE '2024-03-01T10:00:00.500+00:00' END AS updated FROM part WHERE p_partkey % 50 <> 7)
ORDER BY updated, source_id LIMIT 25""")
def product_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.preview(_products(table(spark, sf_dir, "part")).where("product NOT LIKE '{\"id\":\"\"%'"), 400)


@query(f"""
WITH f AS (SELECT event_id AS id, user_id, {AT} AS updated_at FROM events WHERE event_id % 4 <> 0 AND {AT} >= 1704100000 AND {AT} < 1704600000)
SELECT id, user_id, updated_at, strftime(make_timestamp(updated_at * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS since, (SELECT count(*) FROM f) AS total FROM f ORDER BY updated_at, id LIMIT 101 OFFSET 101""")
def product_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of top-level rows of a span, with the count of all."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("updated_at"), F.when(F.col("event_id") % 4 == 0, F.col("user_id")).alias("parent_id"))
    found = shop.search_table(rows, 1_704_100_000, 1_704_600_000, page=2, limit=100, total=True)
    return found.select("id", "user_id", "updated_at", shop.since_text(F.col("updated_at")).alias("since"), "total")


@query("""
SELECT p_partkey AS product_id, CASE WHEN p_partkey % 4 <> 0 THEN 'https://media.example/' || (p_partkey % 7) END AS cover_url, concat_ws(';', n1, n2) AS properties
FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN coalesce(CASE WHEN p_size % 5 < 3 THEN 'group ' || (p_size % 5) END, '?') || '=' || p_size END AS n1, CASE WHEN p_partkey % 2 = 0 THEN NULL END AS n2 FROM part)""")
def product_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "product_id")
    covers = part.where("product_id % 4 <> 0").select("product_id", (F.col("product_id") % 7).alias("media_id"))
    media = part.select((F.col("product_id") % 7).alias("media_id")).distinct().withColumn("url", F.concat(F.lit("https://media.example/"), F.col("media_id").cast("string")))
    properties = part.where("product_id % 2 = 0").select("product_id", (F.col("p_size") % 5).alias("group_id"), F.col("p_size").cast("string").alias("name"))
    groups = part.select((F.col("p_size") % 5).alias("group_id")).distinct().where("group_id < 3").withColumn("group", F.concat(F.lit("group "), F.col("group_id").cast("string")))
    made = products.associations(part, covers, media, properties, groups)
    shown = F.concat_ws(";", F.transform("properties", lambda p: F.concat(F.coalesce(p["group"], F.lit("?")), F.lit("="), p["name"])))
    return made.select("product_id", "cover_url", shown.alias("properties"))


# --- configurations
def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    blank = lambda m, text: F.when(k % m == 0, " ").otherwise(F.lit(text))
    return s.select(k.cast("int").alias("uid"), F.when(k % 2 == 0, "files").otherwise("shop").alias("identifier"), F.when(k % 3 == 0, "external").otherwise("page").alias("kind"), (k % 4 != 0).alias("enabled"), blank(5, "docs").alias("collection"), F.concat(F.lit(" https://s"), k.cast("string"), F.lit(".example// ")).alias("base_url"), blank(7, "client").alias("client_id"), F.lit("key").alias("api_key"), F.concat(F.lit("config "), k.cast("string")).alias("title"), (k * 10).alias("chunk_size"), k.alias("chunk_overlap"), F.lit(3).alias("max_chunks"), F.lit(1).alias("min_chunk_chars"))


@query("""
SELECT CAST(s_suppkey AS INTEGER) AS uid, 'https://s' || s_suppkey || '.example' AS base_url, CASE WHEN s_suppkey % 5 = 0 THEN 'no collection' WHEN s_suppkey % 7 = 0 THEN 'incomplete credentials' END AS skipped_for, s_suppkey % 4 <> 0 AS enabled FROM supplier WHERE s_suppkey % 3 = 0""")
def config_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No configuration has the identifier, so fitting ones of the kind are taken; each is checked."""
    found = configs.resolve(_configs(spark, sf_dir), "unknown", "external", F.col("base_url").isNotNull())
    return configs.guarded(found).select("uid", configs.base_url(F.col("base_url")).alias("base_url"), "skipped_for", "enabled")


@query("""
SELECT * FROM (SELECT 'requested' AS how, CAST(s_suppkey AS INTEGER) AS uid, 'config ' || s_suppkey AS title, CAST(s_suppkey * 10 AS INTEGER) AS chunk_size, CAST(s_suppkey AS INTEGER) AS chunk_overlap, 3 AS max_chunks, 1 AS min_chunk_chars FROM supplier WHERE s_suppkey = 4)
UNION ALL SELECT * FROM (SELECT 'first', CAST(s_suppkey AS INTEGER), 'config ' || s_suppkey, CAST(s_suppkey * 10 AS INTEGER), CAST(s_suppkey AS INTEGER), 3, 1 FROM supplier WHERE s_suppkey % 2 = 0 ORDER BY s_suppkey LIMIT 1)
UNION ALL SELECT 'none', 0, 'service defaults', 0, 0, 0, 0""")
def chunk_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _configs(spark, sf_dir).where("identifier = 'files'")
    cases = (("requested", files, 4), ("first", files, 999), ("none", files.where("uid < 0"), 4))
    made = [configs.chunking(df, uid).select(F.lit(how).alias("how"), "*") for how, df, uid in cases]
    return made[0].unionByName(made[1]).unionByName(made[2])
