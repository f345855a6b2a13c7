"""DuckDB SQL for the registered queries."""

_SPACE = r"[\s\x0b\x{85}\p{Z}]+"


def collapse(column: str) -> str:
    return f"trim(regexp_replace({column}, '{_SPACE}', ' ', 'g'))"


def trimmed(column: str) -> str:
    return rf"regexp_replace({column}, '^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$', '', 'g')"


AT = "CAST(floor(epoch(ts)) AS BIGINT)"
FRESH = f"({AT} > 1704200000 OR ({AT} = 1704200000 AND CAST(event_id AS VARCHAR) > '50'))"
ENTRIES = r"""
w0 AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda s: s <> '') AS w FROM documents),
w1 AS (SELECT doc_id, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS i FROM w0),
entries AS (SELECT doc_id, CAST(i // 100 AS INTEGER) AS page_no, CAST(i % 100 AS INTEGER) AS entry_idx, 20.0::DOUBLE + 330.0::DOUBLE * (i % 100 % 2) AS x, 800.0::DOUBLE - 14.0::DOUBLE * ((i % 100) // 2) AS y, text FROM w1)
"""
_CHUNKS = f"""
flat AS (SELECT doc_id, {collapse("coalesce(text, '')")} AS f FROM documents),
starts AS (SELECT doc_id, f, unnest(generate_series(0, greatest(0, len(f) - 51), 450)) AS start FROM flat WHERE f <> ''),
chunk AS (SELECT doc_id, CAST(start // 450 + 1 AS INTEGER) AS number, CAST(start AS INTEGER) AS start, CAST(start + len(substr(f, start + 1, 500)) AS INTEGER) AS stop, substr(f, start + 1, 500) AS text FROM starts)
"""
_LINES = r"list_filter(list_transform(string_split(b, chr(10)), lambda s: regexp_replace(s, '[ \t\n\r\x00\x0B]+$', '')), lambda s: " + trimmed("s") + " <> '')"
_PROSE = "array_to_string(list_transform(l, lambda s: " + trimmed("s") + "), chr(10))"
_JOIN = r"regexp_replace({}, '(\p{{L}})-[ \t]*\n[ \t]*(\p{{Ll}})', '\1\2', 'g')"

SQL = {
    "retrieval_topk_excerpts": """
WITH placed AS (SELECT source, doc_id, substr(coalesce(text, ''), 1, 6000) AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents),
scored AS (SELECT source, 'doc:' || doc_id AS id, position, text, round(greatest(0.0::DOUBLE, 1 - 0.01::DOUBLE * (position - 1)), 6) AS score FROM placed),
kept AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) AS k FROM scored WHERE text <> '' AND score >= 0.5),
chosen AS (SELECT * FROM kept WHERE k <= 10),
parts AS (SELECT id, term, string_split(lower(text), term) AS p FROM chosen, (VALUES ('der'), ('thing')) AS t(term)),
hits AS (SELECT id, term, p, unnest(generate_series(1, len(p) - 1)) AS i FROM parts),
starts AS (SELECT DISTINCT id, greatest(0, CAST(list_sum(list_transform(p[1:i], lambda s: len(s))) AS BIGINT) + (i - 1) * len(term) - 100) AS start FROM hits),
windows AS (SELECT id, start, substr(text, start + 1, 200) AS part FROM starts JOIN chosen USING (id)),
best AS (SELECT id, part, row_number() OVER (PARTITION BY id ORDER BY (CASE WHEN instr(lower(part), 'der') > 0 THEN 1 ELSE 0 END + CASE WHEN instr(lower(part), 'thing') > 0 THEN 1 ELSE 0 END) DESC, start) AS n FROM windows)
SELECT source AS result_group, c.id || '#excerpt-1' AS id, score, CASE WHEN b.id IS NULL THEN substr(c.text, 1, 200) ELSE trim(part, ' ' || chr(9) || chr(10) || chr(13) || chr(11)) END AS text
FROM chosen c LEFT JOIN best b ON b.id = c.id AND b.n = 1""",
    "captured_row_normalisation": """
SELECT o_custkey AS result_group, 'shop:order:' || o_orderkey AS id, round(greatest(0.0::DOUBLE, 1 - 0.01::DOUBLE * (row_number() OVER g - 1)), 6) AS score, coalesce(o_orderstatus, '') AS text, coalesce(o_orderpriority, '') AS title, '' AS url,
  CAST(o_orderkey AS VARCHAR) AS source_uid, CAST(row_number() OVER g AS INTEGER) AS position, 'all orders' AS effective_query, count(*) OVER (PARTITION BY o_custkey) AS total
FROM orders WINDOW g AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
    "incremental_keyset_batch": f"SELECT event_id, {AT} AS at FROM events WHERE {FRESH} AND {AT} < 1800000000 ORDER BY 2, CAST(event_id AS VARCHAR) LIMIT 100",
    "incremental_metrics": f"""
SELECT event_type AS config, count(*) FILTER (f) AS processed, count(*) FILTER (f AND a) AS indexed, count(*) FILTER (f AND NOT a) AS removed, count(*) FILTER (f AND NOT a) AS skipped, 0::BIGINT AS failed, count(*) FILTER (NOT f) AS late
FROM (SELECT event_type, {FRESH} AS f, coalesce(value >= 100, TRUE) AS a FROM events) GROUP BY event_type""",
    "latest_per_key_upsert": f"SELECT user_id, event_id, {AT} AS at, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "cleanup_anti_join": "SELECT doc_id, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped' ELSE 'removed' END AS status FROM documents",
    "association_expand": """
SELECT c_custkey, c_name, n_name, r_name, coalesce(n, 0) AS n_orders, coalesce(t, 0.0) AS total FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    "json_path_fields": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, 0 AS n_missing FROM events",
    "product_document": """
SELECT source_id, title, url, content, sha256(content) AS content_hash FROM (SELECT p_partkey AS source_id, trim(p_name) AS title, 'https://shop.example/detail/' || p_partkey AS url,
  concat_ws(chr(10) || chr(10), nullif(trim(p_name), ''), 'Product number: ' || p_partkey, 'Manufacturer: ' || trim(p_brand), 'type: ' || trim(p_type)) AS content FROM part)""",
    "structured_metadata": """
SELECT p_partkey, p_name AS contact_name, CASE WHEN p_size > 20 THEN p_brand END AS phone, p_type AS email, CASE WHEN p_size > 30 THEN p_type ELSE p_brand END AS department, TRUE AS contact_sensitive FROM part""",
    "text_normalise": rf"""
WITH a AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(160), ' '), chr(8239), ' '), chr(173), ''), chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl') AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(replace(replace(t, chr(64259), 'ffi'), chr(64260), 'ffl'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS t FROM a),
blocks AS (SELECT doc_id, unnest(s) AS b, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split_regex({trimmed("t")}, '\n[ \t]*\n+') AS s FROM c)),
lined AS (SELECT doc_id, i, {_LINES} AS l FROM blocks),
done AS (SELECT doc_id, i, CASE WHEN len(list_filter(l, lambda s: regexp_matches(s, '\S[ \t]{{2,}}\S'))) >= 2 OR len(list_filter(l, lambda s: regexp_matches(s, '^\s*(?:[-*]|\d+[.)])\s+\S'))) >= 2 OR len(list_filter(l, lambda s: contains(s, ' | '))) >= 2
  THEN array_to_string(l, chr(10)) ELSE {trimmed("regexp_replace(replace(" + _JOIN.format(_JOIN.format(_PROSE)) + ", chr(10), ' '), '[ \\t]+', ' ', 'g')")} END AS b FROM lined)
SELECT documents.doc_id, coalesce(string_agg(b, chr(10) || chr(10) ORDER BY i) FILTER (b <> ''), '') AS text FROM documents LEFT JOIN done ON documents.doc_id = done.doc_id GROUP BY documents.doc_id""",
    "query_terms": r"""
SELECT conv_id, turn, CAST(len(t) AS INTEGER) AS n_terms, array_to_string(t, ' ') AS terms
FROM (SELECT conv_id, turn, list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda s: len(s) > 1))) AS t FROM conversations)""",
    "html_text": rf"""SELECT page_id, {collapse("regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|</?[A-Za-z!?](?:" + chr(34) + "[^" + chr(34) + "]*" + chr(34) + "|''[^'']*''|[^''" + chr(34) + ">])*>', '', 'g')")} AS text FROM pages""",
    "chunks_with_offsets": f"WITH {_CHUNKS} SELECT * FROM chunk",
    "chunk_line_overlap": f"""
WITH {_CHUNKS},
parts AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: {collapse("s")}), lambda s: s <> '') AS p FROM documents),
cut AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS line FROM parts),
ended AS (SELECT doc_id, line, len(s) AS n, CAST(sum(len(s) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) - 1 AS stop FROM cut)
SELECT c.doc_id, number, string_agg(line, ',' ORDER BY line) AS lines FROM chunk c JOIN ended e ON c.doc_id = e.doc_id AND e.stop - e.n < c.stop AND e.stop > c.start GROUP BY c.doc_id, number""",
    "nearest_key": """
WITH keys AS (SELECT l_orderkey, l_quantity, min(l_linenumber) AS key FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
v AS (SELECT l_orderkey, l_linenumber AS value, l_quantity, row_number() OVER () AS id FROM lineitem WHERE l_returnflag <> 'R'),
ranked AS (SELECT v.*, key, row_number() OVER (PARTITION BY id ORDER BY abs(k.l_quantity - v.l_quantity), k.l_quantity DESC) AS n FROM v LEFT JOIN keys k ON v.l_orderkey = k.l_orderkey)
SELECT l_orderkey, value, l_quantity, key FROM ranked WHERE n = 1""",
    "dedup_rounded": f"WITH {ENTRIES} SELECT doc_id, page_no, count(*) AS n, max(entry_idx) AS last, round(sum(y + 0.3::DOUBLE * 10), 3) AS centres FROM entries GROUP BY doc_id, page_no",
    "page_documents": f"""
WITH {ENTRIES},
p AS (SELECT doc_id, page_no + 1 AS page_no, string_agg(text, ' ' ORDER BY entry_idx) AS text FROM entries GROUP BY ALL)
SELECT doc_id, page_no, doc_id || '#page-' || page_no AS source_id, count(*) OVER (PARTITION BY doc_id) AS page_count, 'https://docs.example/' || doc_id || '#page=' || page_no AS url, text FROM p""",
    "interval_union_gaps": """
WITH s AS (SELECT l_orderkey, l_quantity AS a, l_quantity + round(l_tax * 100) AS b FROM lineitem),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
u AS (SELECT l_orderkey, CAST(island AS BIGINT) AS island, min(a) AS start, max(b) AS stop FROM i GROUP BY ALL)
SELECT *, lead(start) OVER (PARTITION BY l_orderkey ORDER BY island) - stop AS gap_after FROM u""",
    "upper_median_gap": f"""
WITH g AS (SELECT user_id, {AT} - lag({AT}) OVER (PARTITION BY user_id ORDER BY {AT}, event_id) AS gap FROM events)
SELECT user_id, list_sort(list(gap))[count(*) // 2 + 1] AS upper_median, count(*) AS n FROM g WHERE gap > 0.5 GROUP BY user_id""",
    "greedy_clusters": """
WITH v AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
r AS (SELECT l_orderkey, list_reduce(q, lambda acc, x: CASE WHEN list_position(list_transform(acc, lambda c: abs(x - c.mean) <= 6.0), TRUE) > 0
  THEN list_transform(acc, lambda c, i: CASE WHEN i = list_position(list_transform(acc, lambda d: abs(x - d.mean) <= 6.0), TRUE) THEN {'mean': (c.mean * c.n + x) / (c.n + 1), 'n': c.n + 1} ELSE c END)
  ELSE list_append(acc, {'mean': x, 'n': 1}) END, CAST([] AS STRUCT(mean DOUBLE, n INTEGER)[])) AS c FROM v)
SELECT l_orderkey, CAST(i - 1 AS INTEGER) AS cluster, round(c[i].mean, 6) AS mean, c[i].n AS n FROM (SELECT l_orderkey, c, unnest(generate_series(1, len(c))) AS i FROM r)""",
    "html_first_href": r"""
WITH f AS (SELECT page_id, coalesce(html, '') AS html, regexp_extract(coalesce(html, ''), '(?i)<a\b[^>]*?\bhref\s*=\s*(?:"[^"'']*"|''[^"'']*'')') AS found FROM pages),
g AS (SELECT *, regexp_extract(found, '["'']([^"'']*)["'']$', 1) AS target, instr(html, found) AS at_ FROM f),
h AS (SELECT *, split_part(target, '#', 1) AS before FROM g)
SELECT page_id, CASE WHEN found = '' THEN html ELSE substr(html, 1, at_ - 1) || substr(found, 1, len(found) - len(target) - 1) || before || CASE WHEN contains(before, '?') THEN '&amp;' ELSE '?' END || 'q=der&amp;state=1' || substr(target, len(before) + 1) || right(found, 1) || substr(html, at_ + len(found)) END AS html FROM h""",
    "latest_active_per_key": f"SELECT user_id, event_id, {AT} AS at, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND value >= 50",
    "retrieval_two_excerpts": """
WITH d AS (SELECT source, doc_id, substr(coalesce(text, ''), 1, 6000) AS text, round(CASE WHEN doc_id % 4 = 0 THEN greatest(0.0::DOUBLE, 1 - 0.01::DOUBLE * (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)) ELSE (doc_id % 10) / 10.0::DOUBLE END, 6) AS score, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents),
kept AS (SELECT *, 'doc:' || doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY position) AS k FROM d WHERE text <> '' AND score >= 0.6),
chosen AS (SELECT * FROM kept WHERE k <= 5),
parts AS (SELECT id, term, string_split(lower(text), term) AS p FROM chosen, (VALUES ('der'), ('thing')) AS t(term)),
hits AS (SELECT id, term, p, unnest(generate_series(1, len(p) - 1)) AS i FROM parts),
starts AS (SELECT DISTINCT id, greatest(0, CAST(list_sum(list_transform(p[1:i], lambda s: len(s))) AS BIGINT) + (i - 1) * len(term) - 60) AS start FROM hits),
windows AS (SELECT id, start, least(len(text), start + 120) AS stop, substr(text, start + 1, 120) AS part FROM starts JOIN chosen USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (CASE WHEN instr(lower(part), 'der') > 0 THEN 1 ELSE 0 END + CASE WHEN instr(lower(part), 'thing') > 0 THEN 1 ELSE 0 END) DESC, start) AS n FROM windows),
one AS (SELECT * FROM ranked WHERE n = 1),
two AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.id ORDER BY r.n) AS m FROM ranked r JOIN one ON r.id = one.id AND (r.start >= one.stop OR r.stop <= one.start)) WHERE m = 1),
chosen2 AS (SELECT id, start, part FROM one UNION ALL SELECT id, start, part FROM two),
numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start) AS place FROM chosen2)
SELECT source AS result_group, c.id || '#excerpt-' || coalesce(place, 1) AS id, score, CASE WHEN b.id IS NULL THEN substr(c.text, 1, 120) ELSE trim(part, ' ' || chr(9) || chr(10) || chr(13) || chr(11)) END AS text
FROM chosen c LEFT JOIN numbered b ON b.id = c.id""",
    "joined_blocks": r"""
WITH b AS (SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda w: trim(CASE WHEN len(w) % 3 = 0 AND w <> '' THEN w || '-' ELSE w END)), lambda w: w <> '') AS w FROM conversations)
SELECT conv_id, turn, list_reduce(w, lambda done, x: CASE WHEN done = '' THEN x WHEN regexp_matches(done, '\p{L}-$') AND regexp_matches(x, '^\p{Ll}') THEN done[1:len(done) - 1] || x ELSE done || chr(10) || chr(10) || x END, '') AS text FROM b""",
    "list_entries": r"""
SELECT conv_id, turn, CAST(len(e) AS INTEGER) AS n, array_to_string(e, '|') AS entries FROM (
  SELECT conv_id, turn, list_sort(list_distinct(list_filter(list_transform(string_split_regex(replace(coalesce(text, ''), ' the ', ', '), '[\r\n,]+'), lambda t: trim(t)), lambda t: t <> ''))) AS e FROM conversations)""",
    "product_lookup": "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT doc_id FROM labels)",
}
