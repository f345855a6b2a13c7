"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import ann, bpe, chat_tools, decontam, langid, pii, secrets, simhash, token_count, url_filter
from quire.llm._common import table

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), token_count.load_pieces(public_tokenizers.path(vocabulary)))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op5_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.link(table(spark, sf_dir, "conversations"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), 20)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_pii, op3_token_counts, op4_url_filters, op5_tool_links, op6_simhash, op7_secrets, op8_nearest, op9_decontamination, op10_byte_bpe)}


def _quote_sql(column: str) -> str:
    out = f"replace(replace({column}, '\\', '\\\\'), '\"', '\\\"')"
    for code in range(1, 32):
        out = f"replace({out}, chr({code}), '{ {8: chr(92) + 'b', 9: chr(92) + 't', 10: chr(92) + 'n', 12: chr(92) + 'f', 13: chr(92) + 'r'}.get(code, chr(92) + f'u{code:04X}') }')"
    return f"'\"' || {out} || '\"'"


#: for tables without explicit calls, as the supplied ones are: links by turns, each identifier used once
OP5_SQL = f"""
WITH t AS (SELECT conv_id, turn, role, {_quote_sql("coalesce(text, '')")} AS q, {_quote_sql('role')} AS qr FROM conversations),
u AS (SELECT conv_id, turn, q, role FROM t WHERE role = 'user'),
a AS (SELECT conv_id, turn, q, role FROM t WHERE role = 'assistant')
SELECT conv_id, turn, 0 AS seq, 'message' AS kind, role, CAST(NULL AS VARCHAR) AS call_id, 'message' AS status, CAST(NULL AS BOOLEAN) AS args_valid, turn AS order_turn, 0 AS depth,
  '{{"content":' || q || ',"role":' || coalesce(qr, 'null') || ',"type":"message"}}' AS json FROM t
UNION ALL
SELECT u.conv_id, u.turn, 1, 'call', 'assistant', 'turn:' || u.turn, CASE WHEN a.conv_id IS NULL THEN 'unanswered' ELSE 'linked' END, TRUE, u.turn, 1,
  '{{"arguments":{{"text":' || u.q || '}},"id":"turn:' || u.turn || '","name":"respond","type":"call"}}'
FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
UNION ALL
SELECT a.conv_id, a.turn, 1, 'result', 'tool', 'turn:' || (a.turn - 1), CASE WHEN u.conv_id IS NULL THEN 'orphan' ELSE 'linked' END, CAST(NULL AS BOOLEAN), a.turn, 2,
  '{{"content":' || a.q || ',"tool_call_id":"turn:' || (a.turn - 1) || '","type":"result"}}'
FROM a LEFT JOIN u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
"""

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWERED = f"regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^{_SEPARATORS}|{_SEPARATORS}$', '', 'g')"
_WORDS_SQL = f"CASE WHEN {_LOWERED} = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array({_LOWERED}, '{_SEPARATORS}') END"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT doc_id, item_id, i, windows.n FROM grams JOIN windows ON grams.g = windows.g AND grams.n = windows.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_tool_links": OP5_SQL, "op9_decontamination": OP9_SQL}
