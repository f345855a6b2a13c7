"""Chat formatting: tool-call linking, with DataFrame functions only.

A turn of the assistant may hold ``<tool_call>{"id", "name", "arguments"}
</tool_call>`` blocks; a turn of role ``tool`` is a JSON result with
``tool_call_id`` and ``content``.  Calls and results are joined by conversation
and identifier, arguments are checked against the tools' schemas, every row
gets a place in a topological order, and rows are written as canonical JSON
(keys sorted, no blanks, minimal escapes).

A conversation without explicit calls is linked by its turns: a user turn is a
call of ``respond`` with the argument ``text``, and the next turn, if the
assistant's, is its result.

Topological order: rows sort by (order_turn, depth, turn, seq).  A message
stands at its own turn.  A result stands at its own turn or at its call's place
if that is later, and deeper than it.  A call whose arguments name another
call's result ("$result:<id>") stands at its own turn or at that result's place
if that is later, and deeper than it, so it comes after that result; a result
that is missing counts as standing at its call's place.

Defined results: null conversations, turns, roles and texts are kept; a null
text is empty; blocks that are not JSON objects, or calls without id, are
calls with a null id and status ``malformed``; of calls (results) that share
an identifier the first by turn and seq counts, others have status
``duplicate``; a result without a call is an ``orphan``, a call without a
result ``unanswered``; calls that wait for each other have status ``cycle``;
an empty table gives an empty table.  A conversation of any size is never
gathered in one row or task; a text of any length is one row's value.  Of rows
that tie by turn and seq the one with the least hash counts as first, and equal
rows count as one.  Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._common import cut, drop

#: tool: parameter: (type, required); types as variants name them
SCHEMAS = {"respond": {"text": ("STRING", True)}}
_BLOCK = r"(?s)<tool_call>(.*?)</tool_call>"
_REFERENCE = r"\"\\$result:([^\"\\\\]+)\""


def quote(text: Column) -> Column:
    """A JSON string with the escapes that JSON demands and no others; null for null."""
    written = F.to_json(F.struct(text.alias("t")))  # {"t":"..."}
    return F.when(text.isNotNull(), F.substring(written, F.lit(6), F.length(written) - 6))


def _valid(name: Column, arguments: Column, schemas: dict) -> Column:
    """Whether the arguments (a variant) fit the named tool's schema: required ones there, types right, none unknown."""
    out = F.lit(False)
    for tool, parameters in schemas.items():
        ok = F.schema_of_variant(arguments).startswith("OBJECT<")
        for parameter, (kind, required) in parameters.items():
            path = f"$['{parameter}']"
            there = F.schema_of_variant(F.try_variant_get(arguments, path, "variant"))
            fits = there.startswith("DECIMAL") | there.isin("BIGINT", "DOUBLE", "FLOAT") if kind == "NUMBER" else there.startswith(kind)
            ok = ok & (F.coalesce(fits, F.lit(False)) if required else F.coalesce(fits, F.lit(True)))
        names = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>"))
        ok = ok & (F.size(F.array_except(names, F.array(*map(F.lit, parameters)).cast("array<string>"))) == 0)
        out = F.when(name == tool, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _explicit(turns: DataFrame, schemas: dict) -> tuple[DataFrame, DataFrame]:
    blocks = turns.where("role = 'assistant' AND instr(text, '<tool_call>') > 0").select("conv_id", "turn", "row", F.posexplode(F.regexp_extract_all("text", F.lit(_BLOCK), F.lit(1))).alias("seq", "block"))
    calls = blocks.withColumn("v", F.try_parse_json(F.trim("block"))).withColumn("arguments", F.try_variant_get("v", "$.arguments", "variant"))
    calls = calls.select("conv_id", "turn", "row", (F.col("seq") + 1).alias("seq"), F.try_variant_get("v", "$.id", "string").alias("id"), F.try_variant_get("v", "$.name", "string").alias("name"), F.to_json("arguments").alias("arguments"), F.col("arguments").alias("av"))
    calls = calls.select("conv_id", "turn", "row", "seq", "id", "name", "arguments", _valid(F.col("name"), F.col("av"), schemas).alias("args_valid"))
    v = F.try_parse_json("text")
    results = turns.where("role = 'tool'").select("conv_id", "turn", "row", F.lit(1).alias("seq"), F.try_variant_get(v, "$.tool_call_id", "string").alias("id"), F.coalesce(F.to_json(F.try_variant_get(v, "$.content", "variant")), quote(F.coalesce("text", F.lit("")))).alias("content"))
    return calls, results


def _implicit(turns: DataFrame, schemas: dict) -> tuple[DataFrame, DataFrame]:
    """User turns as calls of respond and the turns right after them, if the assistant's, as results; by identifier ``turn:<n>``."""
    text = F.coalesce("text", F.lit(""))
    calls = turns.where("role = 'user' AND turn IS NOT NULL").select("conv_id", "turn", "row", F.lit(1).alias("seq"), F.concat(F.lit("turn:"), F.col("turn").cast("string")).alias("id"), F.lit("respond").alias("name"), F.concat(F.lit('{"text":'), quote(text), F.lit("}")).alias("arguments"))
    calls = calls.withColumn("args_valid", _valid(F.col("name"), F.try_parse_json("arguments"), schemas))
    results = turns.where("role = 'assistant' AND turn IS NOT NULL").select("conv_id", "turn", "row", F.lit(1).alias("seq"), F.concat(F.lit("turn:"), (F.col("turn") - 1).cast("string")).alias("id"), quote(text).alias("content"))
    return calls, results


def _first(df: DataFrame) -> DataFrame:
    """Of each identifier the first row, by turn and seq; sums before the shuffle, so repeats do not multiply."""
    return df.where("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "seq", "row")).alias("first"), F.count("*").alias("n"))


def _levels(calls: DataFrame, first_call: DataFrame, first_result: DataFrame) -> DataFrame:
    """conv_id, id, level, after, waits: how many results stand before a call, along the longest chain of references, and the last place of those it names.

    Only calls that name results, and those named, take part.  A round hands the
    places settled by the one before to the calls that name them and settles
    those that wait for nothing more; what it settles and what still waits are
    written to the shared folder.  What is left when a round settles nothing is
    a cycle or waits for one.
    """
    key = ["conv_id", "id"]
    refs = calls.where(F.col("id").isNotNull() & F.col("arguments").contains("$result:")).select(*key, F.explode(F.expr(f"regexp_extract_all(arguments, '{_REFERENCE}', 1)")).alias("ref")).distinct()
    refs = cut(refs.join(first_call.select("conv_id", F.col("id").alias("ref")), ["conv_id", "ref"], "left_semi"))
    nothing = F.lit(None).cast("long")
    if refs.isEmpty():
        return refs.select(*key, F.lit(0).alias("level"), nothing.alias("after"), F.lit(False).alias("waits"))
    named = refs.select("conv_id", F.col("ref").alias("id")).union(refs.select(*key)).distinct()
    own = first_call.select(*key, F.col("first.turn").alias("call")).join(named, key, "left_semi").join(first_result.select(*key, F.col("first.turn").alias("result")), key, "left")
    own = own.select(*key, F.greatest("call", "result").alias("own"))
    waiting = refs.groupBy(*key).agg(F.count("*").alias("open"))
    all_ = cut(own.join(waiting, key, "left").select(*key, "own", F.lit(0).alias("level"), nothing.alias("after"), F.coalesce("open", F.lit(0).cast("long")).alias("open")))
    fresh, state, done = all_.where("open = 0"), all_.where("open > 0"), []
    while True:
        place = F.greatest("own", "after").alias("place")  # of the result; nulls do not count
        told = refs.join(fresh.select("conv_id", F.col("id").alias("ref"), "level", place), ["conv_id", "ref"])
        told = told.groupBy(*key).agg((F.max("level") + 1).alias("_level"), F.max("place").alias("_place"), F.count("*").alias("_told"))
        now = cut(state.join(told, key, "left").select(*key, "own", F.greatest("level", "_level").alias("level"), F.greatest("after", "_place").alias("after"), (F.col("open") - F.coalesce("_told", F.lit(0))).alias("open")))
        fresh, old, state = cut(now.where("open = 0")), state, now.where("open > 0")
        drop(old)
        if fresh.isEmpty():
            break
        done.append(fresh)
    out = state.select(*key, F.lit(0).alias("level"), nothing.alias("after"), F.lit(True).alias("waits"))
    for part in done:
        out = out.unionByName(part.select(*key, "level", "after", F.lit(False).alias("waits")))
    return out


def link(conversations: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, turn, seq, kind, role, call_id, status, args_valid, order_turn, depth, json: messages, calls and results."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # tells repeated rows apart without numbering them in a window: equal rows share it
    turns = turns.withColumn("row", F.xxhash64("conv_id", "turn", "role", "text"))
    special = turns.where("role = 'tool' OR role = 'assistant' AND instr(text, '<tool_call>') > 0").select("conv_id").distinct()
    plain = turns.join(special, turns["conv_id"].eqNullSafe(special["conv_id"]), "left_anti")
    # written once: what follows reads them several times
    calls, results = (cut(a.unionByName(b)) for a, b in zip(_explicit(turns, schemas), _implicit(plain, schemas)))
    first_call, first_result = _first(calls), _first(results)
    levels = _levels(calls, first_call, first_result)
    key = ["conv_id", "id"]
    c = calls.join(first_call.select(*key, F.col("first").alias("call")), key, "left").join(first_result.select(*key, F.col("first").alias("result")), key, "left").join(levels, key, "left")
    mine = F.struct("turn", "seq", "row")
    status = F.when(F.col("id").isNull(), "malformed").when(F.coalesce("waits", F.lit(False)), "cycle").when(mine != F.col("call"), "duplicate").when(F.col("result").isNull(), "unanswered").otherwise("linked")
    depth = 1 + 2 * F.coalesce("level", F.lit(0))
    written = F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), F.coalesce(quote(F.col("id")), F.lit("null")), F.lit(',"name":'), F.coalesce(quote(F.col("name")), F.lit("null")), F.lit(',"type":"call"}'))
    c = c.select("conv_id", "turn", "seq", F.lit("call").alias("kind"), F.lit("assistant").alias("role"), F.col("id").alias("call_id"), status.alias("status"), "args_valid", F.greatest("turn", "after").alias("order_turn"), depth.cast("int").alias("depth"), written.alias("json"))
    r = results.join(first_result.select(*key, F.col("first").alias("result")), key, "left").join(first_call.select(*key, F.col("first").alias("call")), key, "left").join(levels, key, "left")
    status = F.when(F.col("id").isNull(), "malformed").when(F.col("call").isNull(), "orphan").when(mine != F.col("result"), "duplicate").otherwise("linked")
    written = F.concat(F.lit('{"content":'), "content", F.lit(',"tool_call_id":'), F.coalesce(quote(F.col("id")), F.lit("null")), F.lit(',"type":"result"}'))
    r = r.select("conv_id", "turn", "seq", F.lit("result").alias("kind"), F.lit("tool").alias("role"), F.col("id").alias("call_id"), status.alias("status"), F.lit(None).cast("boolean").alias("args_valid"), F.greatest("turn", F.col("call.turn"), "after").alias("order_turn"), (2 + 2 * F.coalesce("level", F.lit(0))).cast("int").alias("depth"), written.alias("json"))
    written = F.concat(F.lit('{"content":'), quote(F.coalesce("text", F.lit(""))), F.lit(',"role":'), F.coalesce(quote(F.col("role")), F.lit("null")), F.lit(',"type":"message"}'))
    m = turns.select("conv_id", "turn", F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("status"), F.lit(None).cast("boolean").alias("args_valid"), F.col("turn").alias("order_turn"), F.lit(0).alias("depth"), written.alias("json"))
    return m.unionByName(c).unionByName(r)


def schemas_from_json(text: str) -> dict:
    """Schemas from {"tool": {"parameter": ["TYPE", required]}}."""
    return {tool: {p: (kind, bool(required)) for p, (kind, required) in parameters.items()} for tool, parameters in json.loads(text).items()}
