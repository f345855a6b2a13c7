import json
import random
import re

from compare import assert_same

from quire.llm import chat_tools, queries

SCHEMA = "conv_id long, turn int, role string, text string, id string, row string, seq int"
TOOLS = {"add": {"a": ("BIGINT", True), "b": ("NUMBER", False)}, "say": {"text": ("STRING", True)}}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 0) for r in rows], SCHEMA)


def call(id, name, **arguments):
    return "<tool_call>" + json.dumps({"id": id, "name": name, "arguments": arguments}) + "</tool_call>"


def test_query_by_sql(spark, small, duck):
    assert_same(queries.op5_tool_links(spark, small), duck(small, queries.OP5_SQL))


def test_every_row_of_the_query_is_canonical_json(spark, small):
    for row in queries.op5_tool_links(spark, small).collect():
        assert json.dumps(json.loads(row["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == row["json"].replace("\\u007F", "\x7f")


def test_explicit_calls(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", call("c1", "add", a=1, b=2.5) + call("c2", "add", a="x") + call("c3", "say", text="$result:c1")),
        (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": {"z": 1, "a": 2}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "nobody", "content": "?"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "c1", "content": "again"})),
        (1, 5, "assistant", call("p", "say", text="$result:q") + call("q", "say", text="$result:p") + call("p", "say", text="twice") + "<tool_call>no json</tool_call>"),
        (1, 6, "tool", json.dumps({"tool_call_id": "c3", "content": "done"})),
    ]
    out = chat_tools.link(frame(spark, rows), TOOLS).collect()
    calls = {(r["turn"], r["seq"]): r for r in out if r["kind"] == "call"}
    assert [calls[1, i]["status"] for i in (1, 2, 3)] == ["linked", "unanswered", "linked"]
    assert [calls[1, i]["args_valid"] for i in (1, 2, 3)] == [True, False, True]
    assert [calls[5, i]["status"] for i in (1, 2, 3, 4)] == ["cycle", "cycle", "cycle", "malformed"]
    results = {r["turn"]: r for r in out if r["kind"] == "result"}
    assert {t: r["status"] for t, r in results.items()} == {2: "linked", 3: "orphan", 4: "duplicate", 6: "linked"}
    assert results[2]["json"] == '{"content":{"a":2,"z":1},"tool_call_id":"c1","type":"result"}'
    order = sorted(out, key=lambda r: (r["order_turn"], r["depth"], r["turn"], r["seq"]))
    place = {(r["kind"], r["call_id"]): i for i, r in enumerate(order) if r["status"] == "linked"}
    assert place["call", "c1"] < place["result", "c1"]
    assert place["call", "c3"] < place["result", "c3"]
    assert calls[1, 3]["depth"] > results[2]["depth"]


def test_calls_come_after_the_results_they_name(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", call("c1", "add", a=1) + call("c3", "say", text="$result:c1") + call("c4", "say", text="$result:c3") + call("c5", "say", text="$result:c2")),
        (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": 1})),
        (1, 3, "tool", json.dumps({"tool_call_id": "c4", "content": "early"})),
        (1, 6, "tool", json.dumps({"tool_call_id": "c3", "content": "late"})),
        (1, 7, "assistant", call("c2", "add", a=1)),
        (2, 0, "assistant", call("c1", "say", text="$result:c3") + call("c3", "say", text="other")),
        (2, 1, "tool", json.dumps({"tool_call_id": "c3", "content": 2})),
    ]
    out = chat_tools.link(frame(spark, rows), TOOLS).collect()
    order = sorted(out, key=lambda r: (r["conv_id"], r["order_turn"], r["depth"], r["turn"], r["seq"]))
    place = {(r["conv_id"], r["kind"], r["call_id"]): i for i, r in enumerate(order)}
    assert place[1, "call", "c1"] < place[1, "result", "c1"] < place[1, "call", "c3"] < place[1, "result", "c3"] < place[1, "call", "c4"] < place[1, "result", "c4"]
    assert place[1, "call", "c2"] < place[1, "call", "c5"]  # that result is missing
    assert place[2, "call", "c3"] < place[2, "result", "c3"] < place[2, "call", "c1"]
    turns = {(r["kind"], r["call_id"]): r["order_turn"] for r in out if r["conv_id"] == 1}
    assert [turns["call", c] for c in ("c1", "c3", "c4", "c5")] == [1, 2, 6, 7] and turns["result", "c4"] == 6


def plain(rows, tools):
    """{(conv, turn, seq, kind): (call_id, status, args_valid, order_turn, depth)} of calls and results, by loops over one conversation after another."""
    out = {}
    for conv in {r[0] for r in rows}:
        calls, results = [], []
        for _, turn, role, text in sorted(r for r in rows if r[0] == conv):
            if role == "assistant":
                calls += [(turn, n + 1, json.loads(b)) for n, b in enumerate(re.findall("(?s)<tool_call>(.*?)</tool_call>", text))]
            elif role == "tool":
                results.append((turn, 1, json.loads(text)["tool_call_id"]))
        first, answer = {}, {}
        for turn, seq, c in calls:
            first.setdefault(c["id"], (turn, seq))
        for turn, seq, i in results:
            answer.setdefault(i, (turn, seq))
        names = {i: set() for i in first}
        for _, _, c in calls:
            names[c["id"]] |= {v[8:] for v in c["arguments"].values() if isinstance(v, str) and v.startswith("$result:")} & set(first)
        level, after = {}, {}
        while ready := [i for i in first if i not in level and names[i] <= set(level)]:
            for i in ready:
                level[i] = max((level[j] + 1 for j in names[i]), default=0)
                after[i] = max((max(first[j][0], answer.get(j, (0,))[0], after[j]) for j in names[i]), default=-1)
        for turn, seq, c in calls:
            i = c["id"]
            status = "cycle" if i not in level else "duplicate" if (turn, seq) != first[i] else "linked" if i in answer else "unanswered"
            schema, given = tools.get(c["name"]), c["arguments"]
            kinds = {"BIGINT": int, "NUMBER": (int, float), "STRING": str}
            valid = schema is not None and set(given) <= set(schema) and all(isinstance(given[p], kinds[k]) if p in given else not needed for p, (k, needed) in schema.items())
            out[conv, turn, seq, "call"] = (i, status, valid, max(turn, after.get(i, -1)), 1 + 2 * level.get(i, 0))
        for turn, seq, i in results:
            status = "orphan" if i not in first else "duplicate" if (turn, seq) != answer[i] else "linked"
            out[conv, turn, seq, "result"] = (i, status, None, max(turn, first.get(i, (-1,))[0], after.get(i, -1)), 2 + 2 * level.get(i, 0))
    return out


def test_explicit_calls_by_brute_force(spark):
    draw = random.Random(8)
    rows = []
    for conv in range(60):
        ids = [f"c{n}" for n in range(draw.randrange(1, 9))]
        for turn in range(draw.randrange(2, 9)):
            if draw.random() < 0.6:
                made = [call(draw.choice(ids), draw.choice(["add", "say", "none"]), **draw.choice([{"text": f"$result:{draw.choice(ids)}"}, {"a": 1, "b": 2.5}, {"a": "x"}, {"text": "plain"}, {"a": 2}, {"text": f"$result:{draw.choice(ids)}", "b": f"$result:{draw.choice(ids)}"}])) for _ in range(draw.randrange(1, 4))]
                rows.append((conv, turn, "assistant", " and ".join(made)))
            else:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": draw.choice([*ids, "nobody"]), "content": draw.random()})))
    found = chat_tools.link(frame(spark, rows), TOOLS).where("kind <> 'message'").collect()
    expected = plain(rows, TOOLS)
    explicit = {r[0] for r in rows if r[2] == "tool" or "<tool_call>" in r[3]}
    got = {(r["conv_id"], r["turn"], r["seq"], r["kind"]): (r["call_id"], r["status"], r["args_valid"], r["order_turn"], r["depth"]) for r in found if r["conv_id"] in explicit}
    assert got == expected
    order = sorted(found, key=lambda r: (r["conv_id"], r["order_turn"], r["depth"], r["turn"], r["seq"]))
    place = {(r["conv_id"], r["kind"], r["call_id"]): n for n, r in enumerate(order) if r["status"] == "linked"}
    for r in found:
        if r["kind"] == "call" and r["status"] == "linked":
            at = place[r["conv_id"], "call", r["call_id"]]
            assert all(place.get((r["conv_id"], "result", i), -1) < at for i in re.findall(r"\$result:(\w+)", r["json"]))
            assert at < place.get((r["conv_id"], "result", r["call_id"]), at + 1)


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 200_000), (1, 1, "assistant", "y"), (1, 0, "user", None), (None, None, None, None), (2, None, "user", "a"), (3, 0, "user", 'q"\\\n\t\x01 ü🙂'), (None, 1, "user", "b")]
    out = chat_tools.link(frame(spark, rows)).collect()
    assert sum(r["kind"] == "message" for r in out) == len(rows)
    for r in out:
        json.loads(r["json"])
    assert any(json.loads(r["json"])["content"] == 'q"\\\n\t\x01 ü🙂' for r in out if r["kind"] == "message")
    assert chat_tools.link(frame(spark, [])).count() == 0
