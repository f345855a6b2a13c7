import random

import pytest
from pyspark.sql import functions as F

from quire.functions import cursor, json_path, text
from quire.operators import chunks, documents, incremental, pages, positions, retrieval
from quire.plans import registry
from quire.sources import tables
from quire.streaming.ingest import ingest


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


def test_normalise(spark):
    run = lambda s: one(spark, s, text.normalise)
    assert run("oﬃce ﬂavour eﬃcient") == "office flavour efficient"
    assert run("a posi-\ntive  effect­\r\non health\n\n\nNext one") == "a positive effect on health\n\nNext one"
    assert run("Name   Value\nA      1\nB      2") == "Name   Value\nA      1\nB      2"
    assert run("- a\n- b") == "- a\n- b" and run("0") == "0" and run("") == ""


def test_small_text_functions(spark):
    assert one(spark, "b, a\r\nb,,c ", text.split_list) == ["b", "a", "c"]
    assert one(spark, "Der DER x Größe-9", text.query_terms) == ["der", "größe"]
    assert one(spark, "​A  b­\tc ", text.margin_text) == "A b c"
    assert one(spark, '<p title="a>b">x<!-- <b> -->y</p> 1 < 2', text.strip_tags) == "xy 1 < 2"
    assert one(spark, ["cross-", "column text", " ", "0", "Next-", "Big"], text.join_blocks, "array<string>") == "crosscolumn text\n\n0\n\nNext-\n\nBig"


def test_windows():
    body = "Beginning of a text. " + "x" * 50 + " needle and more. " + "y" * 60 + " Needle with pin end."
    assert text.windows_of(body, ["absent"], 10, 1) == ["Beginning "]
    found = text.windows_of(body, ["needle", "pin"], 40, 2)
    assert len(found) == 2 and all("needle" in f.lower() and len(f) <= 40 for f in found)
    assert text.windows_of(body, ["needle", "pin"], 40, 1) == [found[1]]
    assert text.windows_of(body, ["needle"], 0, 1) == [body]


def test_retrieval_thresholds_and_limits(spark):
    rows = spark.createDataFrame([("q", "third", 0.2, 1, "a needle"), ("q", "first", 0.9, 2, "b needle"), ("q", "second", 0.8, 3, "c needle"), ("q", " ", 0.9, 4, "d"), ("q", "n", None, 5, "e")], "result_group string, id string, score double, position int, text string")
    got = retrieval.retrieve(rows, "needle", 0.5, 1, 100).collect()
    assert [(r["id"], r["score"], r["text"]) for r in got] == [("first#excerpt-1", 0.9, "b needle")]
    assert retrieval.select_results(rows, 0.0, 10).count() == 4
    assert retrieval.select_results(rows, 0.5, 0).count() == 0


def test_cursor(spark):
    assert cursor.parse("12| a|b ") == (12, "a|b") and cursor.parse("7") == (7, "") and cursor.parse(None) == cursor.parse("x") == (0, "")
    assert cursor.write(12, "a") == "12|a"
    rows = spark.createDataFrame([("a", 5), ("b", 5), ("B", 5), ("a", 6), ("", 6), (None, 7), ("z", 0)], "id string, at long")
    got = incremental.batch(rows, "at", "id", (5, "a"), 7).collect()
    assert [(r["id"], r["at"]) for r in got] == [("b", 5), ("a", 6)]
    assert one(spark, "2024-01-02T03:04:05.678+00:00", cursor.seconds) == 1704164645
    assert one(spark, "no date", cursor.seconds) == 0


def test_resuming_loses_no_row(spark):
    draw = random.Random(5)
    rows = spark.createDataFrame([(f"id{i}", draw.randrange(1, 8)) for i in range(40)], "id string, at long")
    seen, at = [], (0, "")
    while got := incremental.batch(rows, "at", "id", at, 100, limit=7).collect():
        seen += [r["id"] for r in got]
        at = (got[-1]["at"], got[-1]["id"])
    assert sorted(seen) == sorted(r["id"] for r in rows.collect()) and len(seen) == 40


def test_clean_up(spark):
    stored, remote = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a",), ("a",)], "id string")
    assert {(r["id"], r["status"]) for r in incremental.reconcile(stored, remote, "id").collect()} == {("a", "skipped"), ("b", "removed")}
    with pytest.raises(ValueError):
        incremental.reconcile(stored, remote.limit(0), "id", probe_failed=True)
    rows, wrapped = incremental.keyset(stored, "id", "b", 5)
    assert wrapped and rows.count() == 2


def test_json_paths(spark):
    body = '{"a":[{"n":"x"},{"n":[1]},{"n":true},{"m":1}],"one":[{"n":"y"}],"t":{"k":2.5},"translated":{"name":" T "},"name":"N"}'
    run = lambda path: one(spark, body, lambda c: json_path.values(c, path))
    assert run("a[].n") == ["x", "1"] and run("one[].n") == ["y"] and run("t.k") == ["2.5"] and run("no.k") == [] and run("a") == []
    assert one(spark, body, lambda c: json_path.translated(c, "name")) == "T"
    assert one(spark, "not json", lambda c: json_path.values(c, "a")) == []


def test_documents(spark):
    pages = spark.createDataFrame([(1, 2, "b", "u#x"), (1, 1, "a", "u")], "doc_id long, page_no int, text string, url string")
    assert documents.whole_documents(pages).first()["text"] == "a\n\nb"
    assert {r["url"] for r in documents.page_documents(pages).collect()} == {"u#page=1", "u#page=2"}
    fields = spark.sql("SELECT map('b', ' 2 ', 'a', '1', 'c', ' ') AS v")
    assert fields.select(documents.field_lines(F.col("v"))).first()[0] == "a: 1\nb: 2"
    assert fields.select(documents.field_lines(F.col("v"), ["b"])).first()[0] == "b: 2"


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "Alpha   beta\ngamma delta epsilon"), (2, None), (3, " \n ")], "doc_id long, text string")
    got = chunks.chunk(docs, size=12, overlap=3, most=2)
    assert [(r["start"], r["stop"], r["text"]) for r in got.orderBy("number").collect()] == [(0, 12, "Alpha beta g"), (9, 21, "a gamma delt")]
    touched = chunks.touched_lines(got, chunks.lines(docs), bucket=5).orderBy("number").collect()
    assert [r["lines"] for r in touched] == ["1,2", "1,2"] or [r["lines"] for r in touched] == ["1,2", "2"]


def greedy(values, tolerance):
    out = []
    for v in values:
        for c in out:
            if abs(v - c[0]) <= tolerance:
                c[0] = (c[0] * c[1] + v) / (c[1] + 1)
                c[1] += 1
                break
        else:
            out.append([v, 1])
    return out


def test_clusters_by_brute_force(spark, small):
    lines = {}
    for r in tables.table(spark, small, "lineitem").collect():
        lines.setdefault(r["l_orderkey"], []).append((r["l_linenumber"], r["l_quantity"]))
    expected = {(k, i): (round(m, 6), n) for k, v in lines.items() for i, (m, n) in enumerate(greedy([q for _, q in sorted(v)], 6.0))}
    assert {(r["l_orderkey"], r["cluster"]): (r["mean"], r["n"]) for r in registry.greedy_clusters(spark, small).collect()} == expected


ENTRY = "doc_id long, page_no int, entry_idx int, a double, b double, c double, d double, x double, y double, text string, font_size double"


def entries(spark, rows):
    return spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(rows)], ENTRY)


def test_atoms_and_rows(spark):
    rows = [(1.0, 0.0, 0.0, 1.0, 20.0, 100.0, "03", 20.04), (1.0, 0.0, 0.0, 1.0, 50.0, 101.0, "Introduction", 11.04), (0.0, 1.0, -1.0, 0.0, 5.0, 5.0, "turned", 10.0), (1.0, 0.0, 0.0, 1.0, 20.0, 100.0, "03", 20.04), (1.0, 0.0, 0.0, 1.0, 20.0, 60.0, "  ", 10.0), (2.0, 0.0, 0.0, 3.0, 20.0, 40.0, "Left", 10.0), (2.0, 0.0, 0.0, 3.0, 400.0, 40.0, "Right", 10.0)]
    page = positions.atoms(entries(spark, rows))
    found = {r["entry_idx"]: r for r in page.collect()}
    assert set(found) == {0, 1, 5, 6}
    assert (found[5]["h_scale"], found[5]["v_scale"], found[5]["size"]) == (20.0, 30.0, 10.0)
    assert [r["text"] for r in pages.visual_rows(entries(spark, rows)).orderBy("row_no").collect()] == ["03 Introduction", "Left | Right"]


def test_upper_median(spark):
    assert one(spark, [4.0, 1.0, 3.0, 2.0], positions.upper_median, "array<double>") == 3.0
    assert one(spark, [], positions.upper_median, "array<double>") is None


def test_stream_reduces_to_the_newest(spark, small, tmp_path):
    events = tables.table(spark, small, "events").select("user_id", "event_id", "value")
    kept = {}

    def apply(batch, number):
        for r in batch.collect():
            kept[r["user_id"]] = max(kept.get(r["user_id"], (-1, 0)), (r["event_id"], r["value"]))

    for i in range(2):
        events.where(F.col("event_id") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "state"), "user_id", ("event_id",), apply)
    expected = {r["user_id"]: (r["event_id"], r["value"]) for r in incremental.latest(events, "user_id", "event_id").collect()}
    assert kept == expected


def test_sources(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert [r["length"] for r in tables.page_files(spark, str(tmp_path)).select("length").collect()] == [6]
    path = tables.replace_table(spark.range(3), str(tmp_path / "t"), "v1")
    assert spark.read.parquet(path).count() == 3
    ids = spark.createDataFrame([(" 1 ",), ("",), ("1",), (None,)], "id string")
    assert tables.lookup(spark.range(3), ids).count() == 1


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["result_group", "id", "score", "text"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
