"""Stored state, clean-up, products, configurations, requests, captures and the shop's interface."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quire.functions import requests
from quire.operators import captures, cleanup, configs, products, state
from quire.sources import shop
from quire.streaming import runs

CHANGE = "connector string, indexer string, id string, at long, active boolean, content string"


def changes(spark, rows):
    return spark.createDataFrame([("c", "i", *r) for r in rows], CHANGE)


def test_runs_resume_where_they_stopped(spark, tmp_path):
    """Same-second rows with falling ids, inactive, empty and invalid ones, in runs of two."""
    rows = [("b", 10, None, "x"), ("a", 10, True, "x"), ("c", 10, False, "x"), ("d", 11, True, " "), ("e", 12, True, "y"), (" ", 12, True, "z"), ("f", 0, True, "z"), ("late", 99, True, "z")]
    store = runs.StateStore(spark, f"file://{tmp_path}/state")
    indexers = spark.createDataFrame([("c", "i")], "connector string, indexer string")
    taken: list[tuple] = []

    def apply(planned):
        taken.extend((r["id"], r["outcome"]) for r in planned.orderBy("at", "id").collect() if r["outcome"] != "invalid")

    def run(**more):
        return runs.run_once(store, changes(spark, rows), indexers, 50, apply, limit=2, now=50, lookback_days=1, **more).first()

    dry = run(dry_run=True)
    assert (dry["processed"], dry["has_more"]) == (2, True) and not taken and store.versions() == []
    first = run()
    assert (first["processed"], first["indexed"], first["failed"], first["has_more"], first["next_cursor"]) == (2, 2, 2, True, "10|b")
    second = run()
    assert (second["processed"], second["removed"], second["skipped"], second["next_cursor"]) == (2, 1, 1, "11|d")
    third = run()
    assert (third["processed"], third["has_more"], third["next_cursor"]) == (1, False, "12|e")
    assert run()["processed"] == 0
    assert taken == [("a", "indexed"), ("b", "indexed"), ("c", "removed"), ("d", "failed"), ("e", "indexed")]
    kept = store.load().collect()
    assert len(kept) == 1 and (kept[0]["status"], kept[0]["cursor_id"]) == ("ok", "e") and len(store.versions()) == 2
    assert run(reset=True)["next_cursor"] == "10|b"
    assert run(explicit=(11, "d"))["next_cursor"] == "12|e"


def test_a_failed_run_keeps_its_cursor(spark, tmp_path):
    store = runs.StateStore(spark, f"file://{tmp_path}/state")
    indexers = spark.createDataFrame([("c", "i")], "connector string, indexer string")
    one = changes(spark, [("a", 10, True, "x"), ("b", 11, True, "x")])
    runs.run_once(store, one, indexers, 50, lambda df: df.count(), limit=1, now=50)

    def broken(_):
        assert state.lookup(store.load(), "c", "i").first()["status"] == "running"
        raise RuntimeError("store is gone")

    with pytest.raises(RuntimeError):
        runs.run_once(store, one, indexers, 50, broken, limit=1, now=50)
    kept = store.load().first()
    assert (kept["status"], kept["message"], kept["cursor_id"]) == ("error", "RuntimeError: store is gone", "a")
    assert runs.run_once(store, one, indexers, 50, lambda df: df.count(), limit=1, now=50).first()["next_cursor"] == "11|b"


def test_unchanged_documents_are_skipped(spark):
    states = state.get_or_create(spark.createDataFrame([("c", "i")], "connector string, indexer string"), spark.createDataFrame([], runs.SCHEMA))
    rows = changes(spark, [("a", 10, True, "x"), ("b", 11, True, "new")])
    stored = rows.where("id = 'a'").select("connector", "indexer", "id", F.sha2("content", 256).alias("content_hash")).unionByName(spark.createDataFrame([("c", "i", "b", "old")], "connector string, indexer string, id string, content_hash string"))
    found = {r["id"]: r["outcome"] for r in state.plan(rows, states, 50, now=50, stored=stored).collect()}
    assert found == {"a": "unchanged", "b": "indexed"}
    assert {r["id"] for r in state.plan(rows, states, 50, since=11).collect()} == {"b"}
    report = state.report(state.advance(states, state.plan(rows, states, 50, now=50))).first()
    assert json.loads(report["json"])["result"]["nextCursor"] == "11|b" and "Next cursor: 11|b, Has more: no" in report["line"]


def test_clean_up_in_batches(spark):
    stored = spark.createDataFrame([(i,) for i in range(1, 8)], "id int")
    remote = spark.createDataFrame([(2,), (4,)], "id int")
    rows = cleanup.next_batch(stored, remote, "id", 1, 4, 2).orderBy("id").collect()
    assert [(r["id"], r["batch"], r["status"], r["has_more"]) for r in rows] == [(2, 0, "skipped", True), (3, 0, "removed", True), (4, 1, "skipped", True), (5, 1, "removed", True)]
    assert cleanup.counts(cleanup.next_batch(stored, remote, "id", 5, 4)).first()[:4] == (2, 0, 2, False)
    assert cleanup.next_batch(stored, remote, "id", 7, 4).count() == 4  # round to the start
    assert (cleanup.batch_size(0), cleanup.batch_size(900), cleanup.page_size(100), cleanup.page_size(-5)) == (1, 500, 101, 1)
    with pytest.raises(ValueError):
        cleanup.next_batch(stored, remote.limit(0), "id", None, 4, probe_failed=True)
    vectors = spark.createDataFrame([("h1", 1, "a"), ("h2", 1, "b")], "source_hash string, number int, text string")
    gone = spark.createDataFrame([(" h1 ",), ("",)], "source_hash string")
    assert [r["source_hash"] for r in cleanup.delete_hashes(vectors, gone).collect()] == ["h2"]
    assert cleanup.delete_hashes(vectors, gone, dry_run=True).count() == 2
    with pytest.raises(RuntimeError):
        cleanup.delete_hashes(vectors, gone, connected=False)


def test_products(spark):
    body = {"id": "p1", "updatedAt": "2024-03-01T10:00:00.500Z", "name": "N", "translated": {"name": " T ", "description": "<p>About</p> "}, "productNumber": "7", "manufacturer": {"translated": {"name": "M"}}, "categories": [{"name": "a"}, {"translated": {"name": "b"}, "name": "x"}, {"name": "a"}], "customFields": {"tel": "1", "nested": {"x": 1}, "contact_person": "Ann", "flag": True}, "tags": [{"n": "u"}, {"n": "v"}, {"n": "u"}]}
    rows = [body, body | {"id": " "}, body | {"updatedAt": "never", "createdAt": None}, {"id": "p4", "createdAt": "1970-01-01T00:00:09Z", "translated": {"description": "<br>"}}, body | {"id": "p5", "active": False}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("no json",)], "product string")
    made = products.build(df, "https://s.example", "/p/", [], ["tags[].n", "none"], {"keywords": "set", " ": "x"}).collect()
    text = "T\n\nAbout\n\nProduct number: 7\n\nManufacturer: M\n\nCustom fields:\ncontact_person: Ann\nflag: 1\ntel: 1\n\nAdditional fields:\ntags[].n: u, v"
    assert [r["content"] for r in made] == [text, None, None, None, text, None]
    meta = made[0]["metadata"]
    assert meta["keywords"] == "set" and meta["category"] == '["a","b"]' and meta["contact_name"] == "Ann" and meta["phone"] == "1" and meta["department"] == "a" and meta["url"] == "https://s.example/p/p1" and " " not in meta
    assert [r["active"] for r in made] == [True, True, True, True, False, True] and made[0]["changed_at"] == 1709287200
    assert df.select(products.field_block(F.col("product"), ["tel"])).first()[0] == "Custom fields:\ntel: 1"
    assert products.preview(df, 0).count() == 1 and "active" in products.preview(df, 9).first()["line"]


def test_configurations(spark):
    rows = [(1, "shop", "external", True, "c", "u", "i", "k", "one"), (2, "shop", "external", False, " ", "u", "i", "k", "two"), (3, "other", "external", True, "c", "", "i", "k", "three")]
    df = spark.createDataFrame(rows, "uid int, identifier string, kind string, enabled boolean, collection string, base_url string, client_id string, api_key string, title string")
    fits = F.col("kind") == "external"
    ids = lambda d: sorted(r["uid"] for r in d.collect())
    assert ids(configs.resolve(df, "shop", "external", fits)) == [1, 2] and ids(configs.resolve(df, "shop", "external", fits, uid=3)) == [3]
    assert ids(configs.resolve(df, "none", "external", fits)) == [1, 2, 3] and ids(configs.resolve(df, "shop", "external", fits, uid=9)) == []
    assert ids(configs.resolve_one(df, "shop", uid=2)) == [1] and ids(configs.resolve_one(df, "shop", uid=3)) == [3]
    with pytest.raises(ValueError):
        configs.resolve_one(df, "none")
    assert [r["skipped_for"] for r in configs.guarded(df).orderBy("uid").collect()] == [None, "no collection", "incomplete credentials"]


def test_requests():
    tree = requests.parse_query("a[b][]=1&a[b][]=2&c=x%20y&c=z&a[d]=&[x]=1")
    assert tree == {"a": {"b": {"0": "1", "1": "2"}, "d": ""}, "c": "z"}
    assert requests.build_query({"a": {"b": ["1", 2]}, "n": None, "t": True, "s": "x y&"}) == "a%5Bb%5D%5B0%5D=1&a%5Bb%5D%5B1%5D=2&t=1&s=x%20y%26"
    assert requests.deep_overlay({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "b": {"z": 1}}) == {"a": {"x": 1, "y": 3}, "b": {"z": 1}}
    assert requests.overlay({"a": {"x": 1}}, {"a": {"y": 2}}) == {"a": {"y": 2}} and requests.overlay("no", None) == {}
    found = requests.integration(" solr ")
    url = requests.redirect("https://h/p?x=1&tx_solr[page]=2&search_control[a]=1#f", {"tx_solr": {"q": "old", "page": "2", "f": {"a": "b"}}}, found, "new words", "tok")
    assert url == "https://h/p?x=1&tx_solr%5Bq%5D=new%20words&tx_solr%5Bf%5D%5Ba%5D=b&ai=tok#f"
    control = {"integration": "solr"}
    assert requests.gate({"tx_solr": {"q": " a "}}, control) == ("", "a") and requests.gate({}, {}) == ("no control", "")
    assert requests.gate({"tx_solr": {"q": ["a"]}}, control)[0] == "no query" and requests.gate({}, control | {"processed": "1"})[0] == "processed" and requests.gate({}, {"integration": "x"})[0] == "no integration"
    assert requests.original_query({"originalQuery": " a "}, {}) == "a" and requests.original_query({}, {"tx_kesearch_pi1": {"sword": " "}, "tx_solr": {"q": "b"}}) == "b" and requests.original_query({}, {}) == ""
    assert requests.chat_identifier("a b/c:d_e-f" + "x" * 200) == ("abc:d_e-f" + "x" * 200)[:128]


def test_captures(spark):
    rows = [{"uid": "5", "type": "page", "title": "<b>A</b> &amp; B", "text": "x" * 5999 + "🙂", "score": "0.5", "pageId": "9"}, {"title": "no id", "text": "", "score": None, "changedAt": 7}, "odd"]
    df = spark.createDataFrame([("q", json.dumps(rows)), ("none", '{"a":1}'), ("bad", "["), ("null", None)], "result_group string, rows string")
    found = captures.results(captures.parse_rows(df)).orderBy("position").collect()
    assert [(r["id"], r["score"], r["title"]) for r in found] == [("page:5", 0.5, "A & B"), ("result:2", 0.99, "no id"), ("result:3", 0.98, "")]
    assert found[0]["text"] == "x" * 5999 and (found[0]["page_id"], found[1]["changed_at"]) == (9, 7)
    assert captures.utf16_prefix("a🙂b", 2) == "a" and captures.utf16_prefix("a🙂b", 3) == "a🙂"
    assert captures.field_mapping({"id": "key", "text": "", "other": "x"})["id"] == "key" and captures.field_mapping(None) == captures.FIELDS
    stream = spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 3, "b"), ("s", 4, "a"), ("t", 1, "a")], "session string, at int, payload string")
    assert sorted((r["session"], r["at"]) for r in captures.changed_payloads(stream).collect()) == [("s", 1), ("s", 3), ("s", 4), ("t", 1)]


@pytest.fixture
def server():
    """A shop of five products, two a page."""
    seen = []

    class Shop(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers.get("Authorization")))
            if self.path == "/api/oauth/token":
                out = {"access_token": "tok"} if body["client_secret"] == "key" else {"error": "no"}
            elif body["filter"][0]["type"] == "equalsAny":
                out = {"data": [{"id": i, "active": True} for i in body["filter"][0]["value"].split("|") if i != "gone"]}
            else:
                size, page = body["limit"], body["page"]
                out = {"data": [{"id": str(i)} for i in range(5)][(page - 1) * size : page * size] + (["odd"] if page == 1 else [])}
            data = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Shop)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


def test_the_shop(spark, server):
    url, seen = server
    assert shop.token(url, "me", "key") == "tok" and shop.token(url, "me", "wrong") == "" and shop.token("", "me", "key") == "" and shop.token("http://127.0.0.1:9", "me", "key") == ""
    assert [p["id"] for p in shop.scan(url, "tok", "2024-01-01T00:00:00.000Z", "2024-02-01T00:00:00.000Z", limit=1)] == list("01234")
    first = next(b for path, b, _ in seen if path.endswith("product"))
    assert first["limit"] == 2 and first["total-count-mode"] == 1 and first["filter"][0] == {"type": "equals", "field": "parentId", "value": None} and first["sort"][1] == {"field": "id", "order": "ASC"}
    assert set(shop.by_ids(url, "tok", [" a ", "", "a", "gone", "b"])) == {"a", "b"} and shop.by_ids(url, "tok", [" "]) == {}
    spark.dataSource.register(shop.ShopSource)
    read = spark.read.format("shop_products").option("url", url + "/ ").option("client", "me").option("key", "key").option("limit", "2").load()
    assert [json.loads(r["product"])["id"] for r in read.collect()] == list("01234")
    with pytest.raises(Exception, match="access token"):
        spark.read.format("shop_products").option("url", url).option("client", "me").option("key", "wrong").load().count()
