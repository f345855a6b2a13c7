from compare import assert_same

from quire.llm import decontam, queries


def test_query_by_sql(spark, small, duck):
    assert_same(queries.op9_decontamination(spark, small), duck(small, queries.OP9_SQL))


def brute(text, items):
    words = decontam_words(text)
    hit, found = set(), set()
    for i, t in items:
        w = decontam_words(t)
        n = min(13, len(w))
        if not n:
            continue
        windows = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
        for j in range(len(words) - n + 1):
            if tuple(words[j : j + n]) in windows:
                hit |= set(range(j, j + n))
                if i is not None:
                    found.add(str(i))
    return len(words), len(hit), len(found)


def decontam_words(text):
    import re

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def test_fixture_by_brute_force(spark, make_docs):
    run = " ".join(f"w{i}" for i in range(40))
    same = " ".join(["la"] * 30)
    items = [(1, run), (2, "Short Item here"), (3, same), (4, None), (5, ""), (None, "nameless few"), (6, "one"), (2, "another text of item two"), (7, "İ ÀÉ ſtraße words, here; too")]
    texts = [(1, "x y " + run[8:] + " z"), (2, "a short-item HERE b"), (3, same), (4, "la " * 12), (5, None), (6, ""), (7, "nameless few one"), (8, "w0 w1 w2 " * 20), (9, ("pad " * 40_000) + run), (9, ("pad " * 40_000) + run), (10, "İ ÀÉ ſtraße words here too"), (None, run)]
    bench = spark.createDataFrame([(i, t, "x", "x") for i, t in items], "item_id long, text string, words string, hash string")
    rows = decontam.digest(make_docs([(i, t, "en") for i, t in texts]), bench).collect()
    assert len(rows) == len(texts)
    expected = {i: brute(t, items) for i, t in texts}
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["n_items"]) == expected[r["doc_id"]], r["doc_id"]
        assert r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"])
    kept = decontam.drop_contaminated(make_docs([(i, t, "en") for i, t in texts]), bench)
    assert len(kept.columns) == 16
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, *_ in sorted((i, *e) for i, e in expected.items() if i is not None and not e[1])]  # one hit word is enough


def test_odd_tables(spark, odd, none):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.digest(odd, nothing).where("contaminated").count() == 0
    assert decontam.digest(odd, nothing).count() == 12
    assert decontam.digest(none, nothing).count() == 0
    assert decontam.drop_contaminated(odd, nothing).count() == 12


def test_a_phrase_that_all_share_does_not_multiply(spark, make_docs):
    """Twelve words that 200 items and 200 documents begin with are no hit; one word more is, with its own item only."""
    phrase = " ".join(f"p{i}" for i in range(12))
    items = [(i, f"{phrase} item{i} " + " ".join(f"i{i}x{j}" for j in range(20))) for i in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs([(i, f"start {phrase} doc{i} and more words here", "en") for i in range(200)] + [(900, f"a {phrase} item7 b", "en"), (901, f"{items[3][1]} tail", "en")])
    found = decontam.hits(docs, bench)
    assert {(r["key"], r["item_id"]) for r in found.collect()} == {(900, 7), (901, 3)}
    rows = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontam.digest(docs, bench).where("n_hit > 0").collect()}
    assert rows == {900: (13, 1), 901: (33, 1)}
