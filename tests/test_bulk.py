"""Many pages at once give what each gives alone, and their entries are not shuffled."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quire.operators import alignment as operators
from quire.operators import extraction, margins, pages, positions
from quire.pages import alignment, bulk, geometry, overlap
from quire.pages.geometry import Entry
from quire.plans import layout_queries, registry


def drawn(rng, n):
    """Entries whose heights, sizes and places lie at and about the limits, some turned, blank, printed twice or given twice."""
    out = []
    for i in range(n):
        x = rng.choice([20.0, 20.004, 20.005, -0.001, 0.001, rng.uniform(0, 500)])
        y = rng.choice([700.0, 701.5, 698.6, 690.0, rng.uniform(600, 700)])
        text = rng.choice(["a", "a ", "-", ",b", "end-", " ", "", " c ", "wörter", "x" * rng.randint(1, 40)])
        out.append(Entry(rng.choice([i, i, i, 1000 + i, max(0, i - 1)]), rng.choice([1.0, 1.0, 12.0, 0.7]), rng.choice([0.0, 0.0, 0.1, 0.9]), rng.choice([0.0, 0.0, -0.1]), rng.choice([1.0, 1.0, 12.0, -1.0]), x, y, text, rng.choice([None, 1.0, 8.0, 10.0, 24.0])))
    rng.shuffle(out)
    return out


def batch(made, flags):
    flat = [e for p in made for e in p]
    names = {"entry_idx": ("index", "int32"), "text": ("text", "string"), "font_size": ("size", "float64")} | {n: (n, "float64") for n in "abcdxy"}
    columns = {n: pa.array([getattr(e, at) for e in flat], kind) for n, (at, kind) in names.items()}
    columns["continues"] = pa.array([f for p in flags for f in p], "bool")
    return np.repeat(np.arange(len(made)), [len(p) for p in made]), columns.__getitem__


def pages_of(seed):
    rng = random.Random(seed)
    made = [drawn(rng, rng.choice([0, 1, 3, 20, 60])) for _ in range(40)]
    return made, [[rng.choice([True, True, False, None]) for _ in p] for p in made]


@pytest.mark.parametrize("seed", range(5))
def test_rows_of_many_pages(seed):
    made, flags = pages_of(seed)
    page, columns = bulk.visual_rows(*batch(made, flags))
    got = list(zip(page.tolist(), *(c.to_pylist() for c in columns)))
    rows = lambda p: [(n, r.y, " | ".join(x.text for x in r.parts), [{"x_min": x.x_min, "x_max": x.x_max, "size": x.size, "text": x.text} for x in r.parts]) for n, r in enumerate(geometry.read(p), 1)]
    assert got == [(i, *r) for i, p in enumerate(made) for r in rows(p)]


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("most", [0, 3, 1000])
def test_overlaps_of_many_pages(seed, most):
    made, flags = pages_of(seed)
    page, columns = bulk.overlaps(*batch(made, flags), most)
    got = list(zip(page.tolist(), *(c.to_pylist() for c in columns)))
    told = [{e.index: f for e, f in zip(p, own) if f is not None} for p, own in zip(made, flags)]
    assert got == [(i, *r, n) for i, (p, own) in enumerate(zip(made, told)) for n, r in enumerate(overlap.pairs(p, own, most), 1)]


def test_no_pages():
    for fn in (bulk.visual_rows, lambda page, get: bulk.overlaps(page, get, 10)):
        assert len(fn(*batch([], []))[0]) == 0 and len(fn(*batch([[]], [[]]))[0]) == 0


def test_pages_are_cut_into_bounded_parts(spark, small, monkeypatch):
    wanted = registry.queries()["visual_rows"](spark, small).toPandas()
    monkeypatch.setattr(pages, "AT_ONCE", 150)
    got = registry.queries()["visual_rows"](spark, small).toPandas()
    key = ["doc_id", "page_no", "row_no"]
    assert got.sort_values(key, ignore_index=True).equals(wanted.sort_values(key, ignore_index=True))


def exchanges(df):
    """What the shuffles of a plan are dealt by."""
    return re.findall(r"Exchange (\w+\([^)]*\)?)", df._jdf.queryExecution().executedPlan().toString())


def test_atoms_of_lists_are_those_of_rows(spark):
    rows = [(n // 7, n % 7, e.index, e.a, e.b, e.c, e.d, e.x + rng.choice([0.0, 0.125, 1.005, 2.675]), e.y, e.text, e.size) for rng in [random.Random(7)] for n, p in enumerate(pages_of(7)[0]) for e in {e.index: e for e in p}.values()]
    entries = spark.createDataFrame(rows, "doc_id long, page_no int, entry_idx int, a double, b double, c double, d double, x double, y double, text string, font_size double")
    names = ("entry_idx", "text", "x", "y", "size", "h_scale", "v_scale", "centre")
    found = [sorted(tuple(r) for r in df.select("doc_id", "page_no", *names).collect()) for df in (positions.atoms(entries), pages.atoms(pages.together(entries), names))]
    assert found[0] == found[1] and len(rows) > len(found[0]) > 100


def test_copies_do_not_meet_in_a_shuffle(spark, small):
    assert [re.sub(r"#\d+L?", "", e) for e in exchanges(registry.queries()["dedup_rounded"](spark, small))] == ["hashpartitioning(doc_id, page_no, 4)", "hashpartitioning(doc_id, 4)"]


@pytest.mark.parametrize("name", ["visual_rows", "overlap_pairs_top10", "aligned_text", "page_documents", "run_positions"])
def test_only_documents_are_shuffled(spark, small, name):
    assert [re.sub(r"#\d+L?", "", e) for e in exchanges(registry.queries()[name](spark, small))] == ["hashpartitioning(doc_id, 4)"]


def test_commands_without_bytes_or_text():
    assert alignment.chosen(None, None, "x") == "" and alignment.chosen(None, '"\\ud800"', "x") == "x" and alignment.chosen(b"\xff", '"a"', "x") == "x"
    assert alignment.chosen(b"Name", None, None) == "Name" and alignment.chosen(b"00270028", None, None) is None
    page, number = np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 0, 1])
    ops = np.array(["Tj", "Tj", "'", "Tj", "TJ"])
    of = lambda names: np.isin(ops, names)
    assert alignment.goes_on(page, number, of(alignment.SHOWS), of(alignment.RUNS), of(alignment.PLACES)).tolist() == [False, True, False, False, True]


def test_places_of_runs_by_a_plain_loop(spark):
    rng, rows, wanted = random.Random(3), [], {}
    for doc in range(30):
        raw = [(i, rng.choice([True, True, False, None])) for i in sorted(rng.sample(range(40), rng.choice([0, 1, 12, 30])))]
        kept = [(i, rng.choice([20.0, 20.5, 20.6]), rng.choice([500.0, 500.5, 501.1]), rng.choice([5.8, 0.1, None])) for i, _ in raw if rng.random() < 0.9] + [(99, 1.0, 1.0, 1.0)]
        flags, before = dict(raw), {i: raw[n - 1][0] if n else None for n, (i, _) in enumerate(raw)}
        last = start = moved = None
        for i, x, y, advance in kept:
            goes = bool(flags.get(i)) and last is not None and before[i] == last[0]
            linked = goes and i == last[0] + 1 and abs(x - last[1]) <= 0.5 and abs(y - last[2]) <= 0.5
            start, moved = (start, moved + (last[3] or 0.0)) if linked else (x, 0.0)
            wanted[doc, i], last = (goes, start + moved), (i, x, y, advance)
        rng.shuffle(kept)
        rows.append((doc, 1, kept, raw))
    pages_ = spark.createDataFrame(rows, "doc_id long, page_no int, entries array<struct<entry_idx:int,x:double,y:double,advance:double>>, raw array<struct<entry_idx:int,continues:boolean>>")
    got = {(r["doc_id"], e["entry_idx"]): (e["continues"], e["x"]) for r in operators.run_places(pages_).collect() for e in r["entries"]}
    assert got == wanted and sum(g for g, _ in got.values()) > 20


def test_margins_of_lists_are_those_of_rows(spark, small):
    from pyspark.sql import functions as F

    words, boxes = layout_queries.with_words(spark, small)
    lists = layout_queries.with_footers(words.where("doc_id < 40"))
    rows = lists.select("doc_id", "page_no", "a", "c", "d", F.inline("entries"))
    boxes = boxes.where("doc_id < 40 AND NOT (doc_id = 3 AND page_no = 1)").withColumn("box", F.when(F.col("doc_id") % 7 == 5, F.array(F.lit(1.0))).otherwise(F.col("box")))
    lists = lists.drop("box").join(boxes, ["doc_id", "page_no"], "left")
    of = lambda df: sorted(map(tuple, df.collect()))
    outs = [margins.find(e, boxes, margins.READ) for e in (rows, lists)]
    assert of(outs[0]) == of(outs[1]) and len(of(outs[0])) > 100
    left = [margins.without(e, o) for e, o in zip((rows, lists), outs)]
    assert of(left[0].select("doc_id", "page_no", "entry_idx")) == of(left[1].select("doc_id", "page_no", F.explode("entries.entry_idx")))
    assert of(margins.artifacts(rows, outs[0].drop(*margins.READ))) == of(margins.artifacts(None, outs[1]))


@pytest.mark.parametrize("name", ["repeated_margin_text", "margin_artifacts", "margins_removed"])
def test_margins_are_found_without_a_shuffle_of_entries(spark, small, name, monkeypatch):
    monkeypatch.setattr(margins, "landed", lambda df: df)
    plan = registry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    joins = [re.sub(r"#\d+L?", "", j) for j in re.findall(r"Join \w+, \(?(.*)", plan)]
    # of the entries' fields none is a key of a join but of the few in the bands with those that recur
    assert all("entry_idx" not in j or "zone" in j for j in joins), joins


@pytest.mark.parametrize("seed", range(3))
def test_rows_are_split_as_their_atoms_are(seed):
    rng = random.Random(seed)
    for p in pages_of(seed)[0]:
        rows = geometry.read(p)
        for at in (rng.uniform(0, 500), *(a.x for r in rows[:3] for a in r.atoms)):
            wanted = [[r for r in (geometry.split_row(row, inside) for row in rows) if r.parts] for inside in (lambda a: a.x < at, lambda a: a.x >= at)]
            assert list(geometry.split_rows(rows, at)) == wanted


def test_extraction_of_lists_is_that_of_rows(spark, small):
    from pyspark.sql import functions as F

    made = layout_queries._three(spark, small).where("doc_id < 60")
    bare = (F.col("doc_id") == 8) & (F.col("page_no") == 2)
    made = made.withColumn("entries", F.when(bare, F.slice("entries", 1, 0)).otherwise(F.col("entries")))
    rows = made.select("doc_id", "page_no", "a", "b", "c", "d", F.inline("entries"))
    of = lambda df: sorted(map(tuple, df.collect()))
    lists = of(extraction.extract(made))
    assert lists == of(extraction.extract(rows, made.select("doc_id", "page_no", "box"), native=made.select("doc_id", "page_no", "native")))
    assert [r[3] for r in lists if r[:2] == (8, 2)] == ["empty"] and len(lists) == 180


@pytest.mark.parametrize("name", ["document_extraction", "whole_documents"])
def test_pages_of_templates_move_once(spark, small, name):
    text = registry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    # one finds the candidates that recur, one brings their margins to the pages
    assert text.count("Join LeftOuter") == 2


def test_texts_are_measured_before_they_are_joined(spark):
    from quire.operators import diagnostics

    found = spark.createDataFrame([(1, 1, "s", "plain", 1, 0.9, "text", 0)], "doc_id long, page_no int, strategy string, layout string, columns int, confidence double, text string, n_excluded long")
    records = diagnostics.page_records(found, spark.createDataFrame([(1, 1, 2)], "doc_id long, page_no int, first int"))
    plan = records._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join LeftOuter" in line)
    assert "AS n_chars" in plan[join + 1] and not any("n_chars" in line and "length" in line for line in plan[:join])
    assert records.first()["n_chars"] == 4 and records.first()["n_warnings"] == 1


@pytest.mark.parametrize("made", [layout_queries._files, layout_queries._three])
def test_work_that_is_much_for_a_row_is_dealt(spark, small, made):
    assert "RepartitionByExpression [doc_id" in made(spark, small)._jdf.queryExecution().optimizedPlan().toString()
