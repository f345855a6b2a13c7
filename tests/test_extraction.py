"""Documents from positioned text: margins, commands, extraction, diagnosis; the surveyed cases on tables."""

from pyspark.sql import functions as F

from quire.operators import alignment, diagnostics, extraction, margins, pages
from quire.sources import pdf

ENTRY = "doc_id long, page_no int, entry_idx int, a double, b double, c double, d double, x double, y double, text string, font_size double"
BOX = [0.0, 0.0, 595.0, 842.0]


def entries(spark, rows):
    """From (doc, page, x, y, text)."""
    count: dict = {}
    out = []
    for doc, page, x, y, text in rows:
        i = count[doc, page] = count.get((doc, page), -1) + 1
        out.append((doc, page, i, 1.0, 0.0, 0.0, 1.0, float(x), float(y), text, 10.0))
    return spark.createDataFrame(out, ENTRY)


def boxes(spark, keys, box=BOX):
    return spark.createDataFrame([(d, p, box, 0, "") for d, p in keys], "doc_id long, page_no int, box array<double>, rotate int, content string")


def texts(df):
    out: dict = {}
    for r in df.orderBy("doc_id", "page_no", "entry_idx").collect():
        out.setdefault((r["doc_id"], r["page_no"]), []).append(r["text"])
    return out


def strip(entries_, boxes_):
    found = margins.candidates(entries_, boxes_)
    out = margins.marked(found, margins.repeated(found, boxes_))
    return texts(margins.without(entries_, out)), {(r["doc_id"], r["page_no"], r["zone"]): r["text"] for r in margins.artifacts(entries_, out).collect()}


def test_footers_on_every_other_page_and_page_numbers(spark):
    rows = []
    for p in range(1, 7):
        rows.append((1, p, 80, 500, "Meaningful body text"))
        rows += [(1, p, 500, 70, "2024")] if p == 1 else [(1, p, 295, 29, str(p)), (1, p, 80, 55, f"Unique footnote {p}")]
        rows += [(1, p, 42, 29, "Cocoa Alternatives")] if p % 2 == 0 else []
    kept, found = strip(entries(spark, rows), boxes(spark, [(1, p) for p in range(1, 7)]))
    assert kept[1, 1] == ["Meaningful body text", "2024"] and (1, 1, "footer") not in found
    assert kept[1, 2] == ["Meaningful body text", "Unique footnote 2"] and kept[1, 3] == ["Meaningful body text", "Unique footnote 3"]
    assert found[1, 2, "footer"] == "Cocoa Alternatives | 2"


def test_headers_take_their_line_with_them(spark):
    rows = [r for p in range(1, 5) for r in ((2, p, 40, 820, "Repeated document title"), (2, p, 300, 817, f"Variable header {p}"), (2, p, 40, 500, f"Page body {p}"))]
    kept, found = strip(entries(spark, rows), boxes(spark, [(2, p) for p in range(1, 5)]))
    assert kept[2, 1] == ["Page body 1"] and "Variable header 1" in found[2, 1, "header"]


def test_a_single_page_that_prints_its_number(spark):
    kept, found = strip(entries(spark, [(3, 1, 40, 500, "Meaningful body text"), (3, 1, 40, 29, "Company contact details"), (3, 1, 295, 29, "1")]), boxes(spark, [(3, 1)]))
    assert kept[3, 1] == ["Meaningful body text"] and "Company contact details" in found[3, 1, "footer"]


def test_places_are_clustered_about_the_first_and_only_members_go(spark):
    # relative places 0.059 and 0.061 in turn, on pages with an origin; the same text elsewhere in the zone stays
    rows = [(4, p, 100 + 595 * (0.059 if p % 2 else 0.061), 50 + 20, "Report") for p in range(1, 5)] + [(4, 2, 500, 50 + 50, "Report"), *[(4, p, 120, 400, "body") for p in range(1, 5)]]
    e, b = entries(spark, rows), boxes(spark, [(4, p) for p in range(1, 5)], [100.0, 50.0, 695.0, 892.0])
    found = margins.repeated(margins.candidates(e, b), b).collect()
    assert [(r["signature"], r["n_pages"]) for r in found] == [("report", 4)]
    kept, _ = strip(e, b)
    assert kept[4, 2] == ["Report", "body"] and kept[4, 1] == ["body"]
    assert strip(e, boxes(spark, [(4, p) for p in range(1, 5)], [1.0]))[0][4, 1] == ["Report", "body"]  # no box, no margin


def commands(spark, rows):
    return spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(rows)], "doc_id long, page_no int, cmd_idx int, op string, operand string, raw binary")


def test_commands_give_their_text(spark):
    e = entries(spark, [(1, 1, 490, 223, "Hibiscus"), (1, 1, 495, 299, " "), (1, 1, 497, 289, "Relaxation")])
    c = commands(spark, [("TJ", '[{"t":"(","c":"Relax"},{"t":"n","c":"3"},{"t":"(","c":[{"t":"<","c":"ation"}]}]', None), ("Tj", '"Immune"', None), ("TJ", '[{"t":"(","c":"System"}]', None)])
    out = alignment.align(e, c)
    assert texts(out)[1, 1] == ["Relaxation", "Immune", "System"]
    assert [r["continues"] for r in out.orderBy("entry_idx").collect()] == [False, True, True]
    assert texts(alignment.align(e, c.where("cmd_idx < 2")))[1, 1] == ["Hibiscus", " ", "Relaxation"]


def test_commands_that_say_less_are_left(spark):
    decoded = ["Hibiscus “the plant”", "Döhler consumer study", "Döhler GmbH", "–", "→", "plain"]
    raws = [b"Hibiscus \x93the plant\x94", "DÃ¶hler consumer study".encode(), b"0027007C004B004F00480055", b"00B1", b"013A", b"Plain"]
    e = entries(spark, [(1, 1, 20, 500 - 14 * i, t) for i, t in enumerate(decoded)])
    c = commands(spark, [x for r in raws for x in (("Td", None, None), ("Tj", None, r))])
    out = alignment.align(e, c)
    assert texts(out)[1, 1] == [*decoded[:5], "Plain"] and not any(r["continues"] for r in out.collect())
    from quire.pages.alignment import continuations, usable

    assert [usable(r, d) for r, d in zip(raws, decoded)] == [False] * 5 + [True]
    assert continuations(["BT", "Tj", "TJ", "Tf", "Tj", "Td", "Tj", "'", "Tj"]) == [False, True, True, False, False, True]


def test_extraction_end_to_end(spark):
    rows = []
    for p in (1, 2):
        rows += [(1, p, 20 if c == 0 else 350, 500 - 14 * i, f"{'Left' if c == 0 else 'Right'} prose line number {i} of page {p}") for i in range(5) for c in (0, 1)]
        rows += [(1, p, 40, 20, "Running foot")]
    rows += [(2, 1, 20, 500, "Only line"), (3, 1, 20, 500, "known for a posi-"), (3, 1, 20, 486, "tive effect")]
    keys = [(1, 1), (1, 2), (2, 1), (3, 1), (4, 1)]
    native = spark.createDataFrame([(2, 1, " native text "), (1, 1, "unused")], "doc_id long, page_no int, native string")
    found = {(r["doc_id"], r["page_no"]): r for r in extraction.extract(entries(spark, rows), boxes(spark, keys), native=native).collect()}
    one = found[1, 1]
    assert (one["strategy"], one["layout"], one["columns"], one["n_excluded"]) == ("positioned-filtered", "columns", 2, 1)
    assert one["text"].index("Left prose line number 4") < one["text"].index("Right prose line number 0") and "Running foot" not in one["text"]
    assert (found[2, 1]["strategy"], found[2, 1]["text"]) == ("native", "native text")
    assert (found[3, 1]["strategy"], found[3, 1]["text"]) == ("positioned-fallback", "known for a positive effect")
    assert (found[4, 1]["layout"], found[4, 1]["text"]) == ("empty", "")
    made = extraction.extract(entries(spark, rows), boxes(spark, keys))
    docs = {r["source_id"]: r for r in extraction.page_documents(made, F.lit("u#x")).collect()}
    assert docs["1#page-2"]["url"] == "u#page=2" and docs["1#page-2"]["page_count"] == 2 and "4#page-1" not in docs
    assert {r["url"] for r in extraction.page_documents(made, F.lit("u#x"), False).collect()} == {"u"}
    options = spark.createDataFrame([("true",), ("1",), (" True ",), ("0",), ("yes",), (None,)], "o string").select(extraction.links_to_page(F.col("o")).alias("l"))
    assert [r["l"] for r in options.collect()] == [True, True, True, False, False, False]
    assert extraction.whole_documents(made).where("doc_id = 1").first()["page_count"] == 2


def test_diagnosis_on_tables(spark):
    e = entries(spark, [(1, 1, 20, 500, "One"), (1, 1, 45, 500, "two"), (1, 1, 70, 500, "three")])
    b = boxes(spark, [(1, 1)])
    t = spark.createDataFrame([(1, 1, "One two three")], "doc_id long, page_no int, text string")
    assert [(r["text"], r["start"], r["stop"]) for r in diagnostics.marks(e, b, t, lines=True).collect()] == [("One two three", 0, 13)]
    assert diagnostics.marks(e, b.withColumn("rotate", F.lit(90)), t).count() == 0
    same = entries(spark, [(1, 1, 20, 500, "Regular text"), (1, 1, 20, 500, "bold text"), (1, 1, 20, 500, "regular again")])
    assert pages.overlaps(same).count() == 3 and pages.overlaps(same.withColumn("continues", F.col("entry_idx") > 0)).count() == 0


def test_files_with_errors(spark, tmp_path):
    from test_pdf import TEXT, simple

    (tmp_path / "a.PDF").write_bytes(simple(TEXT))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(simple(TEXT))
    read = pdf.pages(pdf.files(spark, str(tmp_path)))
    rows = read.collect()
    assert len(rows) == 2 and sum(r["error"] is not None for r in rows) == 1
    assert [r["text"] for r in pdf.entries(read).orderBy("entry_idx").collect()] == ["Hello (you)", "World", "café"]
    out = extraction.extract(pdf.entries(read), pdf.boxes(read), pdf.commands(read)).collect()
    assert len(out) == 1 and out[0]["text"] == "Hello (you) World café"
    import pytest

    with pytest.raises(Exception, match="PdfError"):
        pdf.pages(pdf.files(spark, str(tmp_path)), strict=True).count()
