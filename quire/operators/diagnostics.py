"""Diagnosis of extracted pages: boxes of texts, lines, regions and artwork, links into the text, and a record for each page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.pages import per_page, together
from quire.pages import artwork, diagnosis, geometry, regions
from quire.pages.geometry import Entry

PAGE = ["doc_id", "page_no"]
_BOX = "left:double,top:double,width:double,height:double"


def _as(m: diagnosis.Mark) -> tuple:
    b = m.box
    return (m.id, m.number, m.text, b.left, b.top, b.width, b.height, m.hue, m.start, m.stop)


def _look(page: list[Entry], box, rotate, text, number, units: dict, flags: dict) -> diagnosis.Visualization:
    layout = regions.diagnose(geometry.read(page))
    return diagnosis.visualize(page, box, rotate or 0, text or "", number or 1, layout, units, flags)


def _pages(entries: DataFrame, boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """``boxes`` is (doc_id, page_no, box, rotate), ``texts`` (doc_id, page_no, text): the extracted text."""
    return together(entries, boxes.select(*PAGE, "box", "rotate").join(texts.select(*PAGE, "text"), PAGE, "left").withColumn("number", F.col("page_no").cast("int")))


_EXTRA, _MORE = ("box", "rotate", "text", "number"), ("units", "continues")


def marks(entries: DataFrame, boxes: DataFrame, texts: DataFrame, lines: bool = False) -> DataFrame:
    """doc_id, page_no, id, number, text, left, top, width, height, hue, start, stop of each text object, or of each line."""
    fields = [("id", "string"), ("number", "int"), ("text", "string"), ("left", "double"), ("top", "double"), ("width", "double"), ("height", "double"), ("hue", "int"), ("start", "int"), ("stop", "int")]

    def look(*page) -> list[tuple]:
        found = _look(*page)
        return [_as(m) for m in (found.lines if lines else found.regions)]

    return per_page(_pages(entries, boxes, texts), fields, look, _EXTRA, _MORE)


def annotated(entries: DataFrame, boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, page_no, by_object, by_line: the extracted text as HTML, with linked objects (lines) marked."""

    def look(*page) -> list[tuple]:
        found = _look(*page)
        return [(found.text, found.line_text)]

    return per_page(_pages(entries, boxes, texts), [("by_object", "string"), ("by_line", "string")], look, _EXTRA, _MORE)


def shown_regions(entries: DataFrame, boxes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """doc_id, page_no, number, type, left, top, width, height, hue, excluded: layout regions, margins and artwork of each page, from above.

    ``boxes`` also has ``content``, the page's drawing operators; ``artifacts``
    is as ``margins.artifacts`` gives them.  Pages that are turned have none.
    """
    margins = artifacts.groupBy(*PAGE).agg(F.collect_list(F.struct("zone", "left", "bottom", "right", "top")).alias("margins"))
    pages = together(entries, boxes.select(*PAGE, "box", "rotate", "content").join(margins, PAGE, "left"))

    def look(page: list[Entry], box, rotate, content, found) -> list[tuple]:
        if not diagnosis.upright(box, rotate or 0):
            return []
        rows = geometry.read(page)
        out = [(r.type, *diagnosis.region_bounds(r.rows), False) for r in regions.diagnose(rows)]
        out += [(m["zone"], m["left"], m["bottom"], m["right"], m["top"], True) for m in found or []]
        out += [("vector-artwork", *bounds, True) for bounds in artwork.detect(rows, box, content or "")]
        out.sort(key=lambda r: -r[4])
        wide, high = box[2] - box[0], box[3] - box[1]
        done = []
        for n, (kind, left, bottom, right, top, excluded) in enumerate(out, 1):
            pad = diagnosis.REGION_PAD
            x, y = diagnosis.percent(left - box[0] - pad, wide), diagnosis.percent(high - (top - box[1]) - pad, high)
            w, h = diagnosis.percent(right - left + 2 * pad, wide), diagnosis.percent(top - bottom + 2 * pad, high)
            done.append((n, kind, round(x, 4), round(y, 4), round(min(w, 100 - x), 4), round(min(h, 100 - y), 4), (n * diagnosis.REGION_HUE + diagnosis.REGION_SHIFT) % 360, excluded))
        return done

    fields = [("number", "int"), ("type", "string"), ("left", "double"), ("top", "double"), ("width", "double"), ("height", "double"), ("hue", "int"), ("excluded", "boolean")]
    return per_page(pages, fields, look, ("box", "rotate", "content", "margins"))


def vector_artwork(entries: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, page_no, left, bottom, right, top of painted artwork in bands without text."""

    def look(page: list[Entry], box, content) -> list[tuple]:
        return artwork.detect(geometry.read(page), box, content or "")

    fields = [(n, "double") for n in ("left", "bottom", "right", "top")]
    return per_page(together(entries, boxes.select(*PAGE, "box", "content")), fields, look, ("box", "content"))


def page_records(pages: DataFrame, overlaps: DataFrame) -> DataFrame:
    """doc_id, page_no, strategy, layout, columns, confidence (percent), n_chars, n_warnings, n_excluded, is_empty of extracted pages."""
    warnings = overlaps.groupBy(*PAGE).agg(F.count("*").alias("n_warnings"))
    # texts are measured before the join, so that they do not move
    own = pages.select(*PAGE, "strategy", "layout", "columns", F.round(100 * F.col("confidence"), 1).alias("confidence"), F.length("text").alias("n_chars"), "n_excluded", (F.trim("text") == "").alias("is_empty"))
    return own.join(warnings, PAGE, "left").select(*PAGE, "strategy", "layout", "columns", "confidence", "n_chars", F.coalesce("n_warnings", F.lit(0).cast("long")).alias("n_warnings"), "n_excluded", "is_empty")
