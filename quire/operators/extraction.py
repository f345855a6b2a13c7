"""From positioned text to page documents: align, leave out margins, read the layout, choose a text, normalise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normalise
from quire.operators import alignment, margins
from quire.operators.pages import per_page, together
from quire.pages import geometry, regions
from quire.pages.geometry import Entry
from quire.sources.tables import landed

PAGE = ["doc_id", "page_no"]
#: rows of parts at heights that differ by a share of the smaller size, twice or more on a page
OPTICAL, OPTICAL_LEAST, OPTICAL_ROWS = 0.25, 1.5, 2


def _optical(rows: list[geometry.Row]) -> bool:
    """Whether some rows hold texts of different heights, so that their order in the file is none."""

    def adjusted(row: geometry.Row) -> bool:
        atoms = row.atoms
        apart = max(a.y for a in atoms) - min(a.y for a in atoms)
        return apart > max(OPTICAL_LEAST, OPTICAL * min(a.v_scale for a in atoms))

    return sum(map(adjusted, rows)) >= OPTICAL_ROWS


def strategy(layout: Column, excluded: Column, optical: Column, native: Column, positioned: Column) -> tuple[Column, Column]:
    """(strategy, text): which of a page's texts is taken."""
    positioned = F.trim(F.coalesce(positioned, F.lit("")))
    native = F.trim(F.coalesce(native, F.lit("")))
    name = (
        F.when(excluded & (positioned != ""), "positioned-filtered")
        .when(layout.isin("columns", "table", "mixed"), "positioned")
        .when(optical & (positioned != ""), "positioned-aligned")
        .when(native != "", "native")
        .otherwise("positioned-fallback")
    )
    return name, F.when(name == "native", native).otherwise(positioned)


def page_texts(entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, page_no, layout, columns, table_rows, confidence, positioned, optical of each page, and its columns ``keep``; all but these are null for one without entries."""

    def look(page: list[Entry]) -> list[tuple]:
        if not page:
            return [(None,) * 6]
        rows = geometry.read(page)
        found = regions.analyse(rows)
        return [(found.layout, found.column_count, found.table_rows, found.confidence, found.text, _optical(rows))]

    return per_page(together(entries), [("layout", "string"), ("columns", "int"), ("table_rows", "int"), ("confidence", "double"), ("positioned", "string"), ("optical", "boolean")], look, keep=keep)


def extract(entries: DataFrame, boxes: DataFrame | None = None, commands: DataFrame | None = None, native: DataFrame | None = None) -> DataFrame:
    """doc_id, page_no, strategy, layout, columns, table_rows, confidence, n_excluded, text of every page of ``boxes``.

    ``boxes`` is (doc_id, page_no, box), ``native`` (doc_id, page_no, native):
    the text as a parser gives it.  Margins are looked for across the pages of
    a document; everything else stays within a page.  Without ``boxes`` the
    entries are lists, a row for each page, beside its box and, where there,
    its native text and list of commands; nothing but what the margins need
    leaves the row then.
    """
    if boxes is not None:
        given = boxes.select(*PAGE, "box").join(together(entries), PAGE, "left")
        if native is not None:
            given = given.join(native.select(*PAGE, "native"), PAGE, "left")
        if commands is not None:
            given = given.join(commands.groupBy(*PAGE).agg(F.collect_list(F.struct("cmd_idx", "op", "operand", "raw")).alias("commands")), PAGE, "left")
        return extract(landed(given))
    aligned = landed(alignment.align(entries)) if "commands" in entries.columns else entries
    pages = margins.without(aligned, margins.find(aligned, aligned.select(*PAGE, "box")))
    if "native" not in pages.columns:
        pages = pages.withColumn("native", F.lit(None).cast("string"))
    pages = page_texts(pages, ("n_excluded", "native"))
    n_excluded = F.coalesce("n_excluded", F.lit(0).cast("long"))
    layout = F.coalesce("layout", F.lit("empty"))
    name, text = strategy(layout, n_excluded > 0, F.coalesce("optical", F.lit(False)), F.col("native"), F.col("positioned"))
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("columns", "table_rows")]
    return pages.select(*PAGE, name.alias("strategy"), layout.alias("layout"), *numbers, F.coalesce("confidence", F.lit(0.0)).alias("confidence"), n_excluded.alias("n_excluded"), normalise(text).alias("text"))


def links_to_page(option: Column) -> Column:
    """Whether a setting, given as text, asks for links to the matched page."""
    return F.coalesce(F.lower(F.trim(option.cast("string"))).isin("true", "1"), F.lit(False))


def page_documents(pages: DataFrame, url: Column | None = None, link_to_page: Column | bool = True) -> DataFrame:
    """doc_id, page_no, source_id, page_count, url, text and what was found out of extracted pages that hold text."""
    counts = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    base = F.substring_index(F.coalesce(url, F.lit("")) if url is not None else F.lit(""), "#", 1)
    target = F.when(base == "", "").when(F.lit(link_to_page), F.concat(base, F.lit("#page="), F.col("page_no").cast("string"))).otherwise(base)
    named = pages.join(counts, "doc_id").where("text <> ''").withColumn("source_id", F.concat(F.col("doc_id").cast("string"), F.lit("#page-"), F.col("page_no").cast("string")))
    return named.select(*PAGE, "source_id", "page_count", target.alias("url"), "text", "strategy", "layout", "columns", "table_rows", "confidence", "n_excluded")


def whole_documents(pages: DataFrame, parser: str = "quire") -> DataFrame:
    """doc_id, text, parser, page_count: texts of extracted pages in order, with blank lines between."""
    texts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    out = pages.groupBy("doc_id").agg(texts.alias("p"), F.count("*").cast("int").alias("page_count"))
    return out.select("doc_id", F.trim(F.array_join(F.filter(F.transform("p", lambda p: p["text"]), lambda t: t != ""), "\n\n")).alias("text"), F.lit(parser).alias("parser"), "page_count")
