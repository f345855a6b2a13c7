"""Headers and footers of a document: texts and page numbers that recur at one place in the margins of its pages.

Groups of candidates (one text of one zone of a document, or its numbers) are
clustered about their first members inside the JVM; a list holds what one
document repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import margin_text
from quire.operators.pages import per_page, together
from quire.pages import geometry
from quire.pages.geometry import DESCENT, Entry
from quire.sources.tables import landed

PAGE = ["doc_id", "page_no"]
# fixed values: share of the page in which margins are looked for, and tolerances there
BAND, X_NEAR, Y_NEAR = 0.08, 0.04, 0.02
SKEW = 0.2
#: fields of its entries that a margin's text and bounds are read from
READ = ("a", "b", "c", "d", "x", "y", "text", "font_size")
#: a page number alone, with its word or with the count of pages
NUMBER = r"(?iu)^(?:page\s*)?(\d+)(?:\s*(?:of|/)\s*\d+)?$"


def candidates(entries: DataFrame, boxes: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, page_no, entry_idx, zone, signature, number, x_ratio, y_ratio of upright entries in the top or bottom band.

    ``boxes`` is (doc_id, page_no, box): four coordinates, of which the first
    two are the page's origin; pages without four are left out.  Without
    ``boxes`` the entries are lists, a row for each page, beside its box: only
    those in the bands are looked at further.  Fields ``keep`` of the entries stay.
    """
    whole = "size(box) = 4 AND box[2] > box[0] AND box[3] > box[1]"
    ratio = lambda v, n: (v - F.col("box")[n]) / (F.col("box")[n + 2] - F.col("box")[n])
    upright = lambda of: ~((F.abs(of("b")) > SKEW * F.abs(of("a"))) | (F.abs(of("c")) > SKEW * F.abs(of("d"))))
    zone = lambda y: F.when(y <= BAND, "footer").when(y >= 1 - BAND, "header")
    if boxes is None:
        listed = entries.where(whole).where("doc_id IS NOT NULL")
        within = listed.schema["entries"].dataType.elementType.names
        of = lambda e: lambda n: e[n] if n in within else F.col(n)
        # a little more than the bands, by two comparisons an entry; what is exact follows
        high, low = F.col("box")[3], F.col("box")[1]
        some = (high - low) * BAND + (F.abs(high) + F.abs(low)) * 1e-6
        listed = listed.withColumns({"_low": low + some, "_high": high - some})
        near = F.filter("entries", lambda e: (of(e)("y") <= F.col("_low")) | (of(e)("y") >= F.col("_high")))
        wanted = ["entry_idx", "a", "b", "c", "d", "x", "y", "text", *[n for n in keep if n not in READ[:-1]]]
        found = listed.withColumn("e", F.explode(near)).select(*PAGE, "box", *[of(F.col("e"))(n).alias(n) for n in wanted]).where(upright(F.col))
    else:
        found = entries.where(upright(F.col)).join(boxes.where(whole).select(*PAGE, "box"), PAGE)
    placed = found.withColumns({"x_ratio": ratio(F.col("x"), 0), "y_ratio": ratio(F.col("y"), 1), "plain": margin_text(F.col("text"))})
    digits = F.regexp_extract("plain", NUMBER, 1)
    number = F.when(digits != "", F.expr("try_cast(regexp_extract(plain, r'" + NUMBER + "', 1) AS bigint)"))
    out = placed.withColumns({"zone": zone(F.col("y_ratio")), "signature": F.lower("plain"), "number": number})
    return out.where("zone IS NOT NULL AND signature <> ''").select(*PAGE, "entry_idx", "zone", "signature", "number", "x_ratio", "y_ratio", *keep)


def _clusters(items: Column) -> Column:
    """For each item the number, from 1, of the first anchor that it is near; an item near none is an anchor itself."""
    near = lambda a, v: (F.abs(a["x_ratio"] - v["x_ratio"]) <= X_NEAR) & (F.abs(a["y_ratio"] - v["y_ratio"]) <= Y_NEAR)
    place = lambda v: F.struct(v["x_ratio"].alias("x_ratio"), v["y_ratio"].alias("y_ratio"))
    none = F.array().cast("array<struct<x_ratio:double,y_ratio:double>>")
    anchors = F.aggregate(items, none, lambda done, v: F.when(F.exists(done, lambda a: near(a, v)), done).otherwise(F.concat(done, F.array(place(v)))))
    bound = F.element_at(F.transform(F.array(anchors), lambda found: F.transform(items, lambda v: F.array_position(F.transform(found, lambda a: near(a, v)), True))), 1)
    return bound


def required(pages: Column) -> Column:
    """How many pages must repeat a thing: 2 of up to 3, else 3 and three tenths."""
    return F.when(pages <= 3, 2).otherwise(F.greatest(F.lit(3), F.ceil(0.3 * pages)))


def repeated(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, zone, kind, signature, shift, cluster, x_ratio, y_ratio, n_pages, items: what recurs at one place on enough pages.

    ``kind`` is text, or number for page numbers that all differ from their
    page's place in the document by ``shift``; the place is that of the
    cluster's first member.  In a document of one page a printed 1 is enough.
    """
    text = F.struct(F.lit("text").alias("kind"), F.col("signature").alias("name"))
    number = F.when(F.col("number").isNotNull(), F.struct(F.lit("number").alias("kind"), F.lit("").alias("name")))
    named = found.select("*", F.explode(F.array_compact(F.array(text, number))).alias("as")).select("*", "as.kind", "as.name")
    item = F.struct("page_no", "entry_idx", "x_ratio", "y_ratio", F.when(F.col("kind") == "number", F.col("number") - F.col("page_no")).alias("shift"), "number")
    listed = named.groupBy("doc_id", "zone", "kind", "name").agg(F.array_sort(F.collect_list(item)).alias("all"))
    # what stands once recurs nowhere; only a number may be enough then
    listed = listed.where((F.size("all") > 1) | (F.col("kind") == "number"))
    placed = listed.withColumn("at", _clusters(F.col("all"))).select("doc_id", "zone", "kind", F.col("name").alias("signature"), F.explode(F.arrays_zip("all", "at")).alias("m"))
    placed = placed.select("doc_id", "zone", "kind", "signature", F.col("m.all.shift").alias("shift"), F.col("m.at").cast("int").alias("cluster"), F.col("m.all").alias("item"))
    one = F.count_if((F.col("kind") == "number") & (F.col("item.number") == 1))
    grouped = placed.groupBy("doc_id", "zone", "kind", "signature", "shift", "cluster").agg(F.count_distinct("item.page_no").alias("n_pages"), one.alias("ones"), F.array_sort(F.collect_list(F.struct("item.page_no", "item.entry_idx", "item.x_ratio", "item.y_ratio"))).alias("items"))
    counts = boxes.groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages"))
    enough = (F.col("n_pages") >= required(F.col("pages"))) | ((F.col("pages") == 1) & (F.col("ones") > 0))
    first = F.col("items")[0]
    return grouped.join(counts, "doc_id").where(enough).select("doc_id", "zone", "kind", "signature", "shift", "cluster", first["x_ratio"].alias("x_ratio"), first["y_ratio"].alias("y_ratio"), "n_pages", "items")


def marked(found: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The candidates that recur, or stand on the same line of the same margin as one that does (one step, not further)."""
    sure = confirmed.select("doc_id", "zone", F.explode("items").alias("i")).select("doc_id", "zone", "i.page_no", "i.entry_idx").distinct().withColumn("sure", F.lit(True))
    line = F.collect_set(F.when(F.col("sure"), F.col("y_ratio"))).over(Window.partitionBy(*PAGE, "zone"))
    flagged = found.join(sure, [*PAGE, "zone", "entry_idx"], "left").withColumn("lines", line)
    return flagged.where(F.exists("lines", lambda y: F.abs(F.col("y_ratio") - y) <= Y_NEAR)).drop("lines", "sure")


def find(entries: DataFrame, boxes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The margins of all documents; the candidates, a small part of the entries, are written once, as they are read twice.

    Entries that are lists have their page's box beside them.
    """
    found = landed(candidates(entries, None if "entries" in entries.columns else boxes, keep))
    return marked(found, repeated(found, boxes))


def listed(margins: DataFrame) -> DataFrame:
    """doc_id, page_no, gone, n_excluded: each page's margins as a list of entry_idx, and how many there are."""
    return margins.groupBy(*PAGE).agg(F.collect_set("entry_idx").alias("gone"), F.count("*").alias("n_excluded"))


def left(entries: Column | str = "entries", gone: Column | str = "gone") -> Column:
    """A page's list of entries without those in ``gone``, which may be null."""
    gone = F.col(gone) if isinstance(gone, str) else gone
    return F.when(gone.isNull(), F.col(entries) if isinstance(entries, str) else entries).otherwise(F.filter(entries, lambda e: ~F.array_contains(gone, e["entry_idx"])))


def without(entries: DataFrame, margins: DataFrame) -> DataFrame:
    """The entries that are no margin, as they were.

    They meet their page's list of margins, so that they lie by page for what follows.
    """
    found = entries.join(listed(margins), PAGE, "left")
    if "entries" in entries.columns:
        return found.withColumn("entries", left()).drop("gone")
    return found.where(F.col("gone").isNull() | ~F.array_contains("gone", F.col("entry_idx"))).drop("gone", "n_excluded")


def artifacts(entries: DataFrame | None, margins: DataFrame) -> DataFrame:
    """doc_id, page_no, zone, text, left, bottom, right, top: each page's margins; parts with bars between, a line for each row.

    Margins that kept the fields ``READ`` need no entries.
    """
    own = margins if set(READ) <= set(margins.columns) else entries.join(margins.select(*PAGE, "entry_idx", "zone"), [*PAGE, "entry_idx"])

    def look(page: list[Entry], of: dict[int, str]) -> list[tuple]:
        out = []
        for zone in ("footer", "header"):
            rows = geometry.read([e for e in page if of.get(e.index) == zone])
            if rows:
                atoms = [a for r in rows for a in r.atoms]
                text = "\n".join(" | ".join(p.text for p in r.parts) for r in rows)
                out.append((zone, text, min(a.x for a in atoms), min(a.y - DESCENT * a.v_scale for a in atoms), max(a.end for a in atoms), max(a.y + a.v_scale for a in atoms)))
        return out

    return per_page(together(own, more=("zone",)), [("zone", "string"), ("text", "string"), ("left", "double"), ("bottom", "double"), ("right", "double"), ("top", "double")], look, more=("zone",))
