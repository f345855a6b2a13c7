"""Products to documents with metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what a field's name tells about it, in this order
CONTACT = "contact|ansprechpartner|ansprechperson|kontakt|name"
PHONE = "phone|telefon|telephone|tel"
EMAIL = "email|e_mail|mail"
DEPARTMENT = "department|bereich|abteilung|zustaendig|zustaendigkeit|zuständig"


def content(*parts: Column) -> Column:
    """Parts that are not empty, with blank lines between."""
    return F.trim(F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts]))


def labelled(label: str, value: Column) -> Column:
    return F.when(F.trim(value) != "", F.concat(F.lit(label + ": "), F.trim(value)))


def product_url(base: str, path: str, key: Column) -> Column:
    base = base.rstrip("/")
    if not base:
        return F.lit("")
    return F.concat(F.lit("/".join(p for p in (base, path.strip("/")) if p) + "/"), key.cast("string"))


def field_lines(fields: Column, allowed: list[str] | None = None) -> Column:
    """``key: value`` lines of a map<string,string>, by key; an empty list of allowed keys allows all."""
    if allowed:
        fields = F.map_filter(fields, lambda k, v: k.isin(allowed))
    entries = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: F.trim(v) != "")))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.trim(e["value"]))), "\n")


def contact_metadata(fields: Column, categories: Column) -> Column:
    """struct of contact_name, phone, email, department, contact_sensitive from array<struct<key,value>>.

    Each field fills the first slot that its name fits and that is still open;
    a department without a field is the first category.
    """
    slots = (("contact_name", CONTACT), ("phone", PHONE), ("email", EMAIL), ("department", DEPARTMENT))
    none = F.lit(None).cast("string")
    start = F.struct(*[none.alias(n) for n, _ in slots])

    def put(state: Column, entry: Column) -> Column:
        name, value = F.lower(entry["key"]), F.trim(F.coalesce(entry["value"], F.lit("")))
        free = value != ""
        out = []
        for slot, pattern in slots:
            fits = free & state[slot].isNull() & name.rlike(pattern)
            out.append(F.when(fits, value).otherwise(state[slot]).alias(slot))
            free = free & ~fits
        return F.struct(*out)

    def finish(s: Column) -> Column:
        sensitive = s["contact_name"].isNotNull() | s["phone"].isNotNull() | s["email"].isNotNull()
        return F.struct(s["contact_name"].alias("contact_name"), s["phone"].alias("phone"), s["email"].alias("email"), F.coalesce(s["department"], F.get(categories, F.lit(0))).alias("department"), sensitive.alias("contact_sensitive"))

    return F.aggregate(fields, start, put, finish)


def page_documents(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text", url: str = "url") -> DataFrame:
    """One document per page with id ``<doc>#page-N``, page count and a link to the page (an old fragment goes)."""
    count = F.count("*").over(Window.partitionBy(doc))
    number = F.col(page).cast("string")
    return pages.select(doc, page, F.concat(F.col(doc).cast("string"), F.lit("#page-"), number).alias("source_id"), count.alias("page_count"), F.concat(F.substring_index(url, "#", 1), F.lit("#page="), number).alias("url"), text)


def whole_documents(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """Pages of a document joined by blank lines, in page order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    joined = pages.groupBy(doc).agg(rows.alias("pages"))
    return joined.select(doc, F.size("pages").alias("page_count"), F.trim(F.array_join(F.transform("pages", lambda r: r["t"]), "\n\n")).alias("text"))
