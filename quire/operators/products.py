"""Products, given as JSON, to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import json_path
from quire.functions.cursor import seconds
from quire.functions.json_path import Parsed, tree
from quire.functions.text import strip_tags
from quire.operators import documents

#: products of a preview
PREVIEW = (1, 25)


def node(json: Column | Parsed, *path: str) -> Column:
    """The variant at a path of names; null if a name on the way is missing."""
    return F.try_variant_get(tree(json), "$" + "".join(f"['{p}']" for p in path), "variant")


def translated(json: Column | Parsed, field: str, *path: str) -> Column:
    """translated.field, else field, of the object at a path, trimmed; '' if it is missing."""
    of = lambda *more: json_path.scalar(node(json, *path, *more))
    there = lambda *more: F.schema_of_variant(node(json, *path, *more))
    given = F.coalesce(there("translated", field) != "VOID", F.lit(False))
    return F.coalesce(F.when(given, of("translated", field)).otherwise(of(field)), F.lit(""))


def changed_at(json: Column | Parsed) -> Column:
    """Epoch seconds of the last change, else of the creation; 0 if neither is a time."""
    text = lambda name: F.nullif(json_path.scalar(node(json, name)), F.lit(""))
    return seconds(text("updatedAt"), text("createdAt"))


def is_active(json: Column | Parsed) -> Column:
    """Whether the product is shown; one that does not say so is."""
    own = node(json, "active")
    return own.isNull() | (F.schema_of_variant(own) == "VOID") | json_path.truthy(json_path.scalar(own))


def categories(json: Column | Parsed) -> Column:
    """Names of the categories, translated ones first; none empty, each once."""
    every = F.coalesce(F.try_variant_get(tree(json), "$.categories", "array<variant>"), F.array().cast("array<variant>"))
    get = lambda v, path: F.nullif(json_path.scalar(F.try_variant_get(v, path, "variant")), F.lit(""))
    names = F.transform(every, lambda v: F.coalesce(get(v, "$.translated.name"), get(v, "$.name"), F.lit("")))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def custom_fields(json: Column | Parsed, allowed: list[str]) -> Column:
    """array<struct<key,value>> of the scalar custom fields, by key; an empty list allows all."""
    given = F.coalesce(F.try_variant_get(tree(json), "$.customFields", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kind = lambda v: F.schema_of_variant(v)
    scalars = F.map_filter(given, lambda k, v: v.isNotNull() & ~(kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY") | (kind(v) == "VOID")))
    if allowed:
        scalars = F.map_filter(scalars, lambda k, v: k.isin(allowed))
    return F.array_sort(F.transform(F.map_entries(scalars), lambda e: F.struct(e["key"].alias("key"), json_path.scalar(e["value"]).alias("value"))))


def _lines(heading: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(heading + ":\n"), F.array_join(lines, "\n")))


def field_block(json: Column | Parsed, allowed: list[str]) -> Column:
    """``key: value`` lines of the custom fields below their heading; null without fields."""
    return _lines("Custom fields", F.transform(custom_fields(json, allowed), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))


def path_block(json: Column | Parsed, paths: list[str]) -> Column:
    """``path: value, value`` lines of the indexed paths that hold values, below their heading; null without lines."""
    values = [(p, F.array_distinct(json_path.values(json, p))) for p in paths]
    lines = [F.when(F.size(v) > 0, F.concat(F.lit(p + ": "), F.array_join(v, ", "))) for p, v in values]
    return _lines("Additional fields", F.filter(F.array(*lines).cast("array<string>"), lambda s: s.isNotNull())) if lines else F.lit(None).cast("string")


def content(json: Column | Parsed, allowed: list[str], paths: list[str]) -> Column:
    """The product's text: title, description without tags, number, manufacturer, custom and indexed fields."""
    number = json_path.scalar(node(json, "productNumber"))
    described = strip_tags(translated(json, "description"))
    return documents.content(translated(json, "name"), described, documents.labelled("Product number", number), documents.labelled("Manufacturer", translated(json, "name", "manufacturer")), field_block(json, allowed), path_block(json, paths))


def build(products: DataFrame, base: str, path: str, allowed: list[str], paths: list[str], extras: dict[str, str] | None = None, indexer: int = 0) -> DataFrame:
    """source_id, changed_at, active, content, content_hash, metadata of products that make documents; of others content is null.

    ``metadata`` is a map; what is set later counts: fixed keys, then what the
    custom fields tell about a contact, then the given extras.
    """
    json = Parsed(F.col("_tree"))
    products = products.select(F.try_parse_json("product").alias("_tree"))
    key = json_path.scalar(node(json, "id"))
    fields = custom_fields(json, allowed)
    read = products.select(key.alias("source_id"), changed_at(json).alias("changed_at"), is_active(json).alias("active"), content(json, allowed, paths).alias("text"), translated(json, "name").alias("title"), json_path.scalar(node(json, "productNumber")).alias("number"), categories(json).alias("categories"), fields.alias("fields"))
    read = read.withColumn("contact", documents.contact_metadata(F.col("fields"), F.col("categories")))
    fixed = {
        "external_indexer_uid": F.lit(str(indexer)), "product_id": F.col("source_id"), "title": F.col("title"), "product_title": F.col("title"), "productNumber": F.col("number"),
        "customFields": F.to_json(F.map_from_entries("fields")), "category": F.to_json("categories"), "keywords": F.to_json("categories"), "url": documents.product_url(base, path, F.col("source_id")),
    }
    told = {n: F.col(f"contact.{n}").cast("string") for n in ("contact_name", "phone", "email", "department", "contact_sensitive")}
    given = {k: F.lit(v) for k, v in (extras or {}).items() if k.strip()}
    every = fixed | told | given  # the last of a name counts
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in every.items()])
    ok = (F.col("source_id") != "") & (F.col("changed_at") > 0) & (F.col("text") != "")
    body = F.when(ok, F.col("text"))
    return read.select("source_id", "changed_at", "active", body.alias("content"), F.sha2(body, 256).alias("content_hash"), F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("metadata"))


def preview(products: DataFrame, limit: int) -> DataFrame:
    """id, name, product_number, active, updated_at, line of the first products, 1 to 25 of them."""
    json = F.col("product")
    text = lambda name: json_path.scalar(node(json, name))
    rows = products.select(text("id").alias("id"), translated(json, "name").alias("name"), text("productNumber").alias("product_number"), is_active(json).alias("active"), text("updatedAt").alias("updated_at"))
    few = rows.orderBy("updated_at", "id").limit(max(PREVIEW[0], min(PREVIEW[1], limit)))
    line = F.concat(F.lit("- "), F.col("id"), F.lit(" | "), F.col("name"), F.lit(" | "), F.col("product_number"), F.lit(" | "), F.when(F.col("active"), "active").otherwise("inactive"), F.lit(" | "), F.col("updated_at"))
    return few.withColumn("line", line)


def associations(products: DataFrame, covers: DataFrame, media: DataFrame, properties: DataFrame, groups: DataFrame) -> DataFrame:
    """product_id, cover_url, properties array<struct<group,name>>: the product with its cover's medium and its properties' groups."""
    cover = covers.join(media, "media_id", "left").select("product_id", F.col("url").alias("cover_url"))
    named = properties.join(groups, "group_id", "left").groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("group", "name"))).alias("properties"))
    return products.select("product_id").join(cover, "product_id", "left").join(named, "product_id", "left")
