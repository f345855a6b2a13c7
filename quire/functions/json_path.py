"""Dot paths over JSON text, with [] for every element of a list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parsed:
    """A variant column, for functions that would parse JSON text anew for each value that they read."""

    variant: Column


def tree(json: Column | Parsed) -> Column:
    """The text as a variant, null if it is no JSON."""
    return json.variant if isinstance(json, Parsed) else F.try_parse_json(json)


def _getter(name: str):
    return lambda node: F.try_variant_get(node, f"$['{name}']", "variant")


def values(json: Column | Parsed, path: str) -> Column:
    """array<string>: the scalars at a path, trimmed and none empty; booleans as 1 and nothing."""
    nodes = F.array(tree(json))
    for part in path.split("."):
        name, every = part.removesuffix("[]"), part.endswith("[]")
        if name:
            nodes = F.transform(nodes, _getter(name))
        nodes = F.filter(nodes, lambda n: n.isNotNull())
        if every:
            nodes = F.flatten(F.transform(nodes, lambda n: F.coalesce(F.try_variant_get(n, "$", "array<variant>"), F.array().cast("array<variant>"))))
    return F.filter(F.transform(nodes, scalar), lambda s: s != "")


def scalar(node: Column) -> Column:
    """A scalar as trimmed text; lists, objects and nulls as ''."""
    kind = F.schema_of_variant(node)
    text = F.trim(F.coalesce(F.try_variant_get(node, "$", "string"), F.lit("")))
    return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID"), "").when(kind == "BOOLEAN", F.when(text == "true", "1").otherwise("")).otherwise(text)


def translated(json: Column, field: str) -> Column:
    """translated.field, else field, else '', trimmed."""
    node = F.try_parse_json(json)
    return F.trim(F.coalesce(F.try_variant_get(node, f"$.translated.{field}", "string"), F.try_variant_get(node, f"$.{field}", "string"), F.lit("")))


def truthy(text: Column) -> Column:
    """Whether a value given as text counts as set; a missing one does."""
    return F.coalesce(~text.isin("", "0", "0.0", "[]"), F.lit(True))
