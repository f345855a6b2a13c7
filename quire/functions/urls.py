"""URL and nested-parameter helpers."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import parse_qsl, quote, urlencode, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

_HREF = r"""(?i)(<a\b[^>]*?\bhref\s*=\s*)(["'])([^"']*)\2"""


def with_parameters(url: str, added: dict[str, str]) -> str:
    """The url with parameters set in its query; what it held before and its fragment stay."""
    parts = urlsplit(url)
    merged = dict(parse_qsl(parts.query, keep_blank_values=True)) | added
    return urlunsplit(parts._replace(query=urlencode(merged, quote_via=quote)))


def add_to_first_href(html: Column, query: str) -> Column:
    """HTML whose first link has ``query`` (encoded already) added before its fragment; the rest stays as it is."""
    quoted = query.replace("&", "&amp;")
    found, target = F.regexp_extract(html, _HREF, 0), F.regexp_extract(html, _HREF, 3)
    at = F.instr(html, found)
    before = F.substring_index(target, "#", 1)
    fragment = F.substring(target, F.length(before) + 1, F.length(target))
    link = F.concat(F.regexp_extract(html, _HREF, 1), F.regexp_extract(html, _HREF, 2), before, F.when(F.contains(before, F.lit("?")), "&amp;").otherwise("?"), F.lit(quoted), fragment, F.regexp_extract(html, _HREF, 2))
    changed = F.concat(F.substring(html, F.lit(1), at - 1), link, F.substring(html, at + F.length(found), F.length(html)))
    return F.when(found != "", changed).otherwise(html)


def get_in(tree, path: Sequence[str]):
    """The value at a path of nested mappings; None if there is none."""
    for name in path:
        if not isinstance(tree, dict) or name not in tree:
            return None
        tree = tree[name]
    return tree


def set_in(tree, path: Sequence[str], value) -> dict:
    """A copy with the value set at the path; what is no mapping on the way is replaced."""
    base = dict(tree) if isinstance(tree, dict) else {}
    if path:
        base[path[0]] = value if len(path) == 1 else set_in(base.get(path[0]), path[1:], value)
    return base


def remove_in(tree: dict, path: Sequence[str]) -> dict:
    """A copy without the path and without mappings that it leaves empty."""
    if not path or not isinstance(tree, dict) or path[0] not in tree:
        return tree
    rest = {k: v for k, v in tree.items() if k != path[0]}
    if len(path) > 1 and isinstance(tree[path[0]], dict):
        below = remove_in(tree[path[0]], path[1:])
        if below:
            return {k: (below if k == path[0] else v) for k, v in tree.items()}
    elif len(path) > 1:
        return tree
    return rest
