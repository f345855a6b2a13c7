"""Products of a shop's HTTP interface as a Spark data source, and the table form of the same search."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.error import URLError
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.operators.cleanup import page_size

Send = Callable[[str, dict, dict], object]


def send(url: str, body: dict, headers: dict) -> object:
    """Posts JSON and returns the JSON of the answer."""
    request = Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Accept": "application/json"} | headers)
    with urlopen(request, timeout=60) as answer:
        return json.load(answer)


def clean_url(url: str | None) -> str:
    return (url or "").strip().rstrip("/")


def since_text(at: Column) -> Column:
    """A time as the interface takes it, its milliseconds set to zero."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(at), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


def token(base: str, client: str, key: str, post: Send = send) -> str:
    """An access token; '' if anything is missing or the answer holds none."""
    if not (base and client and key):
        return ""
    try:
        answer = post(f"{base}/api/oauth/token", {"grant_type": "client_credentials", "client_id": client, "client_secret": key}, {})
    except (URLError, OSError, ValueError):
        return ""
    found = answer.get("access_token") if isinstance(answer, dict) else None
    return found if isinstance(found, str) else ""


def search_body(since: str, before: str | None, page: int, limit: int, total: bool) -> dict:
    """The search for top-level products that changed in a span, in the order of change and id."""
    spans = [{"gte": since}, *([{"lt": before}] if before else [])]
    filters = [{"type": "equals", "field": "parentId", "value": None}, *({"type": "range", "field": "updatedAt", "parameters": p} for p in spans)]
    body = {
        "includes": {"category": ["id", "name"]},
        "associations": {"cover": {"associations": {"media": {}}}, "categories": {}, "properties": {"associations": {"group": {}}}, "manufacturer": {}},
        "filter": filters,
        "limit": limit,
        "page": page,
        "sort": [{"field": f, "order": "ASC"} for f in ("updatedAt", "id")],
    }
    return body | ({"total-count-mode": 1} if total else {})


def rows_of(answer: object) -> list[dict]:
    """Products of an answer; whatever is no object is left out."""
    data = answer.get("data") if isinstance(answer, dict) else None
    return [r for r in data if isinstance(r, dict)] if isinstance(data, list) else []


def scan(base: str, access: str, since: str, before: str | None = None, limit: int = 100, post: Send = send) -> Iterator[dict]:
    """All products of a span, page by page until one is empty."""
    page = 1
    while True:
        answer = post(f"{base}/api/search/product", search_body(since, before, page, page_size(limit), page == 1), {"Authorization": f"Bearer {access}"})
        found = rows_of(answer)
        if not found:
            return
        yield from found
        page += 1


def by_ids(base: str, access: str, ids: list[str], post: Send = send) -> dict[str, dict]:
    """Products by id; ids are trimmed, blank ones dropped, each asked for once."""
    wanted = list(dict.fromkeys(i for i in map(str.strip, ids) if i))
    if not wanted:
        return {}
    body = {"filter": [{"type": "equalsAny", "field": "id", "value": "|".join(wanted)}], "includes": {"product": ["id", "active", "updatedAt", "createdAt"]}, "limit": len(wanted), "page": 1}
    return {str(r["id"]): r for r in rows_of(post(f"{base}/api/search/product", body, {"Authorization": f"Bearer {access}"})) if r.get("id")}


class ShopSource(DataSource):
    """``spark.read.format("shop_products")``: one row of JSON a product.

    Options: url, client, key, since, before (both as the interface writes
    times), limit.  Without a token the read fails: it must not look as if the
    shop were empty.
    """

    @classmethod
    def name(cls) -> str:
        return "shop_products"

    def schema(self) -> str:
        return "product string"

    def reader(self, schema) -> DataSourceReader:
        return ShopReader(dict(self.options))


class ShopReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # pages follow each other by offset

    def read(self, partition) -> Iterator[tuple]:
        o = self.options
        base = clean_url(o.get("url"))
        access = token(base, o.get("client", ""), o.get("key", ""))
        if not access:
            raise RuntimeError("the shop gave no access token")
        for product in scan(base, access, o.get("since", "1970-01-01T00:00:00.000Z"), o.get("before"), int(o.get("limit", 100))):
            yield (json.dumps(product),)


def search_table(products: DataFrame, since: int, before: int | None = None, page: int = 1, limit: int = 100, total: bool = False) -> DataFrame:
    """One page of the same search on a table (id, parent_id, updated_at in seconds, ...): top-level rows of a span by change and id.

    With ``total`` each row carries the count of all rows of the span.
    """
    wanted = F.col("parent_id").isNull() & (F.col("updated_at") >= since)
    if before is not None:
        wanted &= F.col("updated_at") < before
    found = products.where(wanted)
    size = page_size(limit)
    out = found.orderBy("updated_at", "id").offset((max(1, page) - 1) * size).limit(size)
    return out.withColumn("total", found.select(F.count("*")).scalar()) if total else out
