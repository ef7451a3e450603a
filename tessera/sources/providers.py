"""Search providers and page fetchers as stored tables: the interface that a live connector would fill."""

from __future__ import annotations

from html.parser import HTMLParser
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import html as H
from ..functions import urls as U
from ..operators import web as WB

PAGE_BYTES = 2_000_000


class Provider(Protocol):
    name: str

    def search(self, query: str, limit: int) -> DataFrame:
        """(url, title, position) of at most limit results."""


class TableProvider:
    """Results that are kept in a table (query, position, url, title)."""

    def __init__(self, name: str, results: DataFrame) -> None:
        self.name, self.results = name, results

    def search(self, query: str, limit: int) -> DataFrame:
        return self.results.where(F.lower("query") == query.lower()).orderBy("position").limit(limit).select("url", "title", "position")


def article_results(payload: Column) -> Column:
    """Titles of an encyclopedia's JSON reply as (url, title) of its articles; blank ones dropped."""
    schema = "struct<query:struct<search:array<struct<title:string>>>>"
    found = F.coalesce(F.from_json(payload, schema)["query"]["search"]["title"], F.array().cast("array<string>"))
    titles = F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != "")
    return F.transform(titles, lambda t: F.struct(F.concat(F.lit("https://en.wikipedia.org/wiki/"), U.requote(F.replace(t, F.lit(" "), F.lit("_")))).alias("url"), t.alias("title")))


class _Organic(HTMLParser):
    """Anchors that carry a result class or stand in a second or third heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.heading, self.href, self.title, self.found = 0, None, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        self.heading += tag in ("h2", "h3")
        if tag == "a" and a.get("href") and (self.heading or {"result__a", "result-link", "result-title"} & set((a.get("class") or "").split())):
            self.href, self.title = a["href"], []

    def handle_endtag(self, tag: str) -> None:
        self.heading = max(0, self.heading - (tag in ("h2", "h3")))
        if tag == "a" and self.href:
            self.found.append((self.href, " ".join("".join(self.title).split())))
            self.href = None

    def handle_data(self, data: str) -> None:
        if self.href:
            self.title.append(data)


@F.udf(ArrayType(StructType([StructField("href", StringType()), StructField("title", StringType())])))
def organic_links(html: str | None) -> list[tuple[str, str]]:
    """A result page's organic links: nesting decides, so it is parsed; one page a search, so a plain function will do."""
    p = _Organic()
    p.feed(html or "")
    return p.found


def waterfall(providers: list[Provider], query: str, limit: int = 5) -> list[str]:
    """Addresses from providers in turn, each asked for what is still missing; unrelated batches are thrown away.

    limit is at most 50, so what is collected here stays small.
    """
    limit = max(1, min(int(limit), 50))
    text = " ".join(str(query or "").split())
    urls: list[str] = []
    keys: set[str] = set()
    if not text:
        return urls
    for p in providers:
        if len(urls) >= limit:
            break
        batch = p.search(text, limit - len(urls)).withColumns({"query": F.lit(text), "query_id": F.lit(1), "provider": F.lit(p.name)})
        if not WB.unrelated_batches(batch).isEmpty():
            continue
        for r in batch.orderBy("position").select("url").collect():
            key = r.url.rstrip("/").lower()
            if key not in keys and len(urls) < limit:
                keys.add(key)
                urls.append(r.url)
    return urls


def fetched(bodies: DataFrame) -> DataFrame:
    """(url, title, text, links, error) of raw replies (url, content_type, body).

    Plain text passes as it is, pages are extracted, other types and replies over the limit are errors.
    """
    kind = F.lower(F.trim(F.split_part(F.coalesce("content_type", F.lit("text/html")), F.lit(";"), F.lit(1))))
    body, url = F.col("body"), U.normalize(F.col("url"))
    plain, page = kind == "text/plain", kind.isin("text/html", "application/xhtml+xml")
    error = F.when(body.isNull(), "no reply").when(F.octet_length("body") > PAGE_BYTES, "too large").when(~plain & ~page, F.concat(F.lit("unsupported type "), kind))
    none = F.array().cast("array<string>")
    return bodies.select(
        url.alias("url"),
        F.when(plain, url).when(page, H.title(body)).alias("title"),
        F.when(error.isNotNull(), "").when(plain, body).otherwise(H.text(body)).alias("text"),
        F.when(error.isNull() & page, H.links(body, url)).otherwise(none).alias("links"),
        error.alias("error"),
    )
