"""Text, title and links of web pages, by pattern; an exact mode parses instead."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import let, words
from .urls import normalize, resolve, scheme

SKIPPED = ["script", "style", "noscript", "svg", "canvas", "template"]
BLOCKS = "p div section article header footer main aside nav ul ol li table tr td th h1 h2 h3 h4 h5 h6 br blockquote pre".split()
ENTITIES = [("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def decode(text: Column) -> Column:
    for name, value in ENTITIES:  # the ampersand last
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(decode(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " "))


def text(html: Column) -> Column:
    """Visible text, a line for each block."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    for tag in SKIPPED:
        # a self-closing one has no body
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*/>", "")
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n")
    t = decode(F.regexp_replace(t, r"(?s)<[^>]*>", ""))
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{2,}", "\n"), r"^\s+|\s+$", "")


def links(html: Column, base: Column) -> Column:
    """Distinct normalised http(s) targets of anchors, in order."""
    hrefs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    full = let(base, lambda b: F.transform(hrefs, lambda h: normalize(resolve(decode(F.trim(h)), b))))
    return F.array_distinct(F.filter(full, lambda u: scheme(u).isin("http", "https")))


class _Parser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag: str, attrs) -> None:  # noqa: ANN001
        self.depth += tag in SKIPPED
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_startendtag(self, tag: str, attrs) -> None:  # noqa: ANN001
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.depth = max(0, self.depth - (tag in SKIPPED))
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.out.append(data)


def parse(html: str | None) -> str:
    p = _Parser()
    p.feed(html or "")
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(StringType())
def exact_text(html: pd.Series) -> pd.Series:
    """text() by a parser, in Arrow batches, for pages on which patterns are not enough."""
    return html.map(parse)


def word_count(html: Column) -> Column:
    return F.size(words(text(html), r"[A-Za-z0-9]+"))
