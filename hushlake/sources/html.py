"""HTML pages as tables.  The parser is tolerant and runs once per page, in
Arrow batches; what follows is relational."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "noscript", "template", "title", "head"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "html", "label", "li", "main", "nav",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTROLS = {"input", "select", "textarea", "button", "a"}


class _Page(HTMLParser):
    """Text blocks and controls in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.blocks, self.pieces, self.tag = 0, [], [], "body"
        self.controls, self.images = [], []

    def _end_block(self):
        text = " ".join(p for p in (" ".join(x.split()) for x in self.pieces) if p)
        if text:
            self.blocks.append((self.tag, text))
        self.pieces = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BLOCKS:
            self._end_block()
            self.tag = tag
        if tag in CONTROLS and not self.skip and not (tag == "a" and "href" not in a):
            self.controls.append((tag, a.get("type", ""), a.get("name", ""), a.get("href", a.get("value", "")), a.get("autocomplete", "")))
        elif tag in ("img", "canvas", "video", "svg"):
            self.images.append((tag, a.get("alt", ""), a.get("class", ""), a.get("src", "")))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS:
            self._end_block()
            self.tag = "body"

    def handle_data(self, data):
        if not self.skip:
            self.pieces.append(data)


def _parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    page._end_block()
    return page


def text_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", max_chars: int | None = None) -> DataFrame:
    """(key, ord, tag, text): text under its nearest block, scripts left out,
    up to ``max_chars`` characters per page where that is given.  A null page has
    no blocks, a null key stays."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, h in zip(frame[key], frame[html]):
                left = max_chars if max_chars is not None else len(h or "") + 1
                for n, (tag, text) in enumerate(_parsed(h).blocks):
                    if left <= 0:
                        break
                    out.append((k, n, tag, text[:left]))
                    left -= len(text)
            yield pd.DataFrame(out, columns=["k", "ord", "tag", "text"]).astype({"ord": "int32"})

    return _rows_of(pages, key, html, rows, "ord int, tag string, text string")


def _rows_of(pages: DataFrame, key: str, html: str, rows, schema: str) -> DataFrame:
    """Rows that ``rows`` makes of pages.  The key goes along as a string, as pandas
    has no integers beside nulls."""
    kind = pages.schema[key].dataType
    done = pages.select(F.col(key).cast("string").alias(key), html).mapInPandas(rows, f"k string, {schema}")
    return done.withColumn("k", F.col("k").cast(kind)).withColumnRenamed("k", key)


def controls(pages: DataFrame, key: str = "page_id", html: str = "html", most: int | None = None) -> DataFrame:
    """(key, ord, tag, type, name, value, autocomplete) of links and controls, the
    first ``most`` of a page where that is given."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [
                (k, n, *c)
                for k, h in zip(frame[key], frame[html])
                for n, c in enumerate(_parsed(h).controls[:most])
            ]
            names = ["k", "ord", "tag", "type", "name", "value", "autocomplete"]
            yield pd.DataFrame(out, columns=names).astype({"ord": "int32"})

    return _rows_of(pages, key, html, rows, "ord int, tag string, type string, name string, value string, autocomplete string")


def page_languages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    lang = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), "(?i)<html[^>]*\\blang=\"?([a-zA-Z-]+)", 1)
    return pages.select(key, F.lower(lang).alias("lang"))
