"""Web pages: main text and links, parsed row by row in Arrow batches; everything after the parse is native."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scholarmesh.functions.text import collapse_spaces, let

MIN_MAIN_TEXT = 100
BLOCK_BYTES = 1 << 20

# Elements outside of the main text; elements that start and end a line; elements without content.
SCAFFOLD = {"nav", "header", "footer", "aside", "script", "style", "noscript", "form"}
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "br", "table", "ul", "ol"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

RAW = T.StructType([T.StructField("text", T.StringType()), T.StructField("heading", T.StringType()),
                    T.StructField("links", T.ArrayType(T.StructType([
                        T.StructField("label", T.StringType()), T.StructField("url", T.StringType())])))])
# Elements whose end tag may be left out: a start tag of these ends an open one.
ENDED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


class _Segments(HTMLParser):
    """Raw visible text (a line feed per block), heading and links; tidying is left to column expressions.

    `open` holds the open elements, `hidden` the number of them that are outside of the hidden one, if there is one. An
    end tag closes everything inside its element, so a hidden element that is never closed ends with its parent.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: dict[str, list[str]] = {"text": [], "heading": []}
        self.links: list[tuple[str, list[str]]] = []
        self.open: list[str] = []
        self.hidden: int | None = None

    def _close(self, keep: int) -> None:
        del self.open[keep:]
        if self.hidden is not None and keep <= self.hidden:
            self.hidden = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open and tag in ENDED_BY.get(self.open[-1], ()):
            self._close(len(self.open) - 1)
        given = {k: v or "" for k, v in attrs}
        if tag not in VOID:
            scaffold = tag in SCAFFOLD or given.get("role") == "navigation" or any(
                "menu" in given.get(k, "") for k in ("class", "id"))
            if scaffold and self.hidden is None:
                self.hidden = len(self.open)
            self.open.append(tag)
        if self.hidden is None:
            if tag in BLOCKS:
                self.parts["text"].append("\n")
            if tag == "a" and given.get("href"):
                self.links.append((given["href"], []))

    def handle_endtag(self, tag: str) -> None:
        if self.hidden is None and tag in BLOCKS:
            self.parts["text"].append("\n")
        if tag in self.open:
            self._close(len(self.open) - 1 - self.open[::-1].index(tag))
        if tag == "h1" and self.hidden is None and self.parts["heading"]:
            self.parts["heading"].append("\0")  # the first heading ends here

    def handle_data(self, data: str) -> None:
        if self.hidden is None and "title" not in self.open:
            self.parts["text"].append(data)
            if "h1" in self.open:
                self.parts["heading"].append(data)
            if "a" in self.open and self.links:
                self.links[-1][1].append(data)


def _absolute(page: str | None, href: str) -> str | None:
    try:
        return urljoin(page or "", href.strip())
    except ValueError:  # malformed address
        return None


def _blocks(html: pa.Array) -> Iterator[slice]:
    """Rows of about BLOCK_BYTES of markup at a time, one at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(html), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
        yield slice(lo, hi)
        lo = hi


@F.arrow_udf(RAW)
def _segments(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A block's pages at a time: results go back by the block, only the batch that came in stays as Arrow memory."""
    kind = to_arrow_type(RAW)
    for htmls, urls in batches:
        for block in _blocks(htmls):
            rows = []
            for html, url in zip(htmls[block], urls[block]):
                url = url.as_py()
                page = _Segments()
                page.feed(html.as_py() or "")
                page.close()
                rows.append({"text": "".join(page.parts["text"]), "heading": "".join(page.parts["heading"]),
                             "links": [{"label": "".join(label), "url": _absolute(url, href)} for href, label in page.links]})
            yield pa.array(rows, kind)


def _tidy(raw: Column) -> Column:
    """Struct (text, heading, links): lines without outer and repeated spaces, web links by first occurrence of an address."""
    def link(x: Column) -> Column:
        label = F.btrim(collapse_spaces(x["label"]), F.lit("[]() "))
        return F.struct(F.coalesce(F.nullif(label, F.lit("")), x["url"]).alias("label"), x["url"].alias("url"))

    lines = F.filter(F.transform(F.split(raw["text"], r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), collapse_spaces),
                     lambda x: x != "")
    web = F.transform(F.filter(raw["links"], lambda x: x["url"].rlike("(?i)^https?:")), link)
    first = let(web, lambda w: let(F.transform(w, lambda x: x["url"]), lambda urls: F.filter(
        w, lambda x, i: F.array_position(urls, x["url"]) == i + 1)))
    return F.struct(F.array_join(lines, "\n").alias("text"), F.nullif(collapse_spaces(
        F.substring_index(raw["heading"], "\0", 1)), F.lit("")).alias("heading"), first.alias("links"))


def parse_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Pages without their HTML, with the parsed struct `page`."""
    raw = pages.withColumn("_raw", _segments(F.col(html), F.col(url))).drop(html)
    return raw.withColumn("page", _tidy(F.col("_raw"))).drop("_raw")


def extract_main_text(pages: DataFrame, min_chars: int = MIN_MAIN_TEXT, with_heading: bool = False) -> DataFrame:
    """(…, text, rejected_reason): main text line by line; too short texts are kept with a reason instead of a text."""
    parsed = parse_pages(pages)
    text = F.col("page.text")
    full = F.when(F.col("page.heading").isNotNull(), F.concat(F.lit("# "), F.col("page.heading"), F.lit("\n\n"), text)
                  ).otherwise(text) if with_heading else text
    short = F.length(text) < min_chars
    return parsed.withColumns({"rejected_reason": F.when(short, F.lit("no main text")),
                               "text": F.when(~short, full)}).drop("page")


def extract_links(pages: DataFrame, key: str = "page_id", in_main_text: bool = False) -> DataFrame:
    """(page_id, pos, label, url), one row per address of a page, first occurrence.

    With `in_main_text` only links whose label occurs in the page's text and that do not point into the page itself.
    """
    rows = parse_pages(pages).select(key, F.col("url").alias("_page"), "page.text", F.posexplode("page.links").alias("pos", "l"))
    if in_main_text:
        flat = F.lower(collapse_spaces(F.col("text")))
        own = F.concat(F.element_at(F.split("_page", r"\?"), 1), F.lit("#"))
        rows = rows.where(F.contains(flat, F.lower(F.col("l.label"))) & ~F.startswith(F.col("l.url"), own))
    return rows.select(key, "pos", "l.label", "l.url")

