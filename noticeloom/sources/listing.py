"""Publications from a page that lists all items: each heading opens one, what follows gives its date and links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.functions.text import clean_text, fallback_key
from noticeloom.functions.times import long_date_instant

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Fixed value: the class of the box that holds a page's own content.
CONTENT_CLASS = "USP-postcontent"


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.inner = tag, attrs, parent, []

    def elements(self) -> list[Node]:
        return [x for x in self.inner if isinstance(x, Node)]

    def all(self, tag: str) -> Iterator[Node]:
        for x in self.elements():
            if x.tag == tag:
                yield x
            yield from x.all(tag)

    def text(self) -> str:
        return "".join(x.text() if isinstance(x, Node) else x for x in self.inner)

    def html(self) -> str:
        return "".join(f"<{x.tag}>{x.html()}</{x.tag}>" if isinstance(x, Node) else x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for x in self.inner)


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inner.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.inner.append(data)


def decoded(body: bytes, content_type: str | None) -> str:
    """By the charset of the content type, with UTF-8 to fall back on."""
    charset = "utf-8"
    for part in (content_type or "").split(";")[1:]:
        name, _, value = part.strip().partition("=")
        if name.lower() == "charset":
            charset = value.strip().strip('"')
    try:
        return body.decode(charset, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def page_text(bodies: pd.Series, types: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decoded(bytes(b), t) for b, t in zip(bodies, types, strict=True)], dtype=object)


def raw_items(html: str, page: str) -> list[dict]:
    """Heading and link fragments, and the lines among which the date is."""
    tree = Tree(html).root
    boxes = [x for x in _every(tree) if CONTENT_CLASS in x.attrs.get("class", "").split()]
    out = []
    for h2 in (boxes[0] if boxes else tree).all("h2"):
        box = h2.parent if h2.parent.tag == "div" and len(h2.parent.elements()) == 1 else h2
        siblings = box.parent.elements()
        rest = []
        for x in siblings[siblings.index(box) + 1 :]:
            if x.tag == "h2" or next(x.all("h2"), None):
                break
            rest.append(x)
        anchors = [a for x in rest for a in ([x] if x.tag == "a" else []) + list(x.all("a")) if a.attrs.get("href")]
        links = [(urljoin(page, a.attrs["href"].strip()), a.html()) for a in anchors]
        seen: dict[str, str] = {}
        for url, label in links:
            if url.lower().startswith(("http://", "https://")):
                seen.setdefault(url, label)
        out.append({"page": page, "place": len(out), "raw_heading": h2.html(), "lines": [x.text() for x in rest], "raw_links": [{"url": u, "label": x} for u, x in seen.items()]})
    return out


def _every(node: Node) -> Iterator[Node]:
    for x in node.elements():
        yield x
        yield from _every(x)


RAW = "page string, reading string, place int, raw_heading string, lines array<string>, raw_links array<struct<url:string,label:string>>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [r | {"reading": reading} for page, reading, html in zip(batch["page"], batch["reading"], batch["html"], strict=True) if html for r in raw_items(html, page)]
        yield pd.DataFrame(rows, columns=["page", "reading", "place", "raw_heading", "lines", "raw_links"])


def items_of_pages(pages: DataFrame) -> DataFrame:
    """``page, html`` to ``page, reading, place, heading, published, documents``; an item without a readable date has none.

    ``reading`` (a string) may tell apart rows of one address, which are listings of their own; without it, it is null.
    """
    reading = F.col("reading") if "reading" in pages.columns else F.lit(None).cast("string").alias("reading")
    raw = pages.select("page", reading, "html").mapInPandas(_parse, RAW)
    dates = F.filter(F.transform("lines", long_date_instant), lambda t: t.isNotNull())
    documents = F.transform("raw_links", lambda x: F.struct(x["url"].alias("url"), clean_text(x["label"], numeric=False).alias("label")))
    return raw.select("page", "reading", "place", clean_text(F.col("raw_heading")).alias("heading"), F.get(dates, F.lit(0)).alias("published"), documents.alias("documents"))


def keyed(items: DataFrame) -> DataFrame:
    """A stable key for each item, given from the oldest on: its first document's address, or, where an older item has that,
    a hash of heading and date. Exact repeats in a reading of a page go."""
    url = F.get("documents", F.lit(0))["url"]
    marked = items.withColumn("_url", url).withColumn("_mark", fallback_key(F.col("heading"), F.col("published")))
    oldest = Window.partitionBy("page", "reading", "_url").orderBy(F.desc("place"))
    ranked = marked.withColumn("_k", F.row_number().over(oldest)).withColumn("_owner", F.first("_mark").over(oldest))
    kept = ranked.where(F.col("_url").isNull() | (F.col("_k") == 1) | (F.col("_mark") != F.col("_owner")))
    named = kept.withColumn("key", F.when(F.col("_url").isNotNull() & (F.col("_k") == 1), F.col("_url")).otherwise(F.col("_mark")))
    first = Window.partitionBy("page", "reading", "key").orderBy(F.desc("place"))
    return named.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_k", "_owner", "_url", "_mark")
