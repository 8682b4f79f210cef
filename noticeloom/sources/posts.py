"""Publications from posts of a REST listing: a Python data source over HTTP or recorded responses, and the parsing as columns."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlencode, urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThanOrEqual, InputPartition

from noticeloom.functions.text import clean_text
from noticeloom.sources.http import PacedClient, RecordedClient

# Fixed value: the fields that a listing is asked for.
FIELDS = "id,date_gmt,link,title,content"
_RENDERED = T.StructType([T.StructField("rendered", T.StringType())])
POST = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("date_gmt", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("title", _RENDERED),
        T.StructField("content", _RENDERED),
    ]
)


def posts_of(bodies: DataFrame) -> DataFrame:
    """``body`` (JSON lists of posts) to posts. A body that is no list gives a row whose ``corrupt`` holds its start."""
    parsed = bodies.select("body", F.from_json("body", T.ArrayType(POST)).alias("posts"))
    rows = parsed.select("body", F.explode_outer("posts").alias("post"))
    bad = F.col("post").isNull() & ~F.col("body").rlike(r"^\s*\[\s*\]\s*\z") | F.col("post.id").isNull() & F.col("post").isNotNull()
    return rows.where(F.col("post").isNotNull() | bad).select("post.*", F.when(bad, F.substring("body", 1, 200)).alias("corrupt"))


def links(content: Column) -> Column:
    """``array<struct<url, label>>`` of web links in a fragment; of links to one address the first stays."""
    pattern = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    urls = F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), lambda u: clean_text(u, numeric=False))
    labels = F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(2)), lambda x: clean_text(x, numeric=False))
    every = F.filter(F.arrays_zip(urls.alias("url"), labels.alias("label")), lambda x: x["url"].rlike("(?i)^https?://"))
    return F.transform(F.array_distinct(F.transform(every, lambda x: x["url"])), lambda u: F.get(F.filter(every, lambda x: x["url"] == u), F.lit(0)))


def resolved_links(html: Column, page: Column) -> Column:
    """Distinct addresses of a page in order, relative to its host where they start with a slash."""
    host = F.regexp_extract(page, "^https?://[^/?#]+", 0)
    every = F.regexp_extract_all(html, F.lit('(?i)href="([^"]*)"'), F.lit(1))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.when(x.rlike("(?i)^https?://"), x).when(x.startswith("/"), F.concat(host, x)).otherwise("")), lambda x: x != ""))


def publications(posts: DataFrame) -> DataFrame:
    """``key, url, heading, published, documents`` of posts; corrupt rows have no key and stay out."""
    return posts.where("corrupt is null").select(
        F.col("id").cast("string").alias("key"),
        F.col("link").alias("url"),
        clean_text(F.col("title.rendered")).alias("heading"),
        F.to_timestamp(F.concat("date_gmt", F.lit("Z"))).alias("published"),
        links(F.col("content.rendered")).alias("documents"),
    )


def listing_url(api: str, page: int, after: str | None = None, search: str | None = None, categories: str | None = None, per_page: int = 100) -> str:
    """What is asked for: newest first, the fields that are read, and only what is newer, if that is known."""
    query = {"per_page": per_page, "page": page, "orderby": "date", "order": "desc", "_fields": FIELDS}
    query |= {k: v for k, v in (("search", search), ("categories", categories), ("after", after)) if v}
    return f"{api}?{urlencode(query)}"


class HostPartition(InputPartition):
    """One host is read by one task, so that requests to it follow each other."""

    def __init__(self, api: str):
        super().__init__(urlparse(api).netloc)
        self.api = api


class PostReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.after = options, options.get("after")

    def partitions(self):
        return [HostPartition(self.options["api"])]

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        o = self.options
        client = RecordedClient(o["replay"]) if "replay" in o else PacedClient()
        page, pages = 1, 1
        while page <= pages:
            answer = client.get(listing_url(partition.api, page, self.after, o.get("search"), o.get("categories"), int(o.get("perPage", 100))), ("application/json",))
            posts = json.loads(answer.body)
            if not isinstance(posts, list):
                raise ValueError(f"no list of posts at {partition.api}, page {page}")
            if not posts:
                return
            for p in posts:
                yield p["id"], p["date_gmt"], p["link"], (p["title"]["rendered"],), (p["content"]["rendered"],)
            pages, page = int(answer.headers.get("x-wp-totalpages", page)), page + 1


class PushingPostReader(PostReader):
    """For sessions with ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters):  # noqa: N802
        """A lower bound of the date goes into the request; Spark still applies the filter itself."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("date_gmt",):
                self.after = str(f.value)
            yield f


class PostSource(DataSource):
    """``spark.read.format("posts").option("api", ...)``; options ``search, categories, perPage, after``, ``pushdown`` (true: a
    lower bound of the date in a filter goes into the request) and ``replay`` (a file of recorded responses)."""

    @classmethod
    def name(cls) -> str:
        return "posts"

    def schema(self) -> T.StructType:
        return POST

    def reader(self, schema) -> PostReader:
        problems = []
        o = self.options
        if not o.get("api", "").startswith(("http://", "https://")):
            problems.append("api must be a web address")
        if not (o.get("search") or o.get("categories")):
            problems.append("needs search or categories")
        if not 1 <= int(o.get("perPage", 100)) <= 100:
            problems.append("perPage must be from 1 to 100")
        if problems:
            raise ValueError("; ".join(problems))
        return (PushingPostReader if o.get("pushdown") == "true" else PostReader)(dict(o))
