"""Which reader a configured source has: a name to a function of settings and resume point, giving publications.

Each reader gives ``key, url, heading, published, documents``. ``replay`` is a file of recorded responses, for tests.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.sources import listing, posts
from noticeloom.sources.documents import fetched


def rest_posts(spark: SparkSession, settings: dict, since: dt.datetime, replay: str | None = None) -> DataFrame:
    """The resume point goes into the request."""
    spark.dataSource.register(posts.PostSource)
    options = {"api": settings["api"], "after": since.strftime("%Y-%m-%dT%H:%M:%S"), "search": settings.get("cerca"), "perPage": settings.get("perPagina"), "replay": replay}
    options["categories"] = ",".join(map(str, settings["categorie"])) if settings.get("categorie") else None
    read = spark.read.format("posts").options(**{k: str(v) for k, v in options.items() if v is not None}).load()
    return posts.publications(read.withColumn("corrupt", F.lit(None).cast("string")))


def html_page(spark: SparkSession, settings: dict, since: dt.datetime, replay: str | None = None) -> DataFrame:
    """The page has its whole history: all items are keyed before any is left out."""
    page = fetched(spark.createDataFrame([(settings["pagina"],)], "url string"), replay, ("text/html",))
    html = page.select(F.col("url").alias("page"), F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(listing.page_text(F.col("content"), F.col("content_type"))).alias("html"))
    items = listing.keyed(listing.items_of_pages(html))
    return items.where("published is not null").select("key", F.col("page").alias("url"), "heading", "published", "documents")


READERS: dict[str, Callable[..., DataFrame]] = {"wordpress": rest_posts, "pagina-decreti": html_page}
