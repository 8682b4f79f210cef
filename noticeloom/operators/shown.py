"""What a message shows beside a notice: where it was published, its first document, and what it may be a duplicate of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTE = "array<struct<other:bigint,source:string,published:timestamp,url:string>>"


def publications_in_order(bridge: DataFrame, publications: DataFrame, names: DataFrame) -> DataFrame:
    """``id, ps``: the publications that announce each notice, the first first. ``names``: ``source, name``; a source without a name shows its id."""
    named = publications.join(names, "source", "left").withColumn("source", F.coalesce("name", "source"))
    one = F.struct("published", "publication", "source", "url", F.get("documents", F.lit(0))["url"].alias("document"))
    return bridge.join(named, "publication").groupBy("id").agg(F.sort_array(F.collect_list(one)).alias("ps"))


def links(ordered: DataFrame) -> DataFrame:
    """``id, links``: the first document of any publication, and the page of each."""
    document = F.get(F.filter(F.transform("ps", lambda p: p["document"]), lambda u: u.isNotNull()), F.lit(0))
    page = F.transform("ps", lambda p: F.struct(F.concat(F.lit("Pagina ("), p["source"], F.lit(")")).alias("label"), p["url"].alias("url")))
    first = F.when(document.isNotNull(), F.array(F.struct(F.lit("Documento").alias("label"), document.alias("url")))).otherwise(F.slice(page, 1, 0))
    return ordered.select("id", F.concat(first, page).alias("links"))


def duplicate_notes(pairs: DataFrame, ordered: DataFrame) -> DataFrame:
    """``a, b`` to ``id, notes``: for both sides of each pair the other, where it was first published and at which address."""
    first = F.get("ps", F.lit(0))
    where = ordered.select(F.col("id").alias("other"), first["source"].alias("source"), first["published"].alias("published"), F.coalesce(first["document"], first["url"]).alias("url"))
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    return both.join(where, "other").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("other", "source", "published", "url"))).alias("notes"))


def with_shown(entries: DataFrame, key: list[str], ordered: DataFrame, pairs: DataFrame, sent: DataFrame) -> DataFrame:
    """Entries of digests with ``links`` and ``duplicates``; a duplicate says whether the recipient had it before.

    ``key``: ``recipient`` and perhaps more; ``sent``: ``recipient, id``.
    """
    noted = entries.join(duplicate_notes(pairs, ordered), "id").select(*key, "id", F.explode("notes").alias("x"))
    had = sent.select("recipient", F.col("id").alias("_other"), F.lit(True).alias("_had")).distinct()
    judged = noted.withColumn("_other", F.col("x.other")).join(had, ["recipient", "_other"], "left")
    note = F.struct("_other", F.col("x.source").alias("source"), F.col("x.published").alias("published"), F.col("x.url").alias("url"), F.coalesce("_had", F.lit(False)).alias("sent"))
    told = judged.withColumnsRenamed({k: f"_{k}" for k in key} | {"id": "_id"}).groupBy(*(f"_{k}" for k in key), "_id").agg(F.sort_array(F.collect_list(note)).alias("_notes"))
    same = F.col("id") == F.col("_id")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = entries.join(links(ordered), "id", "left").join(told, same, "left")
    plain = F.transform(F.coalesce("_notes", F.array().cast("array<struct<_other:bigint,source:string,published:timestamp,url:string,sent:boolean>>")), lambda n: F.struct(n["source"].alias("source"), n["published"].alias("published"), n["url"].alias("url"), n["sent"].alias("sent")))
    empty = F.array().cast("array<struct<label:string,url:string>>")
    return joined.withColumn("links", F.coalesce("links", empty)).withColumn("duplicates", plain).drop("_id", "_notes", *(f"_{k}" for k in key))
