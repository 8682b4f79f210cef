"""Upserts of whole tables: Parquet has no MERGE, so a new state is what stays and what is new, from one full join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def statuses(stored: DataFrame, read: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``keys`` and ``status``: ``new``, ``updated``, ``unchanged`` or ``removed`` (only stored). Structs are compared field by field."""
    old = stored.select(*keys, F.struct(*values).alias("_old"))
    new = read.select(*keys, F.struct(*values).alias("_new"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return old.join(new, keys, "full").select(*keys, status.alias("status"))


def upserted(stored: DataFrame, read: DataFrame, keys: list[str], remove: bool = False) -> DataFrame:
    """The table after writing ``read`` over it; with ``remove``, rows that were not read go."""
    return read if remove else stored.join(read.select(*keys), keys, "left_anti").unionByName(read)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last write of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ignored_if_known(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or do nothing."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def first_per_group(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def links_by_document_then_order(stored: DataFrame, extracted: DataFrame) -> DataFrame:
    """Which stored notice of a publication each extracted one updates: by equal document, the rest in order; null is a new one.

    ``stored``: ``publication, notice, document``; ``extracted``: ``publication, place, document``.
    """
    s = first_per_group(stored.where("document is not null"), ["publication", "document"], ["notice"]).select("publication", "document", "notice")
    e = first_per_group(extracted.where("document is not null"), ["publication", "document"], ["place"]).select("publication", "document", "place")
    exact = e.join(s, ["publication", "document"]).select("publication", "place", "notice")
    free = stored.join(exact.select("publication", "notice"), ["publication", "notice"], "left_anti")
    rest = extracted.join(exact.select("publication", "place"), ["publication", "place"], "left_anti")
    free = free.withColumn("_k", F.row_number().over(Window.partitionBy("publication").orderBy("notice")))
    rest = rest.withColumn("_k", F.row_number().over(Window.partitionBy("publication").orderBy("place")))
    ordered = rest.join(free.select("publication", "notice", "_k"), ["publication", "_k"], "left").select("publication", "place", "notice")
    return exact.unionByName(ordered)


def better(records: DataFrame, key: str) -> DataFrame:
    """The record that a merged notice keeps: one with a document before one without, then the earliest."""
    w = Window.partitionBy(key).orderBy(F.col("document").isNull().cast("int"), F.col("arrived"))
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def link_changes(stored: DataFrame, listed: DataFrame, read: DataFrame) -> DataFrame:
    """``publication, url, place, change``: what becomes of each document link, from one full join.

    ``stored``: ``publication, url, place, hash, error``; ``listed``: ``publication, url, place`` as the publications list them now; ``read``:
    ``publication, url, hash, error`` of what was fetched. ``delete``: no longer listed; ``insert``: listed and fetched for the first time;
    ``update``: fetched again with another outcome, wherever it stands; ``move``: elsewhere in the order; ``keep``. A link that is
    listed but was never fetched has no row yet. ``place`` is null where a link goes.
    """
    keys = ["publication", "url"]
    old = stored.select(*keys, F.col("place").alias("_at"), F.struct("hash", "error").alias("_was"))
    new = read.select(*keys, F.struct("hash", "error").alias("_now"))
    # of a link that a publication lists twice, the first place counts
    once = listed.groupBy(*keys).agg(F.min("place").alias("place"), F.lit(True).alias("_listed"))
    both = once.join(old.join(new, keys, "full"), keys, "full")
    change = (
        F.when(F.col("_listed").isNull(), F.when(F.col("_was").isNotNull(), "delete"))
        .when(F.col("_was").isNull(), F.when(F.col("_now").isNotNull(), "insert"))
        .when(F.col("_now").isNotNull() & ~F.col("_now").eqNullSafe(F.col("_was")), "update")
        .when(F.col("place") != F.col("_at"), "move")
        .otherwise("keep")
    )
    return both.select(*keys, "place", change.alias("change")).where("change is not null")


def reconciled(stored: DataFrame, read: DataFrame, changes: DataFrame) -> DataFrame:
    """The links after :func:`link_changes`: columns of ``stored``, which ``read`` has too (but ``place``)."""
    keys = ["publication", "url"]
    kept = stored.drop("place").join(changes.where("change in ('keep', 'move')").select(*keys, "place"), keys)
    written = read.drop("place").join(changes.where("change in ('insert', 'update')").select(*keys, "place"), keys)
    return kept.select(stored.columns).unionByName(written.select(stored.columns))


def without_children(parent_gone: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """A cascade: rows whose parent went go too."""
    return child.join(parent_gone.select(key).distinct(), key, "left_anti")
