"""Which records are the same notice: blocking joins, the pair relation, components and weak duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom import settings
from noticeloom.functions.times import least_distance_days
from noticeloom.operators.shares import settled


def within_days(left: DataFrame, right: DataFrame, left_time: str, right_time: str, days: int, keys: list[str]) -> DataFrame:
    """Pairs no more than ``days`` apart (whole days, inclusive) with equal ``keys``, as an equi-join on buckets of ``days``.

    Each left row goes to its bucket and the two beside it; the residual predicate decides. A pure range condition would
    plan a nested loop.
    """
    width = days * 86400
    bucket = F.floor(F.unix_seconds(F.col(left_time).cast("timestamp")) / width)
    a = left.withColumn("_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    b = right.withColumn("_bucket", F.floor(F.unix_seconds(F.col(right_time).cast("timestamp")) / width))
    near = F.abs(F.unix_micros(F.col(left_time).cast("timestamp")) - F.unix_micros(F.col(right_time).cast("timestamp"))) <= F.lit(width * 1_000_000)
    return a.join(b, [*keys, "_bucket"]).where(near).drop("_bucket")


def candidate_pairs(notices: DataFrame) -> DataFrame:
    """``a < b`` of notices that may be related: the same document, the same fingerprint, or near dates of one school.

    ``notices``: ``id, type, classes, town, school_code, document, fingerprint, dates array<timestamp>``. Notices of one
    document or fingerprint meet the least of them, which is enough to connect them. Dates meet within type, class, and
    school code or town, as the relation demands all of these; four equi-joins instead of one with OR.
    """

    def equal(column: str) -> DataFrame:
        x = notices.where(F.col(column).isNotNull()).select("id", column)
        return x.join(x.groupBy(column).agg(F.min("id").alias("a")), column).select("a", F.col("id").alias("b")).where("a < b")

    dated = notices.select("id", "type", F.explode(F.array_distinct("classes")).alias("class"), F.lower("town").alias("town"), "school_code", F.explode("dates").alias("t"))

    def near(place: str) -> DataFrame:
        x, keys = dated.where(F.col(place).isNotNull()).select("id", "type", "class", place, "t"), ["type", "class", place]
        one, two = x.withColumnsRenamed({"id": "a", "t": "ta"}), x.withColumnsRenamed({"id": "b", "t": "tb"})
        return within_days(one, two, "ta", "tb", settings.MERGE_DAYS, keys).where("a < b").select("a", "b")

    return reduce(DataFrame.unionByName, (equal("document"), equal("fingerprint"), near("school_code"), near("town"))).distinct()


def same_school(a_code: Column, b_code: Column, a_town: Column, b_town: Column) -> Column:
    """By code if both have one, else by town."""
    return F.coalesce(F.when(a_code.isNotNull() & b_code.isNotNull(), a_code == b_code).otherwise(F.lower(a_town) == F.lower(b_town)), F.lit(False))


def relation(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """``stesso``, ``possibile-duplicato`` or null for two notices; dicts of ``type, classes, town, school_code, protocol, document, fingerprint, dates``."""
    days = least_distance_days(a["dates"], b["dates"])
    alike = (a["type"] == b["type"]) & same_school(a["school_code"], b["school_code"], a["town"], b["town"]) & F.coalesce(F.arrays_overlap(a["classes"], b["classes"]), F.lit(False))
    both = a["protocol"].isNotNull() & b["protocol"].isNotNull()
    return (
        F.when(F.coalesce((a["document"] == b["document"]) | (a["fingerprint"] == b["fingerprint"]), F.lit(False)), "stesso")
        .when(~F.coalesce(alike, F.lit(False)), None)
        .when(both, F.when((a["protocol"] == b["protocol"]) & (days <= settings.MERGE_DAYS), "stesso"))
        .when(days <= settings.WEAK_DUPLICATE_DAYS, "possibile-duplicato")
    )


FIELDS = ("type", "classes", "town", "school_code", "protocol", "document", "fingerprint", "dates")


def related_pairs(notices: DataFrame) -> DataFrame:
    """``a, b, relation`` of all candidate pairs that are related; of notices of one document those with the least."""
    pairs = candidate_pairs(notices)
    left, right = (notices.select(F.col("id").alias(side), F.struct(*FIELDS).alias(f"_{side}")) for side in "ab")
    joined = pairs.join(left, "a").join(right, "b")
    one, two = ({f: F.col(f"_{side}")[f] for f in FIELDS} for side in "ab")
    return joined.select("a", "b", relation(one, two).alias("relation")).where("relation is not null")


def oldest_equal(pairs: DataFrame) -> DataFrame:
    """``id, same_as``: the oldest notice that each is the same as."""
    return pairs.where("relation = 'stesso'").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("same_as"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id`` and ``a, b`` to ``id, component``: the least id connected with it.

    Each round takes the least label among neighbours and then the label of that label, so that chains halve; labels are
    checkpointed, which cuts the lineage. Ends when no label changes.
    """
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = settled(nodes.select("id", F.col("id").alias("component")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = labels.join(seen, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("now"))
        jumped = least.join(labels.select(F.col("id").alias("now"), F.col("component").alias("far")), "now", "left")
        after = settled(jumped.select("id", F.least("now", F.coalesce("far", "now")).alias("component"), F.col("component").alias("before")))
        changed = not after.where("component <> before").isEmpty()
        labels = after.select("id", "component")
        if not changed:
            return labels


def possible_duplicates(pairs: DataFrame, bridge: DataFrame) -> DataFrame:
    """``a < b`` of related notices that were not merged and that no publication announces both. ``bridge``: ``publication, id``."""
    each = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # only the given pairs are looked up: a publication of many notices would have the square of them
    of_a = each.join(bridge.select("publication", F.col("id").alias("a")), "a")
    together = of_a.join(bridge.select("publication", F.col("id").alias("b")), ["publication", "b"], "left_semi").select("a", "b").distinct()
    return each.join(together, ["a", "b"], "left_anti")
