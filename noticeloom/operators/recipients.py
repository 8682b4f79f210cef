"""Changes to recipients, each a new state of the tables: ``recipient, preference`` and what depends on them.

Requests are tables too, so that one change and a million are the same job. Requests with problems are left out of the
result and come back as rows of :func:`problems`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import codes
from noticeloom.functions import patterns as P
from noticeloom.operators.digest import preference_problems
from noticeloom.operators.upserts import without_children


def normal_preferences(wanted: DataFrame) -> DataFrame:
    """``recipient, kind, value`` in normal spelling, without blanks and repeats."""
    v = F.col("value")
    spelled = F.when(F.col("kind") == "classe", codes.class_code(v)).when(F.col("kind") == "provincia", codes.province_code(v)).otherwise(F.trim(v))
    return wanted.select("recipient", "kind", spelled.alias("value")).where("value <> ''").distinct()


def by_email(recipients: DataFrame, emails: DataFrame) -> DataFrame:
    """The recipients of some addresses, whatever their case. ``emails``: ``email``."""
    asked = emails.select(codes.email(F.col("email")).alias("_e")).distinct()
    return recipients.withColumn("_e", codes.email(F.col("email"))).join(asked, "_e").drop("_e")


def taken(recipients: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (``recipient, email``) whose address another recipient has; a recipient may keep its own."""
    own = recipients.select(codes.email(F.col("email")).alias("_e"), F.col("recipient").alias("_owner"))
    asked = requests.withColumn("_e", codes.email(F.col("email")))
    return asked.join(own, "_e").where(~F.col("recipient").eqNullSafe(F.col("_owner"))).select("recipient", "email")


def problems(recipients: DataFrame, requests: DataFrame, wanted: DataFrame, classes: DataFrame, groups: DataFrame, provinces: DataFrame) -> DataFrame:
    """``recipient, problem`` of requests to add or change: address and preferences, everything at once."""
    shape = requests.where(F.col("email").isNotNull() & ~codes.email(F.col("email")).rlike(P.EMAIL_SHAPE)).select("recipient", F.lit("indirizzo non valido").alias("problem"))
    known = taken(recipients, requests).select("recipient", F.lit("indirizzo già presente").alias("problem"))
    return shape.unionByName(known).unionByName(preference_problems(wanted, classes, groups, provinces)).distinct()


def added(recipients: DataFrame, requests: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    good = requests.join(found.select("recipient"), "recipient", "left_anti")
    new = good.select("recipient", codes.email(F.col("email")).alias("email"), F.lit(True).alias("active"), now.alias("created"), F.lit(None).cast("timestamp").alias("deactivated"), F.coalesce("split", F.lit(False)).alias("split"))
    return recipients.unionByName(new.select(recipients.columns))


def modified(recipients: DataFrame, requests: DataFrame, found: DataFrame) -> DataFrame:
    """Requests have null in what stays."""
    good = requests.join(found.select("recipient"), "recipient", "left_anti").select("recipient", codes.email(F.col("email")).alias("_email"), F.col("split").alias("_split"))
    j = recipients.join(good, "recipient", "left")
    return j.withColumn("email", F.coalesce("_email", "email")).withColumn("split", F.coalesce("_split", "split")).select(recipients.columns)


def replaced_preferences(preferences: DataFrame, wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Kinds that a request names are replaced as a whole; others stay."""
    good = normal_preferences(wanted).join(found.select("recipient"), "recipient", "left_anti")
    return preferences.join(good.select("recipient", "kind").distinct(), ["recipient", "kind"], "left_anti").unionByName(good)


def deactivated(recipients: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """A second time changes nothing."""
    j = recipients.join(gone.select("recipient", F.lit(True).alias("_gone")).distinct(), "recipient", "left")
    hit = F.coalesce(F.col("_gone") & F.col("active"), F.lit(False))
    return j.withColumn("deactivated", F.when(hit, now).otherwise(F.col("deactivated"))).withColumn("active", F.col("active") & ~hit).select(recipients.columns)


def forgotten(digests: DataFrame, ledger: DataFrame, who: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digests of some recipients go, and with them their ledger rows: everything counts as unsent again."""
    lost = digests.join(who.select("recipient").distinct(), "recipient", "left_semi")
    return digests.join(who.select("recipient").distinct(), "recipient", "left_anti"), without_children(lost, ledger, "digest")
