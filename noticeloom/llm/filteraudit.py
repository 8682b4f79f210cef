"""How filters of documents interact: what each removes in every order, alone, and after the others.

Words are counted by the sparse document-term matrix of :mod:`noticeloom.llm.termmatrix`: row sums and nonzero counts
decide the first two of five filters, and the other three are attached to the rows:

* A: under ``LEAST_WORDS`` words
* B: 100 times the different words are less than 50 times the words
* C: 100 times the characters ``[A-Z]`` are more than 3 times the code points
* D: holds one of ``[#$%&*|]``
* E: the text of a document of a smaller ``doc_id``, kept or not (equal by SHA-256)

Documents are counted by part, set of failed filters and labels; everything that any order of filters does follows from
these counts, which are at most 128 for a part.

Defined results: a null text counts as empty (it fails A; with another empty one of a smaller id also E); a null ``doc_id``
never fails E, makes no other document fail it, and has no label; rows that repeat an id and a text don't make each other
fail E; where an id has several labels, one that says 1 is enough; a null ``lang`` is the part of the empty string; an empty
table gives an empty result; very long texts count whole; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import Scratch, table, text_or_empty, utf8
from noticeloom.llm.termmatrix import local_shards, row_sums

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: As long as its filters come in every order: 5! orders.
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def failed_filters(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, part, failed``: for each document the filters that it fails, as bits (A is 1)."""
    text = text_or_empty("text")
    carried = F.struct(
        F.col("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(utf8(text), 256)).alias("digest"),
        (100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text)).alias("C"),
        text.rlike(r"[#$%&*|]").alias("D"),
    )
    rows = row_sums(local_shards(docs, carried, scratch))
    rows = scratch.written(
        rows.select("row.*", (F.col("total") < LEAST_WORDS).alias("A"), (100 * F.col("nonzero") < 50 * F.col("total")).alias("B")), "rows"
    )
    scratch.drop("shards")
    repeated = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # written, so that both sides of the join are plain shuffles, and Spark can split a digest that many rows have
    repeated = scratch.written(repeated.select("digest", "first"), "repeated")
    rows = rows.join(repeated, "digest", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    bits = (F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(FILTERS))
    return rows.select("doc_id", "part", reduce(Column.__add__, bits).alias("failed"))


def audited(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, part, failed`` and ``doc_id, quality, toxic`` to what each filter does in each order of them; see the module."""
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")))
    kinds = failed.join(said, "doc_id", "left").select("part", "failed", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")))
    kinds = kinds.groupBy("part", "failed", "quality", "toxic").agg(F.count("*").alias("n"))
    steps = [
        F.struct(F.lit(o).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(1 << FILTERS.index(f)).alias("bit"), F.lit(sum(1 << FILTERS.index(x) for x in o[:k])).alias("earlier"))
        for o in ORDERS
        for k, f in enumerate(o)
    ]
    each = kinds.select("*", F.explode(F.array(*steps)).alias("s")).select("part", "failed", "quality", "toxic", "n", "s.*")
    fails, gone = F.col("failed").bitwiseAND(F.col("bit")) > 0, F.col("failed").bitwiseAND(F.col("earlier")) > 0
    removed = fails & ~gone

    def total(condition: Column, of: Column = F.col("n")) -> Column:
        return F.sum(F.when(condition, of).otherwise(0)).cast("long")

    # of the orders, an equal share has each filter that a document fails first among these
    share = F.col("n") * F.lit(len(ORDERS)).cast("long") / F.bit_count("failed")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(removed).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"),
        total(removed & F.col("quality")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
        total(fails, F.floor(share)).alias("shapley"),
    )


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "audit")
    failed = failed_filters(table(spark, sf_dir, "documents"), scratch)
    return audited(failed, table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (
  SELECT doc_id, part,
    (len(words) < 200)::INT AS a,
    (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b,
    (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT AS c,
    regexp_matches(text, '[#$%&*|]')::INT AS d,
    coalesce(doc_id > first, false)::INT AS e
  FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a + b + c + d + e AS n, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM c p JOIN c q ON q.x <> p.x JOIN c r ON r.x NOT IN (p.x, q.x) JOIN c s ON s.x NOT IN (p.x, q.x, r.x) JOIN c t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
s AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM o),
x AS (
  SELECT part, filter_order, step, m.n, good, toxic, fails[substr(filter_order, step, 1)] = 1 AS here,
    len(list_filter(range(1, step), lambda k: fails[substr(filter_order, k, 1)] = 1)) > 0 AS gone
  FROM m, s)
SELECT part, filter_order, step,
  count(*) FILTER (WHERE NOT here AND NOT gone) AS kept,
  count(*) FILTER (WHERE here AND NOT gone) AS removed,
  count(*) FILTER (WHERE here AND gone) AS redundant,
  count(*) FILTER (WHERE here AND n = 1) AS unique_fails,
  count(*) FILTER (WHERE here AND NOT gone AND good) AS good_lost,
  count(*) FILTER (WHERE here AND NOT gone AND toxic) AS toxic_lost,
  (sum(sum(CASE WHEN here AND NOT gone THEN 1 ELSE 0 END)) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley
FROM x GROUP BY part, filter_order, step
"""
