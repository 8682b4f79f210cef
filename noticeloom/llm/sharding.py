"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard with the largest score ``-weight / ln(u)``, u in (0, 1) from the MD5 of ``key:shard``. Only
the key and the shards decide; one more shard takes records only into itself, and about its share of the weight.

Slots number the records of a shard without gaps. The records of a shard are first dealt into blocks by a hash of their
key; counts of shards and blocks give each block its first slot, and a window numbers the records inside a block. So no
task holds a whole shard.

Defined results: a null key counts as the string ``null``; rows with the same key share a shard and get different slots
(equal rows are interchangeable); an empty table gives an empty result; texts are only measured, so very long ones are
as good as short ones; further columns pass through unchanged, whatever their names. More ``blocks`` make smaller windows.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import hex_uniform, table, text_or_empty, utf8

#: The 52 bits of 13 hexadecimal digits.
SPAN = float(16**13)


def _name(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    u = (hex_uniform(F.concat(_name(key), F.lit(f":{shard}"))) + F.lit(0.5)) / F.lit(SPAN)
    return F.lit(-float(weight)) / F.ln(u)


def rendezvous_shard(key: Column, weights: Mapping[int, float]) -> Column:
    """The winning shard of each key. ``weights``: shard to weight; shards of weight 0 get nothing."""
    best = F.greatest(*(F.struct(score(key, s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in sorted(weights.items()) if w > 0)) if len([w for w in weights.values() if w > 0]) > 1 else F.struct(F.lit(1.0).alias("score"), F.lit(-next(s for s, w in weights.items() if w > 0)).alias("shard"))
    return (-best["shard"]).cast("int")


def with_shards(df: DataFrame, key: str, weights: Mapping[int, float], grown: Mapping[int, float] | None = None) -> DataFrame:
    """Add ``shard`` and, with ``grown``, ``grown_shard``: where the record goes under those weights."""
    out = df.withColumn("shard", rendezvous_shard(F.col(key), weights))
    return out.withColumn("grown_shard", rendezvous_shard(F.col(key), grown)) if grown else out


def with_slots(df: DataFrame, key: str, order: list[Column], blocks: int = 512) -> DataFrame:
    """Add ``slot`` to rows that have ``shard``: 0, 1, ... in each shard, by block and then by ``order``.

    The table of counts has at most shards x blocks rows; that bounds what the join sends around.
    """
    own = iter(f"_slots{i}" for i in count() if f"_slots{i}" not in df.columns)
    block, n, first, rank = (next(own) for _ in range(4))
    placed = df.withColumn(block, hex_uniform(F.concat(F.lit("block:"), _name(F.col(key))), 7) % blocks)
    counts = placed.groupBy("shard", block).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", block, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    inside = Window.partitionBy("shard", block).orderBy(*order)
    return (
        placed.withColumn(rank, F.row_number().over(inside))
        .join(F.broadcast(firsts), ["shard", block])
        .withColumn("slot", F.col(first) + F.col(rank) - 1)
        .drop(first, rank, block)
    )


SHARDS = 24


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = utf8(text_or_empty("text"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")
    )
    even = {s: 1.0 for s in range(SHARDS)}
    placed = with_shards(docs, "doc_id", even, even | {SHARDS: 1.0})
    slots = with_slots(placed, "doc_id", [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: DuckDB has no CRC-32: its table of 256 values comes from the rule, and a list reduction runs over the bytes.
SQL = """
WITH RECURSIVE b AS (SELECT unnest(range(256))::BIGINT AS n),
t(n, c, k) AS (SELECT n, n, 0 FROM b UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS l FROM t WHERE k = 8),
u AS (
  SELECT d.doc_id, s.s, ('0x' || substr(md5(d.doc_id || ':' || s.s), 1, 13))::BIGINT AS u
  FROM documents d, (SELECT unnest(range(25)) AS s) s),
w AS (SELECT doc_id, arg_max(s, u) FILTER (WHERE s < 24) AS shard, arg_max(s, u) AS grown FROM u GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(strlen(text), 0) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents)
SELECT x.doc_id, (x.n + 8)::BIGINT AS size, 'key' AS law, w.shard::INTEGER AS shard, w.grown::INTEGER AS grown_shard,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(x.n), lambda i: ('0x' || substr(x.h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, crc.l[(xor(c, y) & 255) + 1])))::BIGINT AS text_crc32,
  row_number() OVER (PARTITION BY w.shard ORDER BY ('0x' || substr(md5('block:' || x.doc_id), 1, 7))::BIGINT % 512, x.doc_id) - 1 AS slot
FROM x JOIN w USING (doc_id), crc
"""
