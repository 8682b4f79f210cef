"""The given tables in the shape of the engine's records: orders as notices, suppliers as recipients, events as items of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW, EVENTS_NOW = "1999-06-01 00:00:00", "2024-01-31 12:00:00"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now(text: str = NOW):
    return F.lit(text).cast("timestamp")


def utc(name: str):
    """The tables' timestamps are wall clocks of UTC."""
    return F.col(name).cast("timestamp")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, source, type, staff, classes, province, published, deadline, unreadable, customer``."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.col("o_orderkey")
    published = utc("o_orderdate")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("id"),
        F.col("o_orderstatus").alias("source"),
        F.when(k % 23 == 0, "rettifica").otherwise("interpello").alias("type"),
        F.when(k % 17 == 0, "ata-dsga").otherwise("docente").alias("staff"),
        F.when(k % 97 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderpriority")).alias("classes"),
        F.when(k % 101 != 0, F.col("c_nationkey").cast("string")).alias("province"),
        published.alias("published"),
        F.when(k % 5 != 0, F.timestamp_seconds(F.unix_seconds(published) + (k % 10) * 86400)).alias("deadline"),
        (k % 19 == 0).alias("unreadable"),
        F.col("o_custkey").alias("customer"),
    )


NOTICES_SQL = """
notices AS (SELECT o_orderkey AS id, o_orderstatus AS source, CASE WHEN o_orderkey % 23 = 0 THEN 'rettifica' ELSE 'interpello' END AS type,
  CASE WHEN o_orderkey % 17 = 0 THEN 'ata-dsga' ELSE 'docente' END AS staff, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderpriority END AS class,
  CASE WHEN o_orderkey % 101 <> 0 THEN c_nationkey::VARCHAR END AS province, o_orderdate AS published,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + to_days((o_orderkey % 10)::INT) END AS deadline, o_orderkey % 19 = 0 AS unreadable, o_custkey AS customer
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recipient, classes, provinces, created, first_digest, active, email``."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    names = F.array(*map(F.lit, PRIORITIES))
    created = F.timestamp_seconds(F.unix_seconds(F.lit("1999-01-01 00:00:00").cast("timestamp")) + (k % 100) * 86400)
    return s.select(
        k.alias("recipient"),
        F.array(F.get(names, (k % 5).cast("int")), F.get(names, ((k + 2) % 5).cast("int"))).alias("classes"),
        F.array(F.col("s_nationkey").cast("string"), ((F.col("s_nationkey") + 1) % 25).cast("string")).alias("provinces"),
        created.alias("created"),
        F.when(k % 3 != 0, F.timestamp_seconds(F.unix_seconds(created) + 86400)).alias("first_digest"),
        (k % 10 != 9).alias("active"),
        F.concat(F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("."))), F.lit("@example.org")).alias("email"),
    )


RECIPIENTS_SQL = """
recipients AS (SELECT s_suppkey AS recipient, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][(s_suppkey % 5 + 1)::INT] AS c1,
  ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][((s_suppkey + 2) % 5 + 1)::INT] AS c2, s_nationkey::VARCHAR AS p1, ((s_nationkey + 1) % 25)::VARCHAR AS p2,
  TIMESTAMP '1999-01-01' + to_days((s_suppkey % 100)::INT) AS created,
  CASE WHEN s_suppkey % 3 <> 0 THEN TIMESTAMP '1999-01-02' + to_days((s_suppkey % 100)::INT) END AS first_digest, s_suppkey % 10 <> 9 AS active FROM supplier)"""

DIGEST_SQL = f"""
{NOTICES_SQL}, {RECIPIENTS_SQL},
sent AS (SELECT DISTINCT l_suppkey AS recipient, l_orderkey AS id FROM lineitem),
entries AS (SELECT r.recipient, n.id, n.type, n.province, n.published, n.deadline, n.unreadable, r.p1, r.p2,
    CASE WHEN n.class IS NOT NULL AND n.province IS NOT NULL AND NOT n.unreadable THEN n.class END AS class,
    concat_ws('; ', CASE WHEN n.class IS NULL THEN 'classe di concorso non specificata' END, CASE WHEN n.province IS NULL THEN 'provincia non specificata' END,
      CASE WHEN n.unreadable THEN 'documento non leggibile' END) AS missing
  FROM notices n JOIN recipients r ON (n.class IS NULL OR n.class IN (r.c1, r.c2)) AND (n.province IS NULL OR n.province IN (r.p1, r.p2))
  WHERE n.staff = 'docente' AND r.active
    AND CASE WHEN r.first_digest IS NULL THEN coalesce(n.deadline > TIMESTAMP '1999-06-01', n.published >= TIMESTAMP '1999-05-25')
      ELSE n.published >= r.created - INTERVAL 3 DAY AND coalesce(n.deadline > r.first_digest, n.published >= r.first_digest - INTERVAL 7 DAY) END
    AND NOT EXISTS (SELECT 1 FROM sent s WHERE s.recipient = r.recipient AND s.id = n.id))"""
