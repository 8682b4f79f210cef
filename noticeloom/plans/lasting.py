"""Queries of what outlives a run: the identity of notices, documents, versions, deliveries and state, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.operators import linking, upserts
from noticeloom.operators.shares import shared_folder
from noticeloom.plans import job
from noticeloom.plans.registry import query
from noticeloom.plans.tables import table, utc
from noticeloom.streaming import health

# --- linking -------------------------------------------------------------------------------------------------------

#: Orders as records of notices: a fourth is stored, the others arrive; some of these are stored ones that changed.
RECORDS_SQL = """
records AS (
  SELECT o_orderkey AS k, o_orderkey // 4 AS publication, CASE WHEN o_orderkey % 23 = 0 THEN 'rettifica' ELSE 'interpello' END AS type,
    o_orderpriority AS c1, CASE WHEN o_orderkey % 7 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS c2, CASE WHEN o_orderkey % 13 <> 0 THEN c_nationkey END AS town,
    CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 50 END AS school_code, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 4 END AS protocol,
    CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey // 90 END AS document, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey // 220 END AS fingerprint, o_orderdate AS date,
    o_orderkey % 4 = 0 AS stored,
    CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 29 = 0 THEN '' ELSE 'r' END || lpad(o_orderkey::VARCHAR, 12, '0') AS rank
  FROM orders JOIN customer ON o_custkey = c_custkey),
alike AS (
  SELECT x.rank AS x, y.rank AS y FROM records x JOIN records y USING (document) UNION
  SELECT x.rank, y.rank FROM records x JOIN records y USING (fingerprint) UNION
  SELECT x.rank, y.rank FROM records x JOIN records y ON x.protocol = y.protocol AND x.type = y.type AND (x.c1 IN (y.c1, y.c2) OR x.c2 IN (y.c1, y.c2))
    AND coalesce(CASE WHEN x.school_code IS NOT NULL AND y.school_code IS NOT NULL THEN x.school_code = y.school_code ELSE x.town = y.town END, false)
    AND x.date BETWEEN y.date - INTERVAL 7 DAY AND y.date + INTERVAL 7 DAY),
same AS MATERIALIZED (
  SELECT x.rank, y.rank AS notice, x.publication = y.publication AND y.stored AS announced
  FROM alike JOIN records x ON alike.x = x.rank JOIN records y ON alike.y = y.rank WHERE NOT x.stored AND (y.stored OR y.rank < x.rank))"""

#: One arrival after the other, with all that was made and announced so far in two lists.
SEQUENCE_SQL = f"""WITH RECURSIVE {RECORDS_SQL},
choices AS (SELECT rank, list(notice ORDER BY notice) AS notices FROM same WHERE NOT announced GROUP BY rank),
involved AS (SELECT rank FROM choices UNION SELECT notice FROM same),
turns AS MATERIALIZED (SELECT row_number() OVER (ORDER BY rank) AS n, r.rank, r.publication, coalesce(c.notices, []) AS notices
  FROM records r LEFT JOIN choices c USING (rank) WHERE NOT r.stored AND r.rank IN (SELECT rank FROM involved)),
stored AS (SELECT list(rank) AS made FROM records WHERE stored AND rank IN (SELECT notice FROM same)),
run(n, rank, notice, made, announced) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, made, []::VARCHAR[] FROM stored
  UNION ALL
  SELECT n, rank, notice, CASE WHEN notice = rank THEN list_append(made, rank) ELSE made END, list_append(announced, publication || '|' || notice)
  FROM (SELECT t.n, t.rank, t.publication, r.made, r.announced,
      coalesce(list_filter(t.notices, lambda c: list_contains(r.made, c) AND NOT list_contains(r.announced, t.publication || '|' || c))[1], t.rank) AS notice
    FROM run r JOIN turns t ON t.n = r.n + 1))
SELECT r.rank, r.publication, coalesce(x.notice, r.rank) AS notice FROM records r LEFT JOIN (SELECT rank, notice FROM run WHERE n > 0) x USING (rank) WHERE NOT r.stored"""


def records(spark, sf_dir):
    k, o, c = F.col("o_orderkey"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    text = "string"
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        k.cast("long").alias("k"),
        F.floor(k / 4).cast("long").alias("publication"),
        F.when(k % 23 == 0, "rettifica").otherwise("interpello").alias("type"),
        F.array("o_orderpriority", F.when(k % 7 == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))).alias("classes"),
        F.when(k % 13 != 0, F.col("c_nationkey").cast(text)).alias("town"),
        F.when(k % 5 == 0, (F.col("o_custkey") % 50).cast(text)).alias("school_code"),
        F.when(k % 3 != 0, (F.col("o_custkey") % 4).cast(text)).alias("protocol"),
        F.when(k % 9 == 0, F.floor(k / 90).cast(text)).alias("document"),
        F.when(k % 11 == 0, F.floor(k / 220).cast(text)).alias("fingerprint"),
        F.array(utc("o_orderdate")).alias("dates"),
        F.concat(F.when((k % 4 == 0) | (k % 29 == 0), "").otherwise("r"), F.lpad(k.cast(text), 12, "0")).alias("rank"),
        F.when((k % 4 != 0) & (k % 29 == 0), k.cast("long")).alias("own"),
    )


@query(SEQUENCE_SQL)
def q_linked_arrivals(spark, sf_dir):
    """The rank of the notice that each arrival is linked to."""
    every = records(spark, sf_dir)
    stored = every.where("k % 4 = 0").withColumnsRenamed({"k": "id", "rank": "order"})
    links = linking.linked(every.where("k % 4 <> 0"), stored, stored.select("publication", "id"))
    names = stored.select("id", F.col("order").alias("notice")).unionByName(links.where("made").select("id", F.col("rank").alias("notice")))
    return links.join(names, "id").select("rank", "publication", "notice")


# --- documents of publications and versions ------------------------------------------------------------------------

#: Lines of orders as document links: stored with one place and hash, listed with another, some read again.
LINKS_SQL = """
l AS (SELECT l_orderkey AS publication, 'u' || l_linenumber AS url, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2, 3),
stored AS (SELECT publication, url, n AS place, s AS hash FROM l WHERE p % 5 <> 0),
listed AS (SELECT publication, url, n + CASE WHEN publication % 3 = 0 THEN 1 ELSE 0 END AS place FROM l WHERE p % 7 <> 0),
fetched AS (SELECT publication, url, CASE WHEN p % 2 = 0 THEN s + 1 ELSE s END AS hash FROM l WHERE p % 5 = 0 AND p % 3 <> 0 OR p % 11 = 0)"""


def links(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    every = i.select(F.col("l_orderkey").cast("long").alias("publication"), F.concat(F.lit("u"), "l_linenumber").alias("url"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    error = F.lit(None).cast("string").alias("error")
    stored = every.where("p % 5 <> 0").select("publication", "url", F.col("n").alias("place"), F.col("s").cast("string").alias("hash"), error)
    listed = every.where("p % 7 <> 0").select("publication", "url", (F.col("n") + F.when(F.col("publication") % 3 == 0, 1).otherwise(0)).alias("place"))
    fetched = every.where("p % 5 = 0 and p % 3 <> 0 or p % 11 = 0").select("publication", "url", F.lit(None).cast("int").alias("place"), F.when(F.col("p") % 2 == 0, F.col("s") + 1).otherwise(F.col("s")).cast("string").alias("hash"), error)
    return stored, listed, fetched


CHANGES_SQL = f"""WITH {LINKS_SQL},
x AS (SELECT publication, url, l.place, s.place AS was, s.hash AS old, f.hash AS new FROM (stored s FULL JOIN fetched f USING (publication, url)) FULL JOIN listed l USING (publication, url)),
c AS (SELECT *, CASE WHEN place IS NULL THEN CASE WHEN was IS NOT NULL THEN 'delete' END WHEN was IS NULL THEN CASE WHEN new IS NOT NULL THEN 'insert' END
  WHEN new IS NOT NULL AND new <> old THEN 'update' WHEN place <> was THEN 'move' ELSE 'keep' END AS change FROM x)"""


@query(f"{CHANGES_SQL} SELECT publication, url, place::INTEGER AS place, change FROM c WHERE change IS NOT NULL")
def q_link_changes(spark, sf_dir):
    return upserts.link_changes(*links(spark, sf_dir))


@query(f"{CHANGES_SQL} SELECT publication, url, place::INTEGER AS place, CASE WHEN change IN ('insert', 'update') THEN new ELSE old END::VARCHAR AS hash FROM c WHERE change <> 'delete'")
def q_reconciled_links(spark, sf_dir):
    stored, listed, fetched = links(spark, sf_dir)
    return upserts.reconciled(stored, fetched, upserts.link_changes(stored, listed, fetched)).drop("error")


#: Orders as publications with their lines as documents; a part was extracted from other headings, other texts, in another order, or by older rules.
@query("""WITH d AS (SELECT o_orderkey AS publication, o_orderkey % 5 AS k, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT publication FROM d WHERE k IN (0, 3) OR k IN (1, 2) AND n > 0""")
def q_stale_extractions(spark, sf_dir):
    k = F.col("publication") % 5
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("publication"), F.col("l_linenumber").alias("place"), F.concat(F.lit("u"), "l_linenumber").alias("url"), F.col("l_suppkey").cast("string").alias("hash"), F.lit(None).cast("string").alias("error"), F.col("l_returnflag").alias("text"), F.lit("").alias("following"))
    pubs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("publication"), F.col("o_orderpriority").alias("heading"), utc("o_orderdate").alias("published"), F.array(F.struct(F.lit("u").alias("url"), F.lit("l").alias("label"))).alias("documents"))
    before = pubs.withColumn("heading", F.when(k == 0, "another").otherwise(F.col("heading")))
    read = lines.withColumn("text", F.when(k == 1, "another").otherwise(F.col("text"))).withColumn("place", F.when(k == 2, -F.col("place")).otherwise(F.col("place")))
    known = job.extraction_digests(before.where(k != 3), read).unionByName(job.extraction_digests(before.where(k == 3), read, "older"))
    return job.extraction_digests(pubs, lines).join(known, ["publication", "digest"], "left_anti").select("publication")


# --- sources as streams --------------------------------------------------------------------------------------------

#: Users' events as items of sources: every third stopped ten days ago, every fourth has few items with classes. Time has come as far as the last event.
@query("""WITH e AS (SELECT user_id, event_id, ts - CASE WHEN user_id % 3 = 0 THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END AS ts, value > CASE WHEN user_id % 4 = 1 THEN 80 ELSE 20 END AS flag FROM events),
i AS (SELECT user_id AS source, ts, flag, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM e),
s AS (SELECT source, max(ts) AS last, count(*) FILTER (WHERE k <= 20) AS n, count(*) FILTER (WHERE k <= 20 AND flag) AS c FROM i GROUP BY 1)
SELECT source::VARCHAR AS source, problem FROM (SELECT source, CASE WHEN (SELECT max(ts) FROM e) - last >= INTERVAL 7 DAY THEN 'silenzio' WHEN n >= 10 AND c < 0.5 * n THEN 'formato' END AS problem FROM s)
WHERE problem IS NOT NULL""")
def q_source_health(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[t]")  # a pattern may name a file as well as a folder
    items = stream.select(F.col("user_id").cast("string").alias("source"), F.col("event_id").cast("long").alias("id"), (utc("ts") - F.when(F.col("user_id") % 3 == 0, F.expr("INTERVAL 10 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))).alias("published"), (F.col("value") > F.when(F.col("user_id") % 4 == 1, 80).otherwise(20)).alias("has_classes"))
    return health.current(health.followed(spark, items, shared_folder(spark, "health")))
