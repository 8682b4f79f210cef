"""Registered queries of extraction, recipients, configuration and whole messages, and their SQL.

Headings and letters are written from the numbers of orders; the SQL works the expected records out from these numbers, not
from the texts, so that it shares no pattern with the operators.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.functions import text, times
from noticeloom.functions.places import Gazetteer
from noticeloom.operators import digest, extraction, monitoring, recipients, rendering, shown
from noticeloom.plans import job
from noticeloom.plans.catalogue import RANKS_SQL, RELATED_SQL, SIZES_SQL, digest_inputs, related
from noticeloom.plans.registry import ORACLE_SQL, QUERIES, query
from noticeloom.plans.tables import DIGEST_SQL, now, table, utc
from noticeloom.sources import configuration

TOWNS = (("Lecce", "Lecce", "LE"), ("Ostuni", "Brindisi", "BR"), ("San Severo", "Foggia", "FG"), ("Bitonto", "Bari", "BA"))
KINDS = ("Interpello", "Annullamento interpello", "Rettifica interpello", "Riapertura dei termini interpello", "Esito interpello")
POSTS = ("A-11", "A022", "B - 17", "AM12", "sostegno scuola secondaria di II grado", "posto comune scuola primaria")
SCHOOLS = ('I.C. "Rossi"', "Liceo Statale Fermi", "I.I.S. Moro")


def pick(values, k: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))


def gazetteer(spark: SparkSession, sf_dir: str) -> Gazetteer:
    k = F.col("n_nationkey")
    town = table(spark, sf_dir, "nation").where(k < len(TOWNS)).select(*(pick([t[i] for t in TOWNS], k).alias(n) for i, n in enumerate(("italian", "province_name", "province"))))
    return Gazetteer(town.withColumn("names", F.col("italian")))


def until_text(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


# --- records from headings and letters -----------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders)
SELECT k AS id, ['interpello', 'annullamento', 'rettifica', 'riapertura', 'esito'][k % 5 + 1] AS type, CASE WHEN k % 17 = 0 THEN 'ata-dsga' ELSE 'docente' END AS staff,
  ['A011', 'A022', 'B017', 'AM12', 'ADSS', 'EEEE'][k % 6 + 1] AS classes, ['Lecce', 'Ostuni', 'San Severo', 'Bitonto'][k % 4 + 1] AS town, ['LE', 'BR', 'FG', 'BA'][k % 4 + 1] AS province,
  ['sigla', 'comune', 'nome-iniziale'][k // 4 % 3 + 1] AS province_from, ['I.C. "Rossi"', 'Liceo Statale Fermi', 'I.I.S. Moro'][k % 3 + 1] AS school,
  CASE WHEN k % 3 = 0 THEN '9' || k WHEN k % 5 = 0 AND k % 7 <> 0 THEN '00' || k || '/2026' END AS protocol, CASE WHEN k % 3 = 0 THEN '03/02/2026' END AS protocol_date,
  CASE WHEN k % 5 <> 0 AND k % 7 <> 0 THEN '00' || k || '/2026' END AS referred_protocol, (1 + k % 18)::INT AS hours, CASE WHEN k % 2 = 0 THEN '30/06/2026' END AS until,
  CASE WHEN k % 11 <> 0 THEN strftime(timezone('UTC', timezone('Europe/Rome', (d + (k % 40)::INT)::TIMESTAMP + INTERVAL '9 hours 30 minutes')), '%Y-%m-%d %H:%M') END AS deadline FROM o""")
def q_heading_record(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    form, none = (k / 4).cast("long") % 3, F.lit("")
    town, name, code = (pick([t[i] for t in TOWNS], k) for i in range(3))
    heading = F.concat(
        F.when(form == 2, F.concat(name, F.lit(" - "))).otherwise(none), pick(KINDS, k), F.when(k % 17 == 0, " DSGA").otherwise(none), F.lit(" "), pick(POSTS, k), F.lit(", "), pick(SCHOOLS, k),
        F.lit(", "), town, F.when(form == 0, F.concat(F.lit(" ("), code, F.lit(")"))).otherwise(none), F.lit(" per "), (1 + k % 18).cast("string"), F.lit(" ore"),
        F.when(k % 7 != 0, F.concat(F.lit(" prot. n. 00"), k, F.lit("/2026"))).otherwise(none),
        F.when(k % 11 != 0, F.concat(F.lit(" entro le ore 9:30 del "), until_text(F.date_add(F.to_date("o_orderdate"), (k % 40).cast("int"))))).otherwise(none),
        F.when(k % 2 == 0, " fino al 30/06/2026").otherwise(none),
    )
    label = F.when(k % 3 == 0, F.concat(F.lit("Decreto prot. 9"), k, F.lit(" del 03/02/2026"))).otherwise("Allegato")
    read = extraction.heading_record(o.select(k.alias("id"), heading.alias("heading"), F.array(label).alias("labels"), utc("o_orderdate").alias("published")), gazetteer(spark, sf_dir))
    fields = ("type", "staff", "town", "province", "province_from", "school", "protocol", "protocol_date", "referred_protocol", "hours", "until")
    return read.select("id", F.array_join("head.classes", ",").alias("classes"), F.date_format("head.deadline", "yyyy-MM-dd HH:mm").alias("deadline"), *(F.col(f"head.{f}").alias(f) for f in fields))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders)
SELECT k AS id, 'Interpello per supplenza classe ' || ['A-11', 'A022', 'B - 17', 'AM12'][k % 4 + 1] || ' presso la sede di zona' AS subject, ['A011', 'A022', 'B017', 'AM12'][k % 4 + 1] AS classes,
  'Istituto Comprensivo Fermi' AS school, ['Lecce', 'Ostuni', 'San Severo', 'Bitonto'][k % 4 + 1] AS town, ['LE', 'BR', 'FG', 'BA'][k % 4 + 1] AS province,
  CASE WHEN k % 2 = 0 THEN ['LE', 'BR', 'FG', 'BA'][k % 4 + 1] || 'IC8000' || k % 10 || 'X' END AS school_code,
  CASE WHEN k % 2 = 0 THEN 'documento-codice-meccanografico' ELSE 'documento-comune' END AS province_from, k::VARCHAR AS protocol, '02/03/2026' AS protocol_date, k % 5 <> 0 AS is_notice,
  strftime(timezone('UTC', timezone('Europe/Rome', (d + (k % 40)::INT)::TIMESTAMP + CASE WHEN k % 6 = 0 THEN INTERVAL '23 hours 59 minutes 59 seconds' ELSE INTERVAL '10 hours 15 minutes' END)), '%Y-%m-%d %H:%M:%S') AS deadline FROM o""")
def q_document_record(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    town, code = (pick([t[i] for t in TOWNS], k) for i in (0, 2))
    day = until_text(F.date_add(F.to_date("o_orderdate"), (k % 40).cast("int")))
    lines = F.array(
        F.lit("MINISTERO DELL'ISTRUZIONE"), F.lit("Istituto Comprensivo Fermi"), F.concat(F.lit("Via Roma 1 - 7"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(" "), town, F.lit(" - Tel. 080 1")),
        F.when(k % 2 == 0, F.concat(F.lit("e-mail: "), F.lower(code), F.lit("ic8000"), k % 10, F.lit("x@istruzione.it"))).otherwise("sito web"),
        F.concat(F.lit("Prot. n. 000"), k, F.lit(" del 02/03/2026")), F.lit(""), F.lit("Al personale"), F.lit(""), F.concat(F.lit("OGGETTO: Interpello per supplenza classe "), pick(POSTS[:4], k)),
        F.lit("presso la sede di zona"), F.lit("IL DIRIGENTE"), F.lit("VISTO il decreto prot. n. 77"),
        F.concat(F.lit("domande "), F.when(k % 6 == 0, F.concat(F.lit("entro il "), day)).otherwise(F.concat(F.lit("entro e non oltre le ore 10,15 del "), day))),
    )
    none = F.lit(None).cast("string")
    letters = o.select(k.alias("id"), F.array_join(lines, "\n").alias("text"), none.alias("region"), none.alias("following"), utc("o_orderdate").alias("published"), F.when(k % 5 == 0, "modello.pdf").otherwise("avviso.pdf").alias("name"))
    read = extraction.document_record(letters, gazetteer(spark, sf_dir))
    fields = ("subject", "school", "town", "province", "school_code", "province_from", "protocol", "protocol_date")
    return read.select(
        "id", F.array_join("doc.classes", ",").alias("classes"), *(F.col(f"doc.{f}").alias(f) for f in fields), extraction.is_notice(F.col("doc.subject"), F.col("name")).alias("is_notice"),
        F.date_format("doc.deadline", "yyyy-MM-dd HH:mm:ss").alias("deadline"),
    )


@query("""WITH l AS (SELECT l_orderkey AS p, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS place, (l_suppkey % 3)::VARCHAR AS hash, CASE WHEN l_partkey % 2 = 0 THEN 'Rossi' ELSE 'rossi' END AS school, l_returnflag AS subject, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey::VARCHAR END AS protocol FROM lineitem),
o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY p, hash ORDER BY place) = 1)
SELECT p AS publication, min(place) AS place, coalesce(arg_min(protocol, place) FILTER (WHERE protocol IS NOT NULL), NULL) AS protocol FROM o GROUP BY p, lower(school), subject""")
def q_one_per_subject(spark, sf_dir):
    """Lines of orders as documents of a publication; the subject is the return flag, and the school is written in two ways."""
    n = F.col("l_linenumber")
    number = F.when(n % 2 == 0, F.col("l_partkey").cast("string"))
    doc = F.struct(F.when(F.col("l_partkey") % 2 == 0, "Rossi").otherwise("rossi").alias("school"), F.col("l_returnflag").alias("subject"), number.alias("protocol"), F.lit(None).cast("string").alias("protocol_date"))
    docs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("publication"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + n).alias("place"), (F.col("l_suppkey") % 3).cast("string").alias("hash"), doc.alias("doc"))
    return extraction.one_per_subject(docs).select("publication", "place", F.col("doc.protocol").alias("protocol"))


# --- recipients ----------------------------------------------------------------------------------------------------


def even_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    mail = F.concat(F.lit("s"), k, F.lit("@example.org"))
    return table(spark, sf_dir, "supplier").where(k % 2 == 0).select(k.alias("recipient"), mail.alias("email"), (k % 8 != 0).alias("active"), now().alias("created"), F.when(k % 8 == 0, now()).alias("deactivated"), F.lit(False).alias("split"))


@query("""SELECT s_suppkey AS recipient, 's' || s_suppkey || '@example.org' AS email, s_suppkey % 8 <> 0 AND s_suppkey % 10 <> 4 AS active, s_suppkey % 6 = 0 AS split FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 's' || s_suppkey || '@example.org', true, false FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 9 <> 0 AND NOT (s_suppkey % 15 = 1 AND s_suppkey > 1)""")
def q_recipient_changes(spark, sf_dir):
    """Odd suppliers ask to be added, some with a bad address or one that is taken; some even ones change and some are deactivated."""
    people, k = even_recipients(spark, sf_dir), F.col("s_suppkey")
    mail = F.when(k % 9 == 0, F.concat(F.lit("no address "), k)).when((k % 15 == 1) & (k > 1), F.concat(F.lit("S"), k - 1, F.lit("@Example.org"))).otherwise(F.concat(F.lit(" S"), k, F.lit("@example.org ")))
    asked = table(spark, sf_dir, "supplier").where(k % 2 == 1).select(k.alias("recipient"), mail.alias("email"), F.lit(None).cast("boolean").alias("split"))
    nothing, none = spark.createDataFrame([], "recipient long, kind string, value string"), spark.createDataFrame([], "value string")
    after = recipients.added(people, asked, recipients.problems(people, asked, nothing, none, none, none), now())
    changes = people.where("recipient % 6 = 0").select("recipient", F.lit(None).cast("string").alias("email"), F.lit(True).alias("split"))
    after = recipients.modified(after, changes, recipients.problems(after, changes, nothing, none, none, none))
    return recipients.deactivated(after, people.where("recipient % 10 = 4").select("recipient"), now()).select("recipient", "email", "active", "split")


@query("""SELECT s_suppkey AS recipient, 'provincia' AS kind, 'BA' AS value FROM supplier
UNION ALL SELECT s_suppkey, 'classe', CASE WHEN s_suppkey % 3 = 0 THEN 'A01' || s_suppkey % 5 ELSE 'A099' END FROM supplier""")
def q_preference_changes(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    row = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    stored = s.select(k.alias("recipient"), F.explode(F.array(row("classe", F.lit("A099")), row("provincia", F.lit("BA")))).alias("x")).select("recipient", "x.*")
    wanted = s.where(k % 3 == 0).select(k.alias("recipient"), F.explode(F.array(row("classe", F.concat(F.lit(" a-1"), k % 5, F.lit(" "))), row("classe", F.concat(F.lit("A01"), k % 5)), row("gruppo", F.lit(" ")))).alias("x")).select("recipient", "x.*")
    return recipients.replaced_preferences(stored, wanted, wanted.limit(0).select("recipient"))


@query("""SELECT l_orderkey AS digest, l_linenumber::BIGINT AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def q_forgotten(spark, sf_dir):
    """Customers of one nation forget their digests (orders), and so their ledger rows (lines)."""
    digests = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recipient"), F.col("o_orderkey").alias("digest"))
    ledger = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("digest"), F.col("l_linenumber").cast("long").alias("id"))
    return recipients.forgotten(digests, ledger, table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("recipient")))[1]


@query("""SELECT recipient, 's' || recipient || '@example.org' || CASE WHEN recipient % 8 = 0 THEN ' (disattivato)' ELSE '' END || CASE WHEN recipient % 3 = 0 THEN chr(10) || '  Classi: A0' || recipient % 5 || ', B0' || recipient % 5 ELSE '' END
|| chr(10) || '  Province: BA' || CASE WHEN recipient % 6 = 0 THEN chr(10) || '  Un riepilogo per provincia' ELSE '' END AS text FROM (SELECT s_suppkey AS recipient FROM supplier WHERE s_suppkey % 2 = 0)""")
def q_described(spark, sf_dir):
    k, empty = F.col("recipient"), F.array().cast("array<string>")
    people = even_recipients(spark, sf_dir).withColumn("split", k % 6 == 0).withColumn("classe", F.when(k % 3 == 0, F.array(F.concat(F.lit("A0"), k % 5), F.concat(F.lit("B0"), k % 5))).otherwise(empty))
    return rendering.described(people.withColumn("gruppo", empty).withColumn("provincia", F.array(F.lit("BA"))))


@query("SELECT o_custkey AS recipient, strftime(min(o_orderdate), '%Y-%m-%d') AS first_digest, count(*) AS digests FROM orders GROUP BY 1")
def q_first_digest(spark, sf_dir):
    return digest.first_digests(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recipient"), utc("o_orderdate").alias("sent"))).select("recipient", F.date_format("first_digest", "yyyy-MM-dd").alias("first_digest"), "digests")


# --- configuration and small text functions ------------------------------------------------------------------------


@query("""SELECT 'empty group: ' || r_name AS problem FROM region WHERE r_regionkey = 2
UNION ALL SELECT 'unknown class in ' || r_name || ': ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 AND n_nationkey % 4 = 0""")
def q_configuration_problems(spark, sf_dir):
    """Regions as groups of nations; one region is empty, and every fourth nation is no known class."""
    nation = table(spark, sf_dir, "nation")
    members = nation.where("n_regionkey <> 2").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_name").alias("class"))
    groups = table(spark, sf_dir, "region").join(members, "r_regionkey", "left").select(F.col("r_name").alias("name"), "class")
    return configuration.configuration_problems(groups, nation.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("class")))


@query("""WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'Bad Id' || s_suppkey WHEN s_suppkey % 11 = 1 THEN 'twice' ELSE 's-' || s_suppkey END AS id, s_suppkey % 3 AS a FROM supplier)
SELECT id, 'id not valid' AS problem FROM s WHERE k % 5 = 0 UNION ALL SELECT id, 'no name' FROM s WHERE k % 7 = 0 UNION ALL SELECT id, 'unknown adapter' FROM s WHERE a = 2
UNION ALL SELECT id, '"api" must be a web address' FROM s WHERE a = 0 AND k % 2 = 1 UNION ALL SELECT id, '"cerca" must be a text' FROM s WHERE a = 0 AND k % 4 = 0
UNION ALL SELECT id, 'needs "cerca" or "categorie"' FROM s WHERE a = 0 AND k % 4 >= 2 AND k % 6 >= 3 UNION ALL SELECT id, '"perPagina" must be from 1 to 100' FROM s WHERE a = 0 AND (k % 130 = 0 OR k % 130 > 100)
UNION ALL SELECT id, '"pagina" must be a web address' FROM s WHERE a = 1 AND k % 2 = 1 UNION ALL SELECT id, 'id used twice' FROM s GROUP BY id HAVING count(*) > 1""")
def q_source_problems(spark, sf_dir):
    """Suppliers as configured sources, with every kind of mistake."""
    k = F.col("s_suppkey")
    settings = F.struct(
        F.when(k % 2 == 0, "https://x.it/posts").otherwise("ftp://x.it").alias("api"), F.when(k % 4 == 0, "").when(k % 4 == 1, "q").alias("cerca"), F.when(k % 6 < 3, F.array(F.lit(1))).alias("categorie"),
        (k % 130).cast("int").alias("perPagina"), F.when(k % 2 == 0, "https://x.it/pagina").alias("pagina"),
    )
    name = F.when(k % 7 == 0, " ").otherwise(F.col("s_name"))
    id_ = F.when(k % 5 == 0, F.concat(F.lit("Bad Id"), k)).when(k % 11 == 1, "twice").otherwise(F.concat(F.lit("s-"), k))
    return configuration.source_problems(table(spark, sf_dir, "supplier").select(id_.alias("id"), name.alias("nome"), pick(("wordpress", "pagina-decreti", "other"), k).alias("adapter"), settings.alias("impostazioni")))


@query("""SELECT doc_id, regexp_replace(regexp_replace(lower('..' || source || ' ' || doc_id || '@X.it/é'), '[^a-z0-9@._+-]', '_', 'g'), '^\\.+', '_') AS file, 'Errore <destinatario>: ' || doc_id AS said,
  ['application/pdf', 'application/zip', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/octet-stream'][doc_id % 4 + 1] AS type, split_part(coalesce(text, ''), chr(10), 1) AS first,
  CASE WHEN doc_id % 3 = 0 THEN 'html page instead of the content' WHEN doc_id % 3 = 1 THEN 'the body is no PDF' END AS wrong FROM documents""")
def q_text_helpers(spark, sf_dir):
    k = F.col("doc_id")
    mail = F.concat(F.lit("d"), k, F.lit("@example.org"))
    body = F.when(k % 3 == 0, "  <!DOCTYPE HTML><p>").when(k % 3 == 1, "no pdf").otherwise("%PDF-1.4").cast("binary")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.safe_file_name(F.concat(F.lit(".."), "source", F.lit(" "), k, F.lit("@X.it/é"))).alias("file"), text.without_email(F.concat(F.lit("Errore "), mail, F.lit(": "), k), mail).alias("said"),
        text.type_of_name(F.concat(k, pick((".PDF", ".zip", ".docx", ".exe"), k))).alias("type"), text.first_line(F.coalesce("text", F.lit(""))).alias("first"),
        text.inconsistent_body(body, F.lit("application/pdf"), F.lit("https://x.it/a"), F.array(F.lit("application/pdf"))).alias("wrong"),
    )


# --- alerts and messages -------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT s_suppkey AS source, CASE WHEN s_suppkey % 3 = 0 THEN 'errore' END AS problem, CASE WHEN s_suppkey % 3 = 1 THEN true ELSE false END AS recovered,
  CASE WHEN s_suppkey % 8 <> 7 THEN DATE '1999-06-01' - (s_suppkey % 8)::INT END AS last FROM supplier)
SELECT source, CASE WHEN problem IS NOT NULL AND (last IS NULL OR DATE '1999-06-01' - last = 0 OR DATE '1999-06-01' - last >= 3) OR problem IS NULL AND recovered AND (last IS NULL OR last = DATE '1999-06-01') THEN '1999-06-01' ELSE last::VARCHAR END AS last_alert FROM s""")
def q_announced(spark, sf_dir):
    """Which sources are announced today: problems when new and every third day, recoveries once."""
    k, today = F.col("s_suppkey"), F.lit("1999-06-01").cast("date")
    state = table(spark, sf_dir, "supplier").select(
        k.alias("source"), F.when(k % 3 == 0, "errore").alias("problem"), F.when(k % 3 == 1, now()).alias("recovered"), F.when(k % 8 != 7, F.date_sub(today, (k % 8).cast("int"))).alias("last_alert")
    )
    return monitoring.announced(state, today).select("source", F.col("last_alert").cast("string").alias("last_alert"))


FOOT_SQL = "'Generato il 01/06/1999 alle 02:00 · Fonti lette: A, B'"


@query(f"""SELECT s_suppkey AS recipient, 'Interpelli: avviso sulle fonti · 1 giu 1999' AS subject,
'⚠ A & B: ferma' || chr(10) || '✓ C di nuovo disponibile.' || chr(10) || chr(10) || 'Oggi nessun interpello nuovo per le tue preferenze.' || chr(10) || chr(10) || '—' || chr(10) || {FOOT_SQL} || chr(10) AS text,
true AS escaped FROM supplier""")
def q_alert_only_messages(spark, sf_dir):
    alerts = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(said).alias("text")) for kind, said in (("silenzio", "A & B: ferma"), ("ripresa", "C di nuovo disponibile."))))
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("recipient"))
    m = rendering.alert_only(people, F.lit("1999-06-01").cast("date"), now(), F.array(F.lit("A"), F.lit("B")), alerts)
    return m.select("recipient", "subject", "text", (F.col("html").contains("A &amp; B: ferma") & F.col("html").startswith("<!doctype html>")).alias("escaped"))


@query(f"""WITH {DIGEST_SQL}, sized AS (SELECT *, {SIZES_SQL.format(key="recipient")} FROM entries), ranked AS (SELECT *, {RANKS_SQL.format(key="recipient")} FROM sized),
named AS (SELECT r.* EXCLUDE (class), r.class, n.class AS written FROM ranked r JOIN (SELECT id AS nid, class FROM notices) n ON n.nid = r.id),
lines AS (SELECT recipient, section_rank, entry_rank, CASE WHEN entry_rank = 1 THEN '── ' || h || ' ' || repeat('─', greatest(3, 48 - length(h))::INT) || chr(10) || chr(10) ELSE '' END
  || '• ' || CASE WHEN type <> 'interpello' THEN '[' || upper(type) || '] ' ELSE '' END || 'Scuola non indicata' || coalesce(' — provincia di ' || province, '') || chr(10)
  || '  ' || coalesce(written || ' · ', '') || CASE WHEN deadline IS NULL THEN 'scadenza non indicata' ELSE 'scade il ' || strftime(timezone('Europe/Rome', timezone('UTC', deadline)), '%d/%m alle %H:%M') END || chr(10)
  || coalesce('  ⚠ ' || nullif(replace(missing, '; ', chr(10) || '  ⚠ '), '') || chr(10), '')
  || '  Pubblicato ' || strftime(timezone('Europe/Rome', timezone('UTC', published)), '%d/%m') || chr(10) || '  Documento: https://example.org/' || id || chr(10)
  || '  ↳ potrebbe essere lo stesso di: USP, pubblicato ' || strftime(timezone('Europe/Rome', timezone('UTC', published)), '%d/%m') || ' https://example.org/d' || CASE WHEN id % 2 = 0 THEN ' (già inviato)' ELSE '' END || chr(10) AS line
  FROM (SELECT *, coalesce(class || ' · Classe ' || class, 'Da verificare') AS h FROM named))
SELECT recipient, '⚠ A & B: ferma' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY section_rank, entry_rank) || chr(10) || '—' || chr(10) || {FOOT_SQL} || chr(10) AS text FROM lines GROUP BY 1""")
def q_digest_text(spark, sf_dir):
    """Whole text messages, with links and notes on possible duplicates."""
    none = F.lit(None).cast("string")
    link = F.array(F.struct(F.lit("Documento").alias("label"), F.concat(F.lit("https://example.org/"), "id").alias("url")))
    twin = F.array(F.struct(F.lit("USP").alias("source"), F.col("published"), F.lit("https://example.org/d").alias("url"), (F.col("id") % 2 == 0).alias("sent")))
    calls, people, sent, at = digest_inputs(spark, sf_dir)
    full = calls.select("*", none.alias("school"), none.alias("town"), F.lit(None).cast("int").alias("hours"), none.alias("until"), link.alias("links"), twin.alias("duplicates"))
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("class"), F.concat(F.lit("Classe "), "o_orderpriority").alias("name")).distinct()
    alerts = F.array(F.struct(F.lit("silenzio").alias("kind"), F.lit("A & B: ferma").alias("text")))
    return rendering.composed(full, people, sent, F.lit("1999-06-01").cast("date"), at, F.array(F.lit("A"), F.lit("B")), alerts, names, parts=("text",)).select("recipient", "text")


@query("""WITH w AS (SELECT o_orderkey AS id, o_orderdate::TIMESTAMP + to_seconds((o_orderkey * 7919) % 86400) AS t FROM orders)
SELECT id, strftime(timezone('Europe/Rome', timezone('UTC', t)), '%H:%M:%S') = '23:59:59' AS open_ended, day(timezone('Europe/Rome', timezone('UTC', t))) || ' ' || ['gen', 'feb', 'mar', 'apr', 'mag', 'giu', 'lug', 'ago', 'set', 'ott', 'nov', 'dic'][month(timezone('Europe/Rome', timezone('UTC', t)))] || ' ' || year(timezone('Europe/Rome', timezone('UTC', t))) AS day FROM w""")
def q_without_hour(spark, sf_dir):
    t = F.timestamp_seconds(F.unix_seconds(utc("o_orderdate")) + (F.col("o_orderkey") * 7919) % 86400)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), times.without_hour(t).alias("open_ended"), times.long_day(times.rome_day(t)).alias("day"))



# --- what the job does with publications and documents -------------------------------------------------------------

URL_SQL = "'u' || l_partkey || '-' || l_suppkey || '-' || l_linenumber"
DOCUMENTS = "array<struct<url:string,label:string>>"


def attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as documents of publications."""
    url = F.concat(F.lit("u"), "l_partkey", F.lit("-"), "l_suppkey", F.lit("-"), "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("publication"), url.alias("url"), F.col("l_linenumber").alias("place"), F.col("l_suppkey").cast("string").alias("hash"), "l_returnflag")


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as publications; every third has a document."""
    k = F.col("o_orderkey")
    document = F.when(k % 3 == 0, F.array(F.struct(F.concat(F.lit("https://d/"), k).alias("url"), F.lit("x").alias("label")))).otherwise(F.array().cast(DOCUMENTS))
    return table(spark, sf_dir, "orders").select(k.alias("publication"), F.col("o_orderpriority").alias("source"), k.cast("string").alias("key"), F.concat(F.lit("https://x/"), k).alias("url"), F.col("o_orderstatus").alias("heading"), utc("o_orderdate").alias("published"), document.alias("documents"))


@query(f"""SELECT l_orderkey AS publication, {URL_SQL} AS url FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
WHERE l_returnflag = 'N' OR l_linenumber = 7 OR s_suppkey % 7 IN (0, 1) OR s_suppkey % 7 = 2 AND s_suppkey % 2 = 0""")
def q_to_fetch(spark, sf_dir):
    """Linked documents that were never attached (N) or never downloaded (no hash), two kinds of old errors, and texts without following pages; new errors and archives stay."""
    docs, k = attached(spark, sf_dir), F.col("s_suppkey")
    listed = docs.groupBy("publication").agg(F.collect_list(F.struct("url", F.lit("x").alias("label"))).alias("documents"))
    errors = F.when(k % 7 == 0, "formato non ancora letto: rar").when(k % 7 == 1, "PDF senza testo").when(k % 7 == 3, "non leggibile: 7z")
    texts = F.when(k % 7 == 2, "text").when(k % 7 == 4, "text")
    stored = table(spark, sf_dir, "supplier").select(k.cast("string").alias("hash"), errors.alias("error"), texts.alias("text"), F.when((k % 7 == 4) | (k % 2 == 1), "").alias("following"))
    known = docs.where("l_returnflag <> 'N'").select("publication", "url", F.when(F.col("place") != 7, F.col("hash")).alias("hash"))
    return job.to_fetch(job.listed(listed), known, stored).select("publication", "url")


@query(f"""WITH a AS (SELECT l_orderkey AS publication, {URL_SQL} AS url, l_suppkey AS k FROM lineitem)
SELECT publication, url, k::VARCHAR AS hash FROM a WHERE k % 5 <> 0 UNION ALL SELECT publication, url || '#p' || p, 'm' || k || '-' || p FROM a, (SELECT unnest([0, 1]) AS p) WHERE k % 5 = 0 AND NOT (k % 10 = 0 AND p = 1)""")
def q_archive_parts(spark, sf_dir):
    """Every fifth supplier's documents are archives of two parts; of every tenth's one part is lost."""
    k = F.col("s_suppkey")
    part = table(spark, sf_dir, "supplier").where(k % 5 == 0).select(k, F.explode(F.array(F.lit(0), F.lit(1))).alias("place"))
    parts = part.select(k.cast("string").alias("archive"), "place", F.concat(F.lit("p"), "place").alias("name"), F.concat(F.lit("m"), k, F.lit("-"), "place").alias("part"))
    stored = parts.where("not (cast(archive as long) % 10 = 0 and place = 1)").select(F.col("part").alias("hash"))
    return job.with_parts(attached(spark, sf_dir).drop("l_returnflag"), parts, stored).select("publication", "url", "hash")


@query("""SELECT o_orderpriority AS source, count(*) AS read, count(*) FILTER (WHERE o_orderstatus = 'P') AS new, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 300000) AS updated FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1""")
def q_publication_counters(spark, sf_dir):
    """Stored: orders that are not pending; read: those that are not open, dear ones with another heading."""
    every = publications(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("publication"), "o_totalprice"), "publication")
    stored = every.where("heading <> 'P'").withColumn("read", now()).withColumn("updated", now()).select("publication", "source", "key", "url", "heading", "published", "documents", "read", "updated")
    read = every.where("heading <> 'O'").withColumn("heading", F.when(F.col("o_totalprice") > 300000, "changed").otherwise(F.col("heading")))
    # a pending order's heading is no change: it is new
    return job.with_read(stored, read.select("source", "key", "url", "heading", "published", "documents"), dt.datetime(1999, 6, 1))[1]


@query("""WITH b AS (SELECT DISTINCT l_partkey AS id, l_orderkey AS k FROM lineitem),
p AS (SELECT b.id, o_orderkey AS k, o_orderdate AS d, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Urgente' ELSE o_orderpriority END AS s, CASE WHEN o_orderkey % 3 = 0 THEN 'https://d/' || o_orderkey END AS doc FROM b JOIN orders ON o_orderkey = b.k)
SELECT id, coalesce('Documento=' || arg_min(doc, (d, k)) FILTER (WHERE doc IS NOT NULL) || ' ', '') || string_agg('Pagina (' || s || ')=https://x/' || k, ' ' ORDER BY d, k) AS links FROM p GROUP BY 1""")
def q_shown_links(spark, sf_dir):
    """Parts as notices that orders announce: the first document, then the pages in order."""
    bridge = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("publication")).distinct()
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source")).distinct().where("source = '1-URGENT'").withColumn("name", F.lit("Urgente"))
    told = shown.links(shown.publications_in_order(bridge, publications(spark, sf_dir), names))
    return told.select("id", F.array_join(F.transform("links", lambda x: F.concat(x["label"], F.lit("="), x["url"])), " ").alias("links"))


@query(f"""WITH {RELATED_SQL}, sides AS (SELECT a AS id, b AS other FROM related WHERE relation = 'possibile-duplicato' UNION ALL SELECT b, a FROM related WHERE relation = 'possibile-duplicato')
SELECT id, string_agg(other || '@' || CASE WHEN other % 3 = 0 THEN 'https://d/' ELSE 'https://x/' END || other, ' ' ORDER BY other) AS notes FROM sides GROUP BY 1""")
def q_duplicate_notes(spark, sf_dir):
    listed = publications(spark, sf_dir)
    ordered = shown.publications_in_order(listed.select("publication", F.col("publication").alias("id")), listed, spark.createDataFrame([], "source string, name string"))
    told = shown.duplicate_notes(related(spark, sf_dir).where("relation = 'possibile-duplicato'").select("a", "b"), ordered)
    return told.select("id", F.array_join(F.transform("notes", lambda n: F.concat(n["other"], F.lit("@"), n["url"])), " ").alias("notes"))


__all__ = ["ORACLE_SQL", "QUERIES"]
