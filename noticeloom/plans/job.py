"""The daily job over whole tables: collect, link, monitor, compose, deliver, record. ``python -m noticeloom.plans.job --help``.

State is a folder of snapshots (:mod:`noticeloom.plans.state`): a run reads one and makes the next by its manifest alone, written
last, so that a run that breaks changes nothing. Sources are few: each is read by a job of its own, and one that fails is
a row of the outcomes. All else works on whole tables. Only publications whose heading, documents or rules changed are
extracted again, and what is found is linked to the stored notices, whose ids last (:mod:`noticeloom.operators.linking`).

Messages go to an outbox before any is sent: each has a name, its claim. The tasks that made them deliver them, the sink keeps a
receipt by claim, and the ledger is made from what it accepted. If a run breaks in between, the next one finds the outbox that
no snapshot has recorded, asks the sink for its receipts and records these first.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom import schemas, settings
from noticeloom.functions import patterns as P
from noticeloom.functions.places import Gazetteer
from noticeloom.functions.text import fingerprint
from noticeloom.functions.times import rome_day
from noticeloom.operators import digest, extraction, linking, merging, monitoring, rendering, shown, upserts
from noticeloom.operators.shares import settled
from noticeloom.plans.state import State
from noticeloom.sources.sinks import FileSink

HEAD_FIELDS = ["type", "staff", "classes", "school", "school_code", "town", "province", "province_from", "protocol", "protocol_date", "referred_protocol", "hours", "until", "deadline"]


def notices_of(publications: DataFrame, documents: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """One notice for each notice document of a publication (by school and subject), else one from its heading alone.

    ``place`` is that of its document. ``publications``: ``publication, heading, published, documents``; ``documents``: ``publication, url, place, hash, text,
    region, following, error``.
    """
    headed = extraction.heading_record(publications.withColumn("labels", F.transform("documents", lambda d: d["label"])), gazetteer)
    base = settled(headed.select("publication", "published", "head", "documents"))
    named = documents.join(base.select("publication", "published"), "publication")
    read = extraction.document_record(named.where("text is not null"), gazetteer)
    calls = read.where(extraction.is_notice(F.col("doc.subject"), F.col("url")))
    once = settled(extraction.one_per_subject(settled(calls)).select("publication", "hash", "text", "doc", "place"))
    both = extraction.merged(once.join(base, "publication"))
    of_documents = both.select("publication", "published", "place", F.col("hash").alias("document"), fingerprint(F.col("text")).alias("fingerprint"), F.lit(False).alias("unread"), F.lit(False).alias("unreadable"), "disagreements", *(F.col(f"merged.{f}").alias(f) for f in HEAD_FIELDS))
    state = documents.groupBy("publication").agg(F.bool_or(F.col("hash").isNull()).alias("unread"), F.bool_or(F.col("error").isNotNull() & F.col("hash").isNotNull()).alias("unreadable"))
    rest = base.join(of_documents.select("publication").distinct(), "publication", "left_anti").join(state, "publication", "left")
    none = F.lit(None).cast("string")
    of_headings = rest.select("publication", "published", F.lit(0).alias("place"), none.alias("document"), none.alias("fingerprint"), F.coalesce("unread", F.lit(False)).alias("unread"), F.coalesce("unreadable", F.lit(False)).alias("unreadable"), F.array().cast("array<struct<field:string,heading:string,document:string>>").alias("disagreements"), *(F.col(f"head.{f}").alias(f) for f in HEAD_FIELDS))
    return settled(of_documents.unionByName(of_headings))


def send(messages: DataFrame, sink, report: Callable[[str], None] = print) -> tuple[list, int]:
    """Send one message after the other, but none that the sink has accepted; keys of accepted messages, and how many failed. Addresses stay out of the report."""
    accepted, failed, claimed = [], 0, "claim" in messages.columns
    for m in messages.toLocalIterator():
        claim = m["claim"] if claimed else None
        try:
            if not (claim and sink.accepted(claim)):
                sink.send(m["email"], m["variant"], m["subject"], m["text"], m["html"], claim)
            accepted.append((m["recipient"], m["variant"]))
        except Exception as e:  # noqa: BLE001  one recipient's failure is not another's
            failed += 1
            report(f"recipient {m['recipient']}: {str(e).replace(m['email'], '<destinatario>')}")
    return accepted, failed


def delivered(messages: DataFrame, folder: str, ask: bool = False) -> DataFrame:
    """``recipient, variant, error``: each task delivers its messages and says what was accepted (null: accepted).

    What the sink has accepted isn't sent again, whichever task or run asks. With ``ask`` nothing is sent: only what was accepted comes back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = FileSink(folder)
        for batch in batches:
            out = []
            for m in batch.to_pylist():
                try:
                    if not sink.accepted(m["claim"]):
                        if ask:
                            continue
                        sink.send(m["email"], m["variant"], m["subject"], m["text"], m["html"], m["claim"])
                    error = None
                except Exception as e:  # noqa: BLE001  one recipient's failure is not another's
                    error = str(e).replace(m["email"], "<destinatario>")
                out.append((m["recipient"], m["variant"], error))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], ["recipient", "variant", "error"])

    return messages.select("recipient", "variant", "email", "subject", "text", "html", "claim").mapInArrow(run, "recipient long, variant string, error string")


def daily_messages(
    notices: DataFrame, first_seen: DataFrame, recipients: DataFrame, ledger: DataFrame, digests: DataFrame, names: DataFrame, alerts, sources, now: dt.datetime, ordered: DataFrame | None = None, duplicates: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Messages of today that are not yet served, and the entries behind them.

    ``ordered`` (publications of each notice, as :func:`shown.publications_in_order` gives them) and ``duplicates`` add links and notes.
    """
    at, day = F.lit(now), F.to_date(F.lit(now))
    firsts = digest.first_digests(digests).drop("digests")
    people = recipients.where("active").join(firsts, "recipient", "left")
    # recipients have a ``created`` of their own
    seen = notices.drop("published", "created", "updated").join(first_seen, "id")
    wants, sent = people.select("recipient", "classes", "provinces", "created", "first_digest", "split"), ledger.select("recipient", "id")
    single = digest.digest(seen, wants.where(~F.col("split")), sent, at).withColumn("for_province", F.lit(None).cast("string"))
    by_province = digest.narrowed(wants.where("split"), people.select("recipient", F.explode("provinces").alias("for_province")))
    split = digest.digest(seen, by_province, sent, at, ("recipient", "for_province"))
    every = settled(single.unionByName(split.select(single.columns)))
    wanted = every.select("recipient", F.col("for_province").alias("province")).distinct()
    open_ = digest.not_served(wanted, digests.where(F.col("day") == day).select("recipient", "province")).withColumnRenamed("province", "for_province")
    kept = every.join(open_, (every["recipient"] == open_["recipient"]) & every["for_province"].eqNullSafe(open_["for_province"]), "left_semi")
    empty = F.array().cast("array<struct<source:string,published:timestamp,url:string,sent:boolean>>")
    if ordered is None or duplicates is None:
        full = kept.withColumn("links", F.array().cast(rendering.LINK)).withColumn("duplicates", empty)
    else:
        full = shown.with_shown(kept, ["recipient", "for_province"], ordered, duplicates, ledger)
    messages = rendering.rendered(full, ["recipient", "for_province"], day, at, sources, alerts, names)
    return messages.join(people.select("recipient", "email"), "recipient").withColumnRenamed("for_province", "variant"), kept


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="noticeloom-job", description="Read sources, extract and link notices, watch the sources, and make the day's digests.")
    p.add_argument("--state", required=True, help="folder of the state's snapshots")
    p.add_argument("--towns", required=True, help="town list, separated by semicolons")
    p.add_argument("--sources", help="JSON catalogue of the sources to read; none: only what is stored is linked")
    p.add_argument("--replay", help="file of recorded responses instead of the network")
    p.add_argument("--classes", help="JSON object of class names")
    p.add_argument("--groups", help="JSON object of class groups; needed where someone wants a group")
    p.add_argument("--out", help="folder, seen by all executors, for messages as files: a dry run, nothing is recorded")
    p.add_argument("--deliver", help="folder, seen by all executors, for messages as files: digests, ledger and alerts are recorded")
    p.add_argument("--reread", action="store_true", help="only extract everything again from stored texts")
    a = p.parse_args(argv)
    if a.reread and (a.out or a.deliver or a.sources):
        p.error("--reread reads and sends nothing: it goes without --sources, --out and --deliver")
    if a.out and a.deliver:
        p.error("either --out or --deliver")
    return a


def with_parts(attached: DataFrame, parts: DataFrame, stored: DataFrame) -> DataFrame:
    """``publication, url, place, hash``: an archive with known parts gives way to them, in its place and their order."""
    known = parts.join(stored.select(F.col("hash").alias("part")), "part").select(F.col("archive").alias("hash"), F.col("place").alias("part_place"), "name", "part")
    whole = attached.join(known.select("hash").distinct(), "hash", "left_anti").select("publication", "url", "place", F.lit(0).alias("part_place"), "hash")
    inside = attached.join(known, "hash").select("publication", F.concat("url", F.lit("#"), "name").alias("url"), "place", "part_place", F.col("part").alias("hash"))
    order = Window.partitionBy("publication").orderBy("place", "part_place", "url")
    return whole.unionByName(inside).withColumn("place", F.row_number().over(order) - 1).drop("part_place")


def wanted_arrays(preferences: DataFrame, groups: DataFrame) -> DataFrame:
    """``recipient, classes, provinces``, with the classes of wanted groups."""
    classes = digest.expanded_classes(preferences, groups.where("class is not null")).select("recipient", F.lit("classe").alias("kind"), F.col("class").alias("value"))
    every = preferences.where("kind <> 'classe'").select("recipient", "kind", "value").unionByName(classes)
    return digest.preferences_by_kind(every).select("recipient", F.col("classe").alias("classes"), F.col("provincia").alias("provinces"))


#: What is extracted is extracted again when this changes: raise it with every change of the rules.
RULES = "3"


def extraction_digests(publications: DataFrame, attached: DataFrame, rules: str = RULES) -> DataFrame:
    """``publication, digest``: a hash of all that is extracted from: the heading, the documents with what was read of them, the rules' version."""
    one = F.to_json(F.struct("place", "url", "hash", "error", F.md5(F.coalesce("text", F.lit(""))).alias("text"), F.md5(F.coalesce("following", F.lit(""))).alias("following")))
    of = attached.groupBy("publication").agg(F.sort_array(F.collect_list(one)).alias("of"))
    whole = F.to_json(F.struct("heading", F.unix_micros("published").alias("published"), "documents", "of", F.lit(rules).alias("rules")))
    return publications.select("publication", "heading", "published", "documents").join(of, "publication", "left").select("publication", F.sha2(whole, 256).alias("digest"))


def relinked(spark: SparkSession, tables: dict[str, DataFrame], towns: str, now: dt.datetime) -> dict[str, DataFrame]:
    """The tables of notices after extracting what changed and linking it to what is stored.

    A notice of a changed publication is found by its document, the others in order. One that only this publication announces
    and that was never sent is settled anew with its own id, so that it may turn out to be an older notice; one that is shared or was
    sent stays and takes the new record where this brings a document. The rest are arrivals.
    """
    from noticeloom.sources.configuration import town_list

    gazetteer, stored = Gazetteer(town_list(spark, towns)), tables["document"]
    attached = with_parts(tables["publication_document"], tables["document_part"], stored).join(stored.select("hash", "text", "region", "following", "error"), "hash", "left")
    digests = settled(extraction_digests(tables["publication"], attached))
    stale = settled(digests.join(tables["extracted"], ["publication", "digest"], "left_anti").select("publication"))
    extracted = notices_of(tables["publication"].join(stale, "publication", "left_semi"), attached.join(stale, "publication", "left_semi"), gazetteer)
    extracted = extracted.withColumn("dates", F.array("published"))

    notices, bridge, ledger = tables["notice"], tables["announcement"], linking.resolved(tables["ledger"], tables["alias"])
    notices = settled(notices.withColumn("order", F.coalesce("arrived", F.concat(F.lit("0/"), F.lpad(F.col("id").cast("string"), 20, "0")))))
    of_stale = bridge.join(stale, "publication", "left_semi").join(notices.select("id", "document", "order"), "id")
    found = upserts.links_by_document_then_order(of_stale.withColumnRenamed("id", "notice").select("publication", "notice", "document"), extracted)
    shared = bridge.groupBy("id").agg((F.count("*") > 1).alias("shared"))
    facts = shared.join(ledger.select("id").distinct().withColumn("sent", F.lit(True)), "id", "left").join(notices.select("id", "order"), "id")
    records = extracted.join(found, ["publication", "place"], "left").join(facts.withColumnRenamed("id", "notice"), "notice", "left")
    free = ~F.coalesce("shared", F.lit(False)) & F.coalesce("sent", F.lit(False)).eqNullSafe(False)
    new_rank = linking.rank(F.lit(now), F.col("published"), F.col("publication"), F.col("place"))
    records = settled(records.withColumn("own", F.when(free, F.col("notice"))).withColumn("rank", F.when(F.col("notice").isNull(), new_rank).otherwise(F.col("order"))))
    arrivals = records.where("notice is null or own is not null")

    dated = bridge.join(tables["publication"].select("publication", "published"), "publication").groupBy("id").agg(F.collect_set("published").alias("dates"))
    released = arrivals.where("own is not null").select(F.col("own").alias("id"))
    standing = notices.join(released, "id", "left_anti").join(dated, "id")
    links = settled(linking.linked(arrivals, standing, bridge))
    alias = settled(linking.aliases(tables["alias"], links, arrivals))

    facts_ = [f for f in schemas.TABLES["notice"].fieldNames() if f not in ("id", "created", "updated", "arrived")]
    placed = arrivals.join(links.select("rank", "id", "made"), "rank")
    made = placed.where("made and own is null").select("id", *facts_, F.lit(now).alias("created"), F.lit(now).alias("updated"), F.col("rank").alias("arrived"))
    changes = placed.where("not made or own is not null").select("id", "rank", F.when(F.col("made"), "alone").otherwise("merge").alias("how"), *facts_)
    staying = records.where("notice is not null and own is null").select(F.col("notice").alias("id"), "rank", F.when(F.col("shared"), "update").otherwise("alone").alias("how"), *facts_)
    left = notices.drop("order").join(links.where("not made").join(arrivals.where("own is not null").select("rank", "own"), "rank").select(F.col("own").alias("id")), "id", "left_anti")
    better = settled(linking.improved(left, changes.unionByName(staying)).withColumn("updated", F.lit(now)))
    after = settled(left.join(better.select("id"), "id", "left_anti").unionByName(better).unionByName(made))
    announced = settled(linking.resolved(bridge, alias).unionByName(links.select("publication", "id")).distinct())

    dates = announced.join(tables["publication"].select("publication", "published"), "publication").groupBy("id").agg(F.collect_set("published").alias("dates"))
    # two that are the same by now and were both sent stay two, and a reader is told
    pairs = merging.related_pairs(after.join(dates, "id"))
    duplicates = merging.possible_duplicates(pairs.select("a", "b"), announced)
    return {"notice": after, "announcement": announced, "possible_duplicate": duplicates, "alias": alias, "extracted": digests}


def collected(spark: SparkSession, catalogue: str, known: DataFrame, now: dt.datetime, replay: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Read every configured source from its resume point: ``source, error`` of each, and the publications that were read."""
    from noticeloom.sources import configuration
    from noticeloom.sources.adapters import READERS

    sources = configuration.source_catalog(spark, catalogue)
    wrong = sources.count() and [f"{r['id']}: {r['problem']}" for r in configuration.source_problems(sources).collect()]
    if wrong:
        raise ValueError("; ".join(wrong))
    since = {r["source"]: r["since"] for r in monitoring.resume_points(known, F.lit(now)).collect()}
    outcomes, read = [], spark.createDataFrame([], "source string, key string, url string, heading string, published timestamp, documents array<struct<url:string,label:string>>")
    for s in sources.collect():  # configuration: a row a source
        first = since.get(s["id"], now - dt.timedelta(days=settings.FIRST_READ_DAYS))
        try:
            found = settled(READERS[s["adapter"]](spark, s["impostazioni"].asDict(), first, replay).where(F.col("published") >= F.lit(first)).select(F.lit(s["id"]).alias("source"), *read.columns[1:]))
            read, error = read.unionByName(found), None
        except Exception as e:  # noqa: BLE001  one source's failure is not another's
            error = next((x for x in reversed(str(e).split("\n")) if x.strip()), type(e).__name__)[:300]
        outcomes.append((s["id"], error))
    return spark.createDataFrame(outcomes, "source string, error string"), read


def with_read(publications: DataFrame, read: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """The table of publications after writing what was read over it, and ``source, read, new, updated``."""
    last = upserts.latest(read, ["source", "key"], ["published"])
    status = settled(upserts.statuses(publications, last, ["source", "key"], ["url", "heading", "published", "documents"]).where("status in ('new', 'updated', 'unchanged')"))
    counters = status.groupBy("source").agg(F.count("*").alias("read"), F.count_if(F.col("status") == "new").alias("new"), F.count_if(F.col("status") == "updated").alias("updated"))
    before = publications.select("source", "key", F.col("publication").alias("_id"), F.col("read").alias("_read"))
    number = F.shiftrightunsigned(F.xxhash64("source", "key"), 1)
    changed = last.join(status.where("status <> 'unchanged'"), ["source", "key"]).join(before, ["source", "key"], "left")
    rows = changed.withColumn("publication", F.coalesce("_id", number)).withColumn("read", F.coalesce("_read", F.lit(now))).withColumn("updated", F.lit(now)).select(publications.columns)
    return upserts.upserted(publications, rows, ["source", "key"]), counters


def listed(publications: DataFrame) -> DataFrame:
    """``publication, url, place`` of the documents that publications link."""
    return publications.select("publication", F.posexplode("documents").alias("place", "d")).select("publication", F.col("d.url").alias("url"), "place")


def to_fetch(links: DataFrame, attached: DataFrame, stored: DataFrame) -> DataFrame:
    """``publication, url, place`` of links that were never downloaded, or whose reading is out of date: by rules from before
    scans and archives were read, or from before the following pages were kept."""
    old = F.coalesce(F.col("error").rlike(P.READ_BY_OLD_RULES), F.lit(False)) | (F.col("text").isNotNull() & F.col("following").isNull())
    good = attached.where("hash is not null").select("publication", "url", "hash").join(stored.where(~old).select("hash"), "hash").select("publication", "url")
    return links.join(good, ["publication", "url"], "left_anti")


def with_documents(spark: SparkSession, tables: dict[str, DataFrame], now: dt.datetime, replay: str | None) -> dict[str, DataFrame]:
    """Download what is missing and read it: the tables of documents, of their parts, and of what is attached to publications."""
    from noticeloom.sources.documents import fetched, read_documents

    links = settled(listed(tables["publication"]))
    wanted = settled(to_fetch(links, tables["publication_document"], tables["document"]))
    bodies = settled(fetched(wanted.select("url").distinct(), replay))
    hashed = bodies.where("content is not null").withColumn("whole", F.sha2("content", 256))
    parts = settled(read_documents(hashed.select("whole", "content").dropDuplicates(["whole"]), "whole", "content"))
    single = parts.groupBy("key").agg((F.max("part") == 0).alias("one"), F.min("name").alias("name")).select("key", (F.col("one") & (F.col("name") == "")).alias("single"))
    read = parts.join(single, "key").withColumn("hash", F.coalesce(F.when(F.col("single"), F.col("key")), F.col("hash"), F.col("key")))
    at = F.lit(now)
    documents = read.select("hash", "kind", F.col("size").cast("int").alias("size"), "text", "region", "following", "error", at.alias("created"))
    # an archive is a document too: it is known, and not downloaded again
    whole = hashed.dropDuplicates(["whole"]).join(single.where("not single").select(F.col("key").alias("whole")), "whole")
    documents = documents.unionByName(schemas.conformed(whole.select(F.col("whole").alias("hash"), F.lit(P.EXTENSION_TYPES["zip"]).alias("kind"), F.octet_length("content").alias("size"), at.alias("created")), "document"))
    documents = settled(documents.dropDuplicates(["hash"]))
    archives = read.where(~F.col("single")).select(F.col("key").alias("archive"), F.col("part").alias("place"), "name", F.col("hash").alias("part"))
    attached = wanted.join(bodies.join(hashed.select("url", "whole"), "url", "left"), "url").select("publication", "url", "place", F.col("whole").alias("hash"), "error", at.alias("read"))
    attached = settled(schemas.conformed(attached, "publication_document").dropDuplicates(["publication", "url"]))
    changes = settled(upserts.link_changes(tables["publication_document"], links, attached))
    return {
        "document": upserts.upserted(tables["document"], schemas.conformed(documents, "document"), ["hash"]),
        "document_part": upserts.upserted(tables["document_part"], schemas.conformed(archives, "document_part"), ["archive", "place"]),
        "publication_document": upserts.reconciled(tables["publication_document"], attached, changes),
    }


def monitored(tables: dict[str, DataFrame], outcomes: DataFrame, names: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """The state of the sources after a run, with today's announcements marked, and the alerts of the day."""
    at, today = F.lit(now), rome_day(F.lit(now))
    called = tables["announcement"].join(tables["notice"].where("staff = 'docente'").select("id", (F.size("classes") > 0).alias("c")), "id").groupBy("publication").agg(F.bool_or("c").alias("has_classes"))
    seen = tables["publication"].select(F.col("publication").alias("id"), "source", "published").join(called.withColumnRenamed("publication", "id"), "id", "left")
    formats = monitoring.problems(outcomes, seen.withColumn("has_classes", F.coalesce("has_classes", F.lit(False))), at)
    state = settled(monitoring.transitions(tables["source_state"], formats, at))
    last = tables["publication"].groupBy("source").agg(F.max("published").alias("last"))
    return monitoring.announced(state, today), monitoring.alerts(state, names, last, today).where("due")


def composed(spark: SparkSession, tables: dict[str, DataFrame], a: argparse.Namespace, names: DataFrame, alerts: list, now: dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages of the day with digests, their entries, and messages that only have alerts."""
    from noticeloom.sources import configuration

    groups = configuration.group_members(spark, a.groups) if a.groups else spark.createDataFrame([], "name string, class string")
    class_names = configuration.class_names(spark, a.classes) if a.classes else spark.createDataFrame([], "class string, name string")
    people = tables["recipient"].join(wanted_arrays(tables["preference"], groups), "recipient")
    ordered = settled(shown.publications_in_order(tables["announcement"], tables["publication"], names))
    first_seen = ordered.select("id", F.get("ps", F.lit(0))["published"].alias("published"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in alerts)) if alerts else F.array().cast("array<struct<kind:string,text:string>>")
    listed = sorted(r["name"] for r in names.collect())
    sources = F.array(*map(F.lit, listed)) if listed else F.array().cast("array<string>")
    messages, entries = daily_messages(tables["notice"], first_seen, people, linking.resolved(tables["ledger"], tables["alias"]), tables["digest"], class_names, kinds, sources, now, ordered, tables["possible_duplicate"])
    day, messages = rome_day(F.lit(now)), settled(messages)
    only = people.limit(0)
    if alerts:
        today = tables["digest"].where(F.col("day") == day), tables["alert"].where(F.col("day") == day)
        only = digest.alert_only_recipients(people, *today, messages.select("recipient"))
    alone = rendering.alert_only(only, day, F.lit(now), sources, kinds).join(people.select("recipient", "email"), "recipient").withColumn("variant", F.lit(None).cast("string"))
    return messages, entries, alone


def recorded(tables: dict[str, DataFrame], sent: DataFrame, entries: DataFrame, alone: DataFrame, now: dt.datetime) -> dict[str, DataFrame]:
    """Digest, ledger and alert rows of what was accepted."""
    day, good = rome_day(F.lit(now)), sent.where("error is null").select("recipient", F.col("variant").alias("province"))
    number = F.shiftrightunsigned(F.xxhash64("recipient", F.coalesce("province", F.lit("")), F.lit(now)), 1)
    digests = settled(good.withColumn("digest", number))
    rows = digests.select("digest", "recipient", day.alias("day"), "province", F.lit(now).alias("sent"))
    in_it = entries.select(F.col("recipient").alias("_r"), "id", F.col("for_province").alias("_p")).join(digests, (F.col("_r") == F.col("recipient")) & F.col("_p").eqNullSafe(F.col("province")))
    alerts = alone.where("error is null").select(F.shiftrightunsigned(F.xxhash64("recipient", F.lit(now)), 1).alias("alert"), "recipient", day.alias("day"), F.lit(now).alias("sent"))
    return {
        "digest": tables["digest"].unionByName(schemas.conformed(rows, "digest")),
        "ledger": tables["ledger"].unionByName(schemas.conformed(digest.new_ledger_rows(in_it.select("recipient", "id", "digest"), tables["ledger"]), "ledger")),
        "alert": tables["alert"].unionByName(schemas.conformed(alerts, "alert")),
    }


def boxed(spark: SparkSession, folder: str, messages: DataFrame, entries: DataFrame, alone: DataFrame, now: dt.datetime) -> None:
    """Fill an outbox: every message with its claim, then the entries behind them, which say that the outbox is whole."""

    def claimed(rows: DataFrame, what: str) -> DataFrame:
        key = F.concat_ws("/", F.lit(what), F.col("recipient").cast("string"), F.coalesce("variant", F.lit("")), F.date_format(F.lit(now), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        return rows.select("recipient", "variant", "email", "subject", "text", "html", F.sha2(key, 256).alias("claim"), F.lit(what).alias("what"), F.lit(now).alias("at"))

    claimed(messages, "digest").unionByName(claimed(alone, "alert")).write.parquet(f"{folder}/messages")
    entries.select("recipient", "id", "for_province").write.parquet(f"{folder}/entries")


def from_outbox(spark: SparkSession, tables: dict[str, DataFrame], folder: str, to: str, ask: bool) -> tuple[dict[str, DataFrame], int]:
    """Deliver an outbox, or ask what of it was accepted: the tables with that recorded, and how many messages failed."""
    messages, entries = spark.read.parquet(f"{folder}/messages"), spark.read.parquet(f"{folder}/entries")
    at = messages.agg(F.max("at")).first()[0]
    if at is None:
        return {}, 0
    sent, told = (settled(delivered(messages.where(F.col("what") == what), to, ask)) for what in ("digest", "alert"))
    failed = sent.where("error is not null").count() + told.where("error is not null").count()
    return recorded(tables, sent, entries, told, at), failed


def run(spark: SparkSession, a: argparse.Namespace, now: dt.datetime) -> int:
    """One day. How many messages failed."""
    from noticeloom.sources import configuration

    state, done = State(spark, a.state), []
    tables = {name: state.read(name, needed=name == "publication") for name in schemas.TABLES}  # no state without publications
    if not a.groups and not tables["preference"].where("kind = 'gruppo'").isEmpty() and (a.out or a.deliver):
        raise ValueError("recipients want groups of classes, and --groups is not given")

    def write(*names: str) -> None:
        for name in names:
            tables[name] = state.stage(name, tables[name])

    if a.deliver:
        for box in state.open_outboxes():  # a run that broke after it had begun to send
            tables |= from_outbox(spark, tables, f"{a.state}/outbox/{box}", a.deliver, ask=True)[0]
            write("digest", "ledger", "alert")
            done.append(box)
    names, outcomes = spark.createDataFrame([], "source string, name string"), None
    if a.sources:
        names = configuration.source_catalog(spark, a.sources).select(F.col("id").alias("source"), F.col("nome").alias("name"))
        outcomes, read = collected(spark, a.sources, tables["publication"], now, a.replay)
        tables["publication"], counters = with_read(tables["publication"], read, now)
        write("publication")
        tables |= with_documents(spark, tables, now, a.replay)
        write("document", "document_part", "publication_document")
        for r in outcomes.join(counters, "source", "left").orderBy("source").collect():  # a row a source
            print(f"{r['source']}: " + (r["error"] or f"{r['read'] or 0} read, {r['new'] or 0} new, {r['updated'] or 0} updated"))
    if a.reread:
        tables["extracted"] = schemas.empty(spark, "extracted")
    changed = relinked(spark, tables, a.towns, now)
    tables |= changed
    write(*changed)
    alerts: list[tuple[str, str]] = []
    if outcomes is not None:
        tables["source_state"], due = monitored(tables, outcomes, names, now)
        alerts = [(r["kind"], r["text"]) for r in due.orderBy("source").collect()]  # a row a source
        write("source_state")
    # what messages will be about is recorded before they are: a notice that was sent has its id for good
    state.commit(done)
    failed = 0
    if a.out or a.deliver:
        messages, entries, alone = composed(spark, tables, a, names, alerts, now)
        box = uuid.uuid4().hex
        # a dry run has an outbox of its own, elsewhere, and leaves nothing to record
        folder = f"{a.state}/{'outbox' if a.deliver else 'dry'}/{box}"
        boxed(spark, folder, messages, entries, alone, now)
        sent, failed = from_outbox(spark, tables, folder, a.deliver or a.out, ask=False)
        if a.deliver:
            tables |= sent
            write(*sent)
            state.commit([box])
    return failed


def main(argv: list[str] | None = None, now: dt.datetime | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return int(run(spark, a, now or dt.datetime.now(dt.UTC).replace(tzinfo=None)) > 0)
    except Exception as e:  # noqa: BLE001
        print(f"job failed: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
