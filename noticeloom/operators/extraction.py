"""Structured records from headings and documents, and their merge field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom import settings
from noticeloom.functions import codes, phrases, places
from noticeloom.functions import patterns as P
from noticeloom.functions.text import fold, one_line

TEXT_ARRAY = "array<string>"


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Working columns, each used by later ones: what many expressions share is computed once a row."""
    for name, column in columns.items():
        df = df.withColumn(f"_{name}", column)
    return df


def heading_record(publications: DataFrame, gazetteer: places.Gazetteer) -> DataFrame:
    """``heading, labels array<string>, published`` (and any other columns) with a ``head`` struct added."""
    heading = F.col("heading")
    known = F.substring("_code", 1, 2).isin(sorted(gazetteer.codes)) if gazetteer.codes else F.lit(False)
    rows = staged(
        publications,
        folded=phrases.words(fold(heading)),
        place=places.place(gazetteer, heading),
        deadline=places.deadline(heading, F.col("published")),
        code=codes.school_code(heading),
        own=codes.protocol(F.col("labels")),
        written=codes.protocol(F.array(heading)),
        kind=codes.notice_type(heading, F.col("_folded")),
        found=codes.classes(heading, F.col("_folded")),
    )
    place, own, written = F.col("_place"), F.col("_own"), F.col("_written")
    from_code, is_call = place["province"].isNull() & known, F.col("_kind") == P.DEFAULT_TYPE
    head = F.struct(
        F.col("_kind").alias("type"),
        codes.staff(heading, F.col("_folded")).alias("staff"),
        F.col("_found.codes").alias("classes"),
        F.col("_found.inferred").alias("inferred"),
        place["school"].alias("school"),
        F.col("_code").alias("school_code"),
        place["town"].alias("town"),
        F.when(from_code, F.substring("_code", 1, 2)).otherwise(place["province"]).alias("province"),
        F.when(from_code, "codice-meccanografico").otherwise(place["province_from"]).alias("province_from"),
        F.coalesce(own["number"], F.when(is_call, written["number"])).alias("protocol"),
        own["date"].alias("protocol_date"),
        F.when(~is_call, written["number"]).alias("referred_protocol"),
        codes.hours(heading).alias("hours"),
        codes.until(heading).alias("until"),
        F.col("_deadline").alias("deadline"),
    )
    return rows.select(*publications.columns, head.alias("head"))


def _first_true(flags: Column) -> Column:
    """1-based place of the first true; null if there is none."""
    return phrases.bound(F.array_position(flags, True).cast("int"), lambda at: F.when(at > 0, at))


def subject_region(text: Column) -> Column:
    """The subject line and the lines after it, as they are; null without a subject."""

    def region(lines: Column) -> Column:
        at = _first_true(F.transform(lines, lambda x: x.rlike(P.SUBJECT_LINE)))
        # a start that is null gives null
        return F.regexp_replace(F.array_join(F.slice(lines, at, F.lit(settings.SUBJECT_REGION_LINES + 1)), "\n"), r"(?U)\s+\z", "")

    return phrases.bound(F.split(text, "\n"), region)


def subject(region: Column) -> Column:
    """The subject on one line: its line and continuations, up to a blank line or the start of the body."""

    def continued(following: Column) -> Column:
        stop = _first_true(F.transform(following, lambda x: (F.trim(x) == "") | x.rlike(P.BODY_START)))
        return F.slice(following, F.lit(1), F.coalesce(stop - 1, F.size(following)))

    def whole(lines: Column) -> Column:
        first = F.regexp_replace(F.get(lines, F.lit(0)), P.SUBJECT_LINE, "")
        return one_line(F.array_join(F.concat(F.array(first), phrases.bound(F.slice(lines, 2, settings.SUBJECT_CONTINUATION_LINES), continued)), " "))

    return phrases.bound(phrases.bound(F.split(region, "\n"), whole), lambda x: F.when(x != "", x))


def letterhead(text: Column) -> Column:
    """The first lines up to addressees or subject, without those of authorities."""
    lines = F.split(text, "\n")
    stop = _first_true(F.transform(lines, lambda x: x.rlike(P.SUBJECT_LINE) | x.rlike(P.ADDRESSEE_LINE)))
    head = F.slice(lines, F.lit(1), F.coalesce(stop - 1, F.size(lines)))
    clean = F.filter(F.transform(head, one_line), lambda x: (x != "") & ~x.rlike(P.AUTHORITY_LINE))
    return F.slice(clean, 1, settings.LETTERHEAD_LINES)


def before_subject(text: Column) -> Column:
    """Where a document's own protocol stands: before its subject, or in the lines of a letterhead if it has none."""
    lines = F.split(text, "\n")
    stop = _first_true(F.transform(lines, lambda x: x.rlike(P.SUBJECT_LINE)))
    return F.array_join(F.slice(lines, F.lit(1), F.coalesce(stop - 1, F.lit(settings.LETTERHEAD_LINES))), "\n")


def document_school_code(lines: Column, text: Column) -> Column:
    head = F.array_join(lines, "\n")
    found = [x for t in (head, text) for x in (codes.found(t, P.SCHOOL_CODE_LOOSE), F.upper(codes.found(t, P.SCHOOL_EMAIL, 1)))]
    return F.coalesce(*found)


def letterhead_school(lines: Column) -> Column:
    line = F.get(F.filter(lines, lambda x: x.rlike(P.LETTERHEAD_SCHOOL)), F.lit(0))
    return F.nullif(F.trim(F.get(F.split(line, r"(?i)\s[-–]\s*(?:c\.\s?f\.|c\.\s?m\.|cod)|\s+c\.\s?f\.\s"), F.lit(0))), F.lit(""))


def is_notice(subject_: Column, name: Column) -> Column:
    """The subject names a call and no form, nor does the file's name or label."""
    words = phrases.words(fold(subject_))
    return F.coalesce(phrases.says(words, P.NOTICE_SUBJECT) & ~phrases.says(words, P.FORM_SUBJECT), F.lit(False)) & ~phrases.says(F.lower(name), P.FORM_NAME)


def document_record(documents: DataFrame, gazetteer: places.Gazetteer) -> DataFrame:
    """``text, region, following, published`` (and any other columns) with a ``doc`` struct added."""
    text, lines, title = F.col("text"), F.col("_lines"), F.col("_title")
    known = sorted(gazetteer.codes)
    rows = staged(
        documents,
        lines=letterhead(text),
        region=F.coalesce(F.col("region"), subject_region(text)),
        title=subject(F.col("_region")),
        folded=phrases.words(fold(title)),
        code=document_school_code(lines, text),
        office=F.upper(codes.found(text, P.OFFICE_EMAIL, 1)),
        place=places.letterhead_place(gazetteer, lines),
        deadline=places.deadline(F.concat_ws("\n", text, F.col("following")), F.col("published")),
        own=codes.protocol(F.array(before_subject(text))),
        found=codes.classes(title, F.col("_folded")),
    )
    prefix, office, place, own = F.substring("_code", 1, 2), F.col("_office"), F.col("_place"), F.col("_own")
    by_code, by_office = (F.when(c.isin(known), c) if known else F.lit(None).cast("string") for c in (prefix, office))
    empty = F.array().cast(TEXT_ARRAY)
    origin = F.when(by_code.isNotNull(), "documento-codice-meccanografico").when(by_office.isNotNull(), "documento-usp").otherwise(F.concat(F.lit("documento-"), place["province_from"]))
    doc = F.struct(
        title.alias("subject"),
        F.when(title.isNotNull(), codes.notice_type(title, F.col("_folded"))).alias("type"),
        F.when(title.isNotNull(), codes.staff(title, F.col("_folded"))).alias("staff"),
        F.coalesce(F.col("_found.codes"), empty).alias("classes"),
        F.coalesce(F.col("_found.inferred"), empty).alias("inferred"),
        letterhead_school(lines).alias("school"),
        F.col("_code").alias("school_code"),
        place["town"].alias("town"),
        F.coalesce(by_code, by_office, place["province"]).alias("province"),
        origin.alias("province_from"),
        codes.protocol_number(own["number"]).alias("protocol"),
        own["date"].alias("protocol_date"),
        F.col("_deadline").alias("deadline"),
    )
    return rows.select(*documents.columns, doc.alias("doc"))


def merged(records: DataFrame, head: str = "head", doc: str = "doc") -> DataFrame:
    """Two record structs into ``merged`` and ``disagreements array<struct<field, heading, document>>``: the document wins."""
    h, d = F.col(head), F.col(doc)

    def differing(name: str, a: Column, b: Column, key=lambda x: x) -> Column:
        one = F.struct(F.lit(name).alias("field"), a.alias("heading"), b.alias("document"))
        return F.when(a.isNotNull() & b.isNotNull() & (key(a) != key(b)), one)

    def listed(x: Column) -> Column:
        return F.nullif(F.array_join(F.sort_array(x), ","), F.lit(""))

    def iso(x: Column) -> Column:
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    disagreements = F.filter(
        F.array(
            differing("classes", listed(h["classes"]), listed(d["classes"])),
            differing("type", h["type"], d["type"]),
            differing("staff", h["staff"], d["staff"]),
            differing("school_code", h["school_code"], d["school_code"]),
            differing("town", h["town"], d["town"], fold),
            differing("province", h["province"], d["province"]),
            differing("protocol", h["protocol"], d["protocol"], codes.protocol_number),
            differing("deadline", iso(h["deadline"]), iso(d["deadline"])),
        ),
        lambda x: x.isNotNull(),
    )
    has_classes = F.coalesce(F.size(d["classes"]) > 0, F.lit(False))
    has_province, has_protocol = d["province"].isNotNull(), d["protocol"].isNotNull()
    kind = F.coalesce(d["type"], h["type"])
    out = F.struct(
        kind.alias("type"),
        F.coalesce(d["staff"], h["staff"]).alias("staff"),
        F.when(has_classes, d["classes"]).otherwise(h["classes"]).alias("classes"),
        F.when(has_classes, d["inferred"]).otherwise(h["inferred"]).alias("inferred"),
        F.coalesce(d["school"], h["school"]).alias("school"),
        F.coalesce(d["school_code"], h["school_code"]).alias("school_code"),
        F.coalesce(d["town"], h["town"]).alias("town"),
        F.when(has_province, d["province"]).otherwise(h["province"]).alias("province"),
        F.when(has_province, d["province_from"]).otherwise(h["province_from"]).alias("province_from"),
        F.coalesce(d["protocol"], h["protocol"]).alias("protocol"),
        F.when(has_protocol, d["protocol_date"]).otherwise(h["protocol_date"]).alias("protocol_date"),
        F.when(kind != P.DEFAULT_TYPE, h["referred_protocol"]).alias("referred_protocol"),
        h["hours"].alias("hours"),
        h["until"].alias("until"),
        F.coalesce(d["deadline"], h["deadline"]).alias("deadline"),
    )
    return records.withColumn("merged", out).withColumn("disagreements", disagreements)


def one_per_subject(documents: DataFrame) -> DataFrame:
    """Of documents of a publication with the same school and subject the first; it takes a later copy's protocol if it has none.

    ``publication, place, hash, doc``. Repeats of one body count once.
    """
    body = Window.partitionBy("publication", "hash").orderBy("place")
    once = documents.withColumn("_b", F.row_number().over(body)).where("_b = 1").drop("_b")
    marked = once.withColumn("_school", F.lower(F.coalesce("doc.school", F.lit("")))).withColumn("_subject", fold(one_line(F.col("doc.subject"))))
    group = Window.partitionBy("publication", "_school", "_subject").orderBy("place")
    later = F.first(F.when(F.col("doc.protocol").isNotNull(), F.struct("doc.protocol", "doc.protocol_date")), ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = marked.withColumn("_k", F.row_number().over(group)).withColumn("_p", later).where("_k = 1")
    own = F.col("doc.protocol").isNotNull()
    doc = F.col("doc").withField("protocol", F.coalesce("doc.protocol", "_p.protocol")).withField("protocol_date", F.when(own, F.col("doc.protocol_date")).otherwise(F.col("_p.protocol_date")))
    return ranked.withColumn("doc", doc).drop("_school", "_subject", "_k", "_p")
