"""Codes, classifiers and numbers from texts of notices, ``Column -> Column``, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.functions import patterns as P
from noticeloom.functions import phrases
from noticeloom.functions.text import fold


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.when(text.rlike(pattern), F.nullif(F.regexp_extract(text, pattern, group), F.lit("")))


def class_code(spelling: Column) -> Column:
    """``A-11``, ``a11`` and ``A011`` are ``A011``."""
    return F.regexp_replace(F.regexp_replace(F.upper(spelling), r"(?U)[\s-]", ""), r"^([AB])(\d{2})\z", "$10$2")


def province_code(spelling: Column) -> Column:
    return F.upper(F.trim(spelling))


def email(address: Column) -> Column:
    return F.lower(F.trim(address))


def _words(text: Column, folded: Column | None) -> Column:
    return phrases.words(fold(text)) if folded is None else folded


def notice_type(text: Column, folded: Column | None = None) -> Column:
    """``folded``: the folded text's words, where they are known already."""
    return phrases.first_said(_words(text, folded), P.NOTICE_TYPES, P.DEFAULT_TYPE)


def staff(text: Column, folded: Column | None = None) -> Column:
    return phrases.first_said(_words(text, folded), P.STAFF, P.DEFAULT_STAFF)


def classes(text: Column, folded: Column | None = None) -> Column:
    """``struct<codes, inferred>``: written codes, and what phrases on support and common posts add, with the phrase."""
    written = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(phrases.shaped(P.CLASS_SHAPES)), F.lit(1)), class_code))
    t = _words(text, folded)
    grade = phrases.first_said(t, P.SUPPORT_OVERRIDES + P.SUPPORT_GRADES, None)
    support = F.when(~F.exists(written, lambda c: c.startswith("AD")) & phrases.says(t, P.SUPPORT), grade)
    common = F.when((F.size(written) == 0) & support.isNull() & phrases.says(t, P.COMMON_POST), phrases.first_said(t, P.COMMON_POST_CLASSES, None))
    extra = F.coalesce(support, common)
    phrase = F.when(support.isNotNull(), F.concat(support, F.lit(' da "sostegno"'))).otherwise(F.concat(common, F.lit(' da "posto comune"')))
    empty = F.array().cast("array<string>")
    return F.struct(
        F.when(extra.isNull(), written).otherwise(F.array_union(written, F.array(extra))).alias("codes"),
        F.when(extra.isNull(), empty).otherwise(F.array(phrase)).alias("inferred"),
    )


def protocol(texts: Column) -> Column:
    """``struct<number, date>`` of the first of several texts that has one; fields are null if none has."""
    hit = F.get(F.filter(texts, lambda t: t.rlike(P.PROTOCOL)), F.lit(0))
    return F.struct(F.nullif(F.regexp_extract(hit, P.PROTOCOL, 1), F.lit("")).alias("number"), F.nullif(F.regexp_extract(hit, P.PROTOCOL, 2), F.lit("")).alias("date"))


def protocol_number(number: Column) -> Column:
    """Without a year and leading zeros."""
    return F.regexp_replace(F.regexp_replace(number, r"/(?:19|20)\d{2}\z", ""), r"^0+(?=\d)", "")


def school_code(text: Column) -> Column:
    return found(text, P.SCHOOL_CODE)


def hours(text: Column) -> Column:
    return found(text, P.HOURS, 1).try_cast("int")


def until(text: Column) -> Column:
    return F.coalesce(found(text, P.UNTIL, 1), F.when(text.rlike(P.UNTIL_PHRASE), P.UNTIL_TEXT))
