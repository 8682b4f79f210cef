"""Text functions, ``Column -> Column``. All run in the JVM except for :func:`decode_numeric_entities`."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom import settings
from noticeloom.functions import patterns as P


def _accents() -> tuple[str, str]:
    """Characters of the basic plane whose decomposition without marks is one other character, and that character."""
    source, target = [], []
    for i in range(0xC0, 0xAC00):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(i)) if not unicodedata.category(c).startswith("M"))
        if len(plain) == 1 and plain != chr(i):
            source.append(chr(i))
            target.append(plain)
    return "".join(source), "".join(target)


_WITH, _WITHOUT = _accents()


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.regexp_replace(F.translate(text, _WITH, _WITHOUT), r"\p{M}", ""))


def name_key(text: Column) -> Column:
    """Folded words of a to z, one space between."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z]+", " "))


_NUMERIC = re.compile(r"&#(?:x([0-9a-f]+)|(\d+));", re.I)


@F.pandas_udf(T.StringType())
def decode_numeric_entities(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``&#8217;`` and ``&#x2019;``: Spark's ``chr`` only knows the first 256 code points."""

    def char(m: re.Match) -> str:
        n = int(m[1], 16) if m[1] else int(m[2])
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    for batch in texts:
        yield batch.map(lambda t: t if t is None else _NUMERIC.sub(char, t))


def clean_text(fragment: Column, numeric: bool = True) -> Column:
    """An HTML fragment as plain text on one line. ``numeric=False`` leaves numeric entities, and so all work in the JVM."""
    out = F.regexp_replace(fragment, r"(?i)<br\s*/?>", " ")
    out = F.regexp_replace(out, "<[^>]+>", "")
    if numeric:
        out = F.when(out.contains("&#"), decode_numeric_entities(out)).otherwise(out)
    # one entity after the other would decode "&amp;lt;" twice: the ampersand waits behind a character that texts don't have
    for name, char in P.ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit("﷐" if name == "amp" else char))
    out = F.replace(out, F.lit("﷐"), F.lit("&"))
    out = F.translate(out, "‘’`´“”«»″–—‐‑", "''''\"\"\"\"\"----")
    return one_line(out)


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def without_email(text: Column, email: Column) -> Column:
    return F.replace(text, email, F.lit("<destinatario>"))


def safe_file_name(email: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(email), "[^a-z0-9@._+-]", "_"), r"^\.+", "_")


def fingerprint(text: Column) -> Column:
    """SHA-256 of a text without rulers and registry stamps; null if too short to recognise."""
    plain = F.lower(one_line(F.regexp_replace(F.regexp_replace(text, P.RULERS, " "), P.REGISTRY_STAMP, " ")))
    return F.when(F.length(plain) >= settings.LEAST_FINGERPRINT_CHARS, F.sha2(plain.cast("binary"), 256))


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def fallback_key(heading: Column, instant: Column) -> Column:
    """For an item without a document of its own."""
    iso = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat(F.lit("impronta:"), F.substring(F.sha2(F.concat(heading, F.lit("\n"), iso).cast("binary"), 256), 1, 32))


def body_format(body: Column) -> Column:
    """A document's format by its first bytes."""
    head = F.hex(F.substring(body, 1, 4))
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B"), "zip")
        .when(head.startswith("377A"), "7z")
        .when(head.startswith("52617221"), "rar")
        .when(head.startswith("D0CF"), "doc")
        .otherwise("sconosciuto")
    )


def type_of_name(name: Column) -> Column:
    extension = F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)\z", 1)
    types = F.create_map(*(F.lit(x) for pair in P.EXTENSION_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(types, extension), F.lit("application/octet-stream"))


def inconsistent_body(body: Column, kind: Column, url: Column, asked: Column) -> Column:
    """Why a response is not what it says; null if it is. ``asked``: the content types that were asked for."""
    head = F.decode(F.substring(body, 1, 1024), "ISO-8859-1")
    said_pdf = kind.isin(*P.PDF_TYPES) | F.regexp_replace(url, r"[?#].*", "").rlike(r"(?i)\.pdf\z")
    return F.when(~F.array_contains(asked, "text/html") & head.rlike(r"(?i)^\s*<(!doctype html|html|head|body)\b"), "html page instead of the content").when(
        said_pdf & ~head.contains("%PDF"), "the body is no PDF"
    )


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def unescaped(text: str) -> str:
    return html.unescape(text)
