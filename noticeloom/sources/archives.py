"""Documents: archives flattened into their members, and the text of word-processor files. A failure is a row, not an exception."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom import settings
from noticeloom.functions import patterns as P

_SKIP = re.compile(P.NOT_A_DOCUMENT)
PARTS = "path string, content binary, error string"


def members(body: bytes, depth: int = 0) -> Iterator[tuple[str, bytes | None, str | None]]:
    """Path, bytes and error of each document in a body; a body that is no archive is its own only member, with an empty path."""
    if not body.startswith(b"PK"):
        yield "", body, None
        return
    try:
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            names = set(z.namelist())
            if "word/document.xml" in names or {"mimetype", "content.xml"} <= names:
                yield "", body, None
                return
            if depth >= settings.ARCHIVE_DEPTH:
                yield "", None, f"{P.UNREADABLE}: too many archives inside each other"
                return
            found = False
            for info in z.infolist():
                if info.is_dir() or _SKIP.search(info.filename) or info.file_size > settings.MOST_PART_BYTES:
                    continue
                for path, content, error in members(z.read(info), depth + 1):
                    found = True
                    yield f"{info.filename}/{path}" if path else info.filename, content, error
            if not found:
                yield "", None, f"{P.UNREADABLE}: empty archive"
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError) as e:
        yield "", None, f"{P.UNREADABLE}: broken ZIP ({str(e).splitlines()[0] if str(e) else type(e).__name__})"


def docx_text(body: bytes) -> str:
    """A paragraph a line."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))  # noqa: S314
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")).strip()


def parts(bodies: DataFrame, key: str, content: str) -> DataFrame:
    """``key, name, content, error``: a row a member. Members leave a task one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, body in zip(batch["key"], batch["content"], strict=True):
                for path, data, error in members(bytes(body)) if body is not None else ():
                    yield pd.DataFrame({"key": [k], "name": [path], "content": [data], "error": [error]})

    kind = bodies.schema[key].dataType.simpleString()
    out = bodies.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInPandas(run, f"key {kind}, name string, content binary, error string")
    return out.withColumnRenamed("key", key)


DOCX = "text string, region_source string, following string, error string"


def read_docx(parts_: DataFrame) -> DataFrame:
    """``content`` of word-processor files to ``text, following, error`` beside the other columns; the first characters stand for page 1."""

    @F.pandas_udf("struct<body:string,error:string>")
    def read(contents: pd.Series) -> pd.DataFrame:
        out = []
        for c in contents:
            try:
                body = docx_text(bytes(c)) if c is not None else ""
                out.append((body, None) if len(body) >= settings.LEAST_TEXT_CHARS else (None, f"{P.UNREADABLE}: DOCX without text"))
            except Exception as e:  # noqa: BLE001  any broken file is a row
                out.append((None, f"{P.UNREADABLE}: broken DOCX ({type(e).__name__})"))
        return pd.DataFrame(out, columns=["body", "error"])

    x = parts_.withColumn("_r", read("content"))
    page, following = settings.PAGE_CHARS, settings.FOLLOWING_CHARS
    return x.withColumn("text", F.substring("_r.body", 1, page)).withColumn("following", F.substring("_r.body", page + 1, following)).withColumn("error", F.coalesce("_r.error", F.col("error"))).drop("_r")


def pack_texts(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Texts as a ZIP of files, the last of them in a ZIP inside; fixed times, so that equal texts give equal bytes."""

    def zipped(files: list[tuple[str, bytes]]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in files:
                z.writestr(zipfile.ZipInfo(name, (2026, 1, 1, 0, 0, 0)), data)
        return out.getvalue()

    files = [(f"{i}.bin", (t or "").encode()) for i, t in sorted(zip(group["doc_id"], group["text"], strict=True))]
    inner = zipped(files[-1:])
    return pd.DataFrame({"archive": [key[0]], "content": [zipped([*files[:-1], ("inner.zip", inner), ("__MACOSX/x", b""), ("thumbs.db", b"x")])]})
