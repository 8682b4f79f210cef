"""Reading document bodies: hash, format, text of page 1, subject region, following text, or why it can't be read.

Readers of PDF, scans and word-processor files are functions that can be replaced. Those of PDF and scans call tools of the
system (``pdftotext``, ``pdftoppm``, ``tesseract``) where they exist; where they don't, the document is a row that says so.
"""

from __future__ import annotations

import hashlib
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom import settings
from noticeloom.functions import patterns as P
from noticeloom.sources.archives import docx_text, members

READ = "key string, part int, name string, hash string, kind string, size long, text string, region string, following string, error string"
_SUBJECT = re.compile(P.SUBJECT_LINE)


def pdf_pages(body: bytes, first: int, last: int) -> str:
    if not shutil.which("pdftotext"):
        raise RuntimeError("pdftotext is not installed")
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "a.pdf")
        path.write_bytes(body)
        return subprocess.run(["pdftotext", "-layout", "-f", str(first), "-l", str(last), str(path), "-"], capture_output=True, check=True, text=True, timeout=120).stdout  # noqa: S603, S607


def scanned_page(body: bytes, page: int) -> str:
    if not (shutil.which("pdftoppm") and shutil.which("tesseract")):
        raise RuntimeError("pdftoppm or tesseract is not installed")
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "a.pdf")
        path.write_bytes(body)
        subprocess.run(["pdftoppm", "-r", "300", "-gray", "-png", "-f", str(page), "-l", str(page), str(path), f"{folder}/p"], check=True, timeout=120)  # noqa: S603, S607
        images = sorted(Path(folder).glob("p*.png"))
        return subprocess.run(["tesseract", str(images[0]), "-", "-l", "ita"], capture_output=True, check=True, text=True, timeout=300).stdout if images else ""  # noqa: S603, S607


def region(text: str) -> str | None:
    lines = text.split("\n")
    at = next((i for i, x in enumerate(lines) if _SUBJECT.search(x)), None)
    return None if at is None else "\n".join(lines[at : at + 1 + settings.SUBJECT_REGION_LINES]).rstrip()


def _first_line(e: Exception) -> str:
    return (str(e) or type(e).__name__).split("\n")[0]


def read_body(body: bytes, pdf: Callable = pdf_pages, scan: Callable = scanned_page, docx: Callable = docx_text) -> dict:
    """One document that is no archive."""

    def unreadable(why: str) -> dict:
        return {"text": None, "region": None, "following": None, "error": f"{P.UNREADABLE}: {why}"}

    if body.startswith(b"%PDF"):
        try:
            text = pdf(body, 1, 1)
        except Exception as e:  # noqa: BLE001  whatever is wrong with a file is a row
            return unreadable(f"broken PDF ({_first_line(e)})")
        if len(text.strip()) >= settings.LEAST_TEXT_CHARS:
            try:
                following = pdf(body, 2, settings.LAST_FOLLOWING_PAGE)
            except Exception:  # noqa: BLE001
                following = ""
        else:  # a scan
            try:
                text = scan(body, 1)
            except Exception as e:  # noqa: BLE001
                return unreadable(f"OCR failed ({_first_line(e)})")
            if len(text.strip()) < settings.LEAST_TEXT_CHARS:
                return unreadable("scan without text")
            try:
                following = scan(body, 2)
            except Exception:  # noqa: BLE001
                following = ""
        return {"text": text, "region": region(text) or region(following), "following": following[: settings.FOLLOWING_CHARS], "error": None}
    if body.startswith(b"PK"):
        try:
            text = docx(body)
        except KeyError:
            return unreadable("odt or another archive format")
        except Exception as e:  # noqa: BLE001
            return unreadable(f"broken DOCX ({_first_line(e)})")
        if len(text) < settings.LEAST_TEXT_CHARS:
            return unreadable("DOCX without text")
        page = settings.PAGE_CHARS
        return {"text": text[:page], "region": region(text), "following": text[page : page + settings.FOLLOWING_CHARS], "error": None}
    kind = "7z" if body.startswith(b"7z") else "rar" if body.startswith(b"Rar!") else "doc" if body.startswith(b"\xd0\xcf") else "sconosciuto"
    return unreadable(kind)


FETCHED = "url string, content binary, content_type string, error string"


def fetched(urls: DataFrame, replay: str | None = None, types: tuple[str, ...] = P.DOCUMENT_TYPES) -> DataFrame:
    """``url`` to its body and content type, or to why it can't be had. All addresses of a host are one task's, which paces its requests."""
    from noticeloom.sources.http import PacedClient, RecordedClient

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = RecordedClient(replay) if replay else PacedClient()
        for batch in batches:
            for url in batch["url"]:
                try:
                    answer = client.get(url, types)
                    row = (url, answer.body, answer.headers.get("content-type"), None)
                except Exception as e:  # noqa: BLE001  whatever is wrong with an address is a row
                    row = (url, None, None, _first_line(e))
                yield pd.DataFrame([row], columns=[c.split()[0] for c in FETCHED.split(", ")], dtype=object)

    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return urls.repartition(host).select("url").mapInPandas(run, FETCHED)


def read_documents(bodies: DataFrame, key: str, content: str, **readers: Callable) -> DataFrame:
    """A row a document, or a row a member of an archive (``part`` counts them). Equal bodies should be read once: drop duplicates by hash before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, body in zip(batch["key"], batch["content"], strict=True):
                for part, (name, data, error) in enumerate(members(bytes(body)) if body is not None else ()):
                    read = {"error": error} if data is None else read_body(data, **readers)
                    facts = {"hash": hashlib.sha256(data).hexdigest(), "size": len(data)} if data is not None else {}
                    ending = name.lower().rpartition(".")[2]
                    row = {"key": k, "part": part, "name": name, "kind": P.EXTENSION_TYPES.get(ending, "application/octet-stream")} | facts | read
                    yield pd.DataFrame([row], columns=[c.split()[0] for c in READ.split(", ")], dtype=object)

    return bodies.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content")).mapInPandas(run, READ)
