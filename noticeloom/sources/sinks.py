"""Where messages go. A sink takes a message and returns once it is accepted; the ledger is written after that."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class Sink(Protocol):
    """``claim`` names a message; a sink that has accepted it says so, whoever asks, so that nobody sends it again."""

    def send(self, email: str, variant: str | None, subject: str, text: str, html: str, claim: str | None = None) -> None: ...

    def accepted(self, claim: str) -> bool: ...


def file_name(email: str) -> str:
    return re.sub(r"^\.+", "_", re.sub(r"[^a-z0-9@._+-]", "_", email.lower()))


class FileSink:
    """A ``.html`` and a ``.txt`` file, the latter with the subject on top. ``accepted/CLAIM`` is the receipt, written last."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def accepted(self, claim):
        return os.path.exists(os.path.join(self.folder, "accepted", claim))

    def send(self, email, variant, subject, text, html, claim=None):
        stem = os.path.join(self.folder, file_name(email) + (f".{variant}" if variant else ""))
        for ending, body in ((".html", html), (".txt", f"{subject}\n\n{text}")):
            with open(stem + ending, "w", encoding="utf-8") as f:
                f.write(body)
        if claim:
            os.makedirs(os.path.join(self.folder, "accepted"), exist_ok=True)
            open(os.path.join(self.folder, "accepted", claim), "w").close()


class MemorySink:
    """For tests: keeps what it accepts; addresses in ``rejects`` fail."""

    def __init__(self, rejects: tuple[str, ...] = ()):
        self.sent, self.rejects, self.claims = [], rejects, set()

    def accepted(self, claim):
        return claim in self.claims

    def send(self, email, variant, subject, text, html, claim=None):
        if email in self.rejects:
            raise ConnectionError(f"rejected: {email}")
        self.sent.append((email, variant, subject))
        if claim:
            self.claims.add(claim)


class MessageSink(DataSource):
    """``df.write.format("messages").option("path", folder)``: messages as files, written by the tasks.

    With a column ``claim`` a message that was accepted before isn't sent again, be it by a task that is repeated or another run.
    ``_delivered.json`` says how many each task sent and found accepted, ``_aborted.json`` the same of a job that failed.
    """

    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in ("email", "variant", "subject", "text", "html", "claim")])

    def writer(self, schema, overwrite) -> MessageWriter:
        return MessageWriter(self.options["path"])


@dataclass
class Delivered(WriterCommitMessage):
    sent: int
    before: int


class MessageWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        sink, sent, before = FileSink(self.path), 0, 0
        for r in rows:
            claim = r["claim"] if "claim" in r else None
            if claim and sink.accepted(claim):
                before += 1
            else:
                sink.send(r["email"], r["variant"], r["subject"], r["text"], r["html"], claim)
                sent += 1
        return Delivered(sent, before)

    def _told(self, name: str, messages: list) -> None:
        with open(os.path.join(self.path, name), "w", encoding="utf-8") as f:
            json.dump([None if m is None else {"sent": m.sent, "accepted_before": m.before} for m in messages], f)

    def commit(self, messages: list) -> None:
        self._told("_delivered.json", messages)

    def abort(self, messages: list) -> None:
        self._told("_aborted.json", messages)
