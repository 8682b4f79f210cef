"""HTTP inside a reader task: paced for each host, with retries; and a client that replays recorded responses."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from urllib.parse import urlparse

from noticeloom import settings
from noticeloom.functions.patterns import PDF_TYPES


class HttpError(Exception):
    """Final: asking again doesn't help."""


class TemporaryHttpError(HttpError):
    """Network errors, 429, 5xx, an unexpected type, or a body that isn't what the response says."""


@dataclass
class Answer:
    status: int
    body: bytes
    headers: dict[str, str] = field(default_factory=dict)
    url: str = ""


def inconsistent(body: bytes, kind: str, urls: tuple[str, ...], asked: tuple[str, ...]) -> str | None:
    head = body[:1024].decode("latin-1")
    if "text/html" not in asked and re.match(r"\s*<(!doctype html|html|head|body)\b", head, re.I):
        return "an HTML page instead of the content (too many requests?)"
    if (kind in PDF_TYPES or any(urlparse(u).path.lower().endswith(".pdf") for u in urls if u)) and "%PDF" not in head:
        return "the body is no PDF"
    return None


def urllib_fetch(url: str) -> Answer:
    request = urllib.request.Request(url, headers={"User-Agent": "noticeloom"})  # noqa: S310
    try:
        with urllib.request.urlopen(request, timeout=settings.HTTP_TIMEOUT_S) as r:  # noqa: S310
            return Answer(r.status, r.read(), {k.lower(): v for k, v in r.headers.items()}, r.url)
    except urllib.error.HTTPError as e:
        return Answer(e.code, b"", {k.lower(): v for k, v in e.headers.items()}, url)
    except OSError as e:
        raise TemporaryHttpError(str(e)) from e


class PacedClient:
    """Requests to a host start a second apart at least; a temporary error is tried again, with doubling waits."""

    def __init__(self, fetch=urllib_fetch, sleep=time.sleep, clock=time.monotonic):
        self.fetch, self.sleep, self.clock, self.last = fetch, sleep, clock, {}

    def _once(self, url: str, types: tuple[str, ...]) -> Answer:
        host = urlparse(url).netloc
        if host in self.last and (wait := self.last[host] + settings.HTTP_SPACING_S - self.clock()) > 0:
            self.sleep(wait)
        self.last[host] = self.clock()
        answer = self.fetch(url)
        if answer.status == 429 or answer.status >= 500:
            raise TemporaryHttpError(f"{answer.status} from {url}")
        if answer.status >= 400:
            raise HttpError(f"{answer.status} from {url}")
        kind = answer.headers.get("content-type", "").split(";")[0].strip().lower()
        if types and kind not in types:
            raise TemporaryHttpError(f"content type {kind or 'missing'} from {url}")
        if why := inconsistent(answer.body, kind, (url, answer.url), types):
            raise TemporaryHttpError(f"{why}: {url}")
        return answer

    def get(self, url: str, types: tuple[str, ...] = ()) -> Answer:
        wait = settings.HTTP_BACKOFF_S
        for attempt in range(settings.HTTP_ATTEMPTS):
            try:
                return self._once(url, types)
            except TemporaryHttpError:
                if attempt + 1 == settings.HTTP_ATTEMPTS:
                    raise
                self.sleep(wait)
                wait *= 2
        raise AssertionError


class RecordedClient:
    """Responses from a JSON file of ``url, stato, intestazioni, corpo``; any other address fails."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.answers = {x["url"]: Answer(x["stato"], x["corpo"].encode(), {k.lower(): v for k, v in x["intestazioni"].items()}, x["url"]) for x in json.load(f)}

    def get(self, url: str, types: tuple[str, ...] = ()) -> Answer:
        if url not in self.answers:
            raise HttpError(f"not recorded: {url}")
        return self.answers[url]
