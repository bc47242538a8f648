"""Fetching files over HTTP: the ingestion edge, plain Python run once per file.

Every attempt becomes a row of the transfer log, from which routing, circuit and window
decisions are computed as tables. Payloads are written beside their target and put in
place whole; a partial payload resumes with Range and If-Range.
"""

from __future__ import annotations

import hashlib
import http.client
import json
import os
import re
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import asdict, dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.operators.scope import positions
from docketlake.session import checkpoint
from docketlake.sources.office import decode_text, opened
from docketlake.sources.routing import join_mirror
from docketlake.streaming.window import STREAK

CHUNK = 256 * 1024
TIMEOUT = 45
LOG_SCHEMA = (
    "source string, state string, path string, sha256 string, body_bytes long, resumed_bytes long, etag string, last_modified string, "
    "http_status int, retry_count int, download_seconds double, pressure boolean, error string, effective string, fallback_reason string"
)
LOCK_WAIT, LOCK_STALE = 60.0, 900.0  # seconds
WAVES = 200  # a fetch of any size adapts its width about so many times


@dataclass(frozen=True)
class Route:
    """How addresses are fetched: public hosts that a mirror stands for, the mirror (an address or a folder), and how to ask."""

    public_hosts: tuple[str, ...] = ()
    mirror: str | None = None
    retries: int = 3
    refresh: bool = False
    agent: str = "docketlake/1"
    referer: str | None = None
    wait: float = 1.0  # times the pauses between attempts


class Router:
    """The places of a source in the order to try them; a host that failed is left for its mirror by all later sources of the task."""

    def __init__(self, route: Route):
        self.route = route
        self.down: set[str] = set()

    def mirrored(self, source: str) -> list[str]:
        parts = urlsplit(source)
        if not self.route.mirror or (parts.hostname or "").lower() not in {h.lower() for h in self.route.public_hosts}:
            return []
        below = dict.fromkeys((parts.path, re.sub("(?i)^/ftp/", "/", parts.path)))
        return [join_mirror(self.route.mirror, p) for p in below]

    def candidates(self, source: str) -> list[str]:
        below = self.mirrored(source)
        return below if below and urlsplit(source).hostname in self.down else [source, *below]

    def failed(self, source: str, t: Transfer) -> None:
        if t.http_status is None or t.http_status in (401, 403, 407, 429) or t.http_status >= 500:
            self.down.add(urlsplit(source).hostname)


@contextmanager
def locked(home: str, sleep: Callable[[float], None] = time.sleep):
    """One writer for a payload: a lock file, waited for up to LOCK_WAIT, taken over when older than LOCK_STALE."""
    name, until = os.path.join(home, "lock"), time.monotonic() + LOCK_WAIT
    while True:
        try:
            os.close(os.open(name, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            try:
                if time.time() - os.path.getmtime(name) > LOCK_STALE:
                    os.remove(name)
                    continue
            except FileNotFoundError:
                continue
            if time.monotonic() > until:
                raise TimeoutError(f"payload is being written elsewhere: {home}") from None
            sleep(0.1)
    try:
        yield
    finally:
        with suppress(FileNotFoundError):
            os.remove(name)


@dataclass
class Transfer:
    source: str
    state: str = "fetch_error"
    path: str | None = None
    sha256: str | None = None
    body_bytes: int = 0
    resumed_bytes: int = 0
    etag: str | None = None
    last_modified: str | None = None
    http_status: int | None = None
    retry_count: int = 0
    download_seconds: float = 0.0
    pressure: bool = False
    error: str | None = None
    effective: str | None = None
    fallback_reason: str | None = None


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _intact_zip(path: str) -> bool:
    try:
        with zipfile.ZipFile(path) as z:
            return z.testzip() is None
    except (zipfile.BadZipFile, OSError):
        return False


def _meta(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}


def fetch(source: str, folder: str, retries: int = 3, refresh: bool = False, sleep: Callable[[float], None] = time.sleep, headers: dict[str, str] | None = None) -> Transfer:
    """One file into folder/<key>/payload; a payload that is unchanged on the server is not sent again."""
    home = os.path.join(folder, hashlib.sha256(source.encode()).hexdigest())
    os.makedirs(home, exist_ok=True)
    if "://" not in source:
        return _copied(source, home)
    try:
        with locked(home):
            return _fetched(source, home, retries, refresh, sleep, headers or {})
    except TimeoutError as e:
        return Transfer(source, error=type(e).__name__, effective=source)


def _copied(source: str, home: str) -> Transfer:
    """A file of a mirror that is a folder stays where it is."""
    t = Transfer(source, effective=source)
    if os.path.isfile(source):
        t.state, t.path, t.sha256, t.body_bytes = "local", source, file_sha256(source), os.path.getsize(source)
    else:
        t.error, t.http_status = "FileNotFoundError", 404
    return t


def _fetched(source: str, home: str, retries: int, refresh: bool, sleep: Callable[[float], None], own: dict[str, str]) -> Transfer:
    t, began = Transfer(source, effective=source), time.monotonic()
    payload, partial, meta_path = (os.path.join(home, n) for n in ("payload", "partial", "meta.json"))
    kept = _meta(meta_path) if os.path.exists(payload) else {}
    if kept and file_sha256(payload) != kept.get("sha256"):
        kept = {}
    for attempt in range(retries + 1):
        t.retry_count = attempt
        headers = dict(own)
        have = os.path.getsize(partial) if os.path.exists(partial) else 0
        tag = _meta(partial + ".json").get("etag")
        if have and tag:
            headers |= {"Range": f"bytes={have}-", "If-Range": tag}
        elif kept and not refresh:
            headers |= {k: kept[v] for k, v in (("If-None-Match", "etag"), ("If-Modified-Since", "last_modified")) if kept.get(v)}
        try:
            with urllib.request.urlopen(urllib.request.Request(source, headers=headers), timeout=TIMEOUT) as r:
                t.http_status, t.etag, t.last_modified = r.status, r.headers.get("ETag"), r.headers.get("Last-Modified")
                resumed = r.status == 206
                if not resumed:
                    have = 0
                with open(partial + ".json", "w", encoding="utf-8") as f:
                    json.dump({"etag": t.etag}, f)
                got = 0
                with open(partial, "ab" if resumed else "wb") as f:
                    while block := r.read(CHUNK):
                        f.write(block)
                        got += len(block)
                        t.body_bytes += len(block)
                expected = r.headers.get("Content-Length")
                if expected is not None and got < int(expected):
                    raise http.client.IncompleteRead(b"", int(expected) - got)
                t.resumed_bytes = have
            if source.lower().endswith(".zip") and not _intact_zip(partial):
                os.remove(partial)
                raise OSError("broken archive")
            t.sha256 = file_sha256(partial)
            os.replace(partial, payload)
            with open(meta_path, "w", encoding="utf-8") as f:
                json.dump({"sha256": t.sha256, "etag": t.etag, "last_modified": t.last_modified}, f)
            t.state, t.path, t.error = ("resumed_complete" if have else "downloaded"), payload, None
            break
        except urllib.error.HTTPError as e:
            t.http_status = e.code
            if e.code == 304 and kept:
                t.state, t.path, t.sha256, t.error = "cached", payload, kept["sha256"], None
                break
            if e.code == 416 and os.path.exists(partial):
                os.remove(partial)
            t.pressure |= e.code in (403, 429) or e.code >= 500
            t.error = f"HTTP {e.code}"
            if e.code in (401, 404, 407, 410):
                break
            wait = e.headers.get("Retry-After", "")
        except (OSError, http.client.HTTPException) as e:
            t.pressure, t.error, wait = True, f"{type(e).__name__}", ""
        if attempt < retries:
            sleep(float(wait) if wait.isdigit() else 2.0**attempt)
    if t.state == "fetch_error" and kept and not refresh:
        t.state, t.path, t.sha256 = "cached", payload, kept["sha256"]  # the stale payload still has its hash
    t.download_seconds = time.monotonic() - began
    return t


def fetch_first(candidates: list[str], folder: str, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[Transfer, list[Transfer]]:
    """The first candidate that succeeds, and the log of all that were tried; the last failure if none does."""
    log: list[Transfer] = []
    for source in candidates:
        log.append(fetch(source, folder, retries, sleep=sleep))
        if log[-1].state != "fetch_error":
            break
    if not log:
        raise ValueError("no candidate")
    return log[-1], log


def routed(source: str, folder: str, router: Router, sleep: Callable[[float], None] = time.sleep) -> Transfer:
    """A source by its places in turn; a failed host opens the circuit for the sources after it."""
    route = router.route
    headers = {"User-Agent": route.agent} | ({"Referer": route.referer} if route.referer else {})
    last, reason = Transfer(source, error="no place"), None
    for place in router.candidates(source):
        last = fetch(place, folder, route.retries, route.refresh, lambda s: sleep(s * route.wait), headers)
        if last.state != "fetch_error":
            break
        reason = reason or last.error
        if place == source:
            router.failed(source, last)
    last.source = source
    if last.state != "fetch_error" and last.effective != source:
        last.fallback_reason = reason or "circuit_open"
    return last


def fetch_all(tasks: DataFrame, folder: str, concurrency: int, route: Route = Route()) -> DataFrame:
    """The transfer log of tasks (source); ``concurrency`` partitions fetch at a time, folder is shared by all executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        router = Router(route)
        for pdf in batches:
            yield pd.DataFrame([asdict(routed(s, folder, router)) for s in pdf["source"]], columns=[c.split()[0] for c in LOG_SCHEMA.split(", ")])

    return tasks.select("source").where("source is not null").distinct().repartition(concurrency).mapInPandas(run, LOG_SCHEMA)


def fetch_adaptive(tasks: DataFrame, folder: str, route: Route = Route(), most: int = 4) -> DataFrame:
    """The transfer log of tasks (source), with ``width``: fetched in waves, whose width halves after pressure or a failure and grows by one, up to ``most``, after a wave without."""
    todo = checkpoint(positions(tasks.select("source").where("source is not null").distinct(), ["source"]))
    n, at, width, log = todo.count(), 0, most, None
    while at < n or log is None:
        size = max(width * STREAK, -(-n // WAVES))
        wave = todo.where((F.col("position") >= at) & (F.col("position") < at + size))
        done = checkpoint(fetch_all(wave, folder, width, route).withColumn("width", F.lit(width)))
        log = done if log is None else log.unionByName(done)
        bad = done.where("pressure or state = 'fetch_error'").count()
        width = max(1, width // 2) if bad else min(most, width + 1)
        at += size
    return log


def page_reader(folder: str, route: Route = Route(), concurrency: int = 4) -> Callable[[DataFrame], DataFrame]:
    """What links.crawl asks for: directories (url) to pages (url, html); a page that cannot be read is null."""

    def read(level: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            router = Router(route)
            for pdf in batches:
                pages = []
                for url in pdf["url"]:
                    t = routed(url, folder, router)
                    pages.append((url, decode_text(opened(t.path)) if t.path else None, t.error))
                yield pd.DataFrame(pages, columns=["url", "html", "error"])

        return checkpoint(level.select("url").repartition(concurrency).mapInPandas(run, "url string, html string, error string"))

    return read
