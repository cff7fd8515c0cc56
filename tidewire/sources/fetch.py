"""Fetching as a Spark data source with a pluggable transport, and scans of files that earlier steps wrote.

``spark.dataSource.register(FeedSource)``, then ``spark.read.format("feeds").option("catalogue", json).option("transport",
"package.module:function").load()``: a partition for each ``per_task`` sources. A transport takes a source (dict) and
headers and returns the body; without one, nothing is fetched and each row says so. A failure is a row with an error.

A task asks up to ``workers`` sources at once and gives their rows in the catalogue's order; no more than ``AHEAD`` for each
worker are held. With ``rate`` (calls a second, second tries included) all sources of a host lie in one task, which spaces their calls by a bucket of
``burst`` tokens for each host: the limit holds over the cluster, and a host of many sources takes the time that its limit asks for.
With ``status`` (JSON by name, as health is kept) sources that it disables aren't asked: each gives a row that says so.

``spark.readStream`` of the same format fetches the catalogue once for each run, ``every`` seconds from ``start`` on. An offset counts
the runs that were due, and a batch is its last one: runs missed while the stream was down aren't made up for. A batch that
is repeated after a failure asks again but for the same run, with the same ``fetch_time``, so that a run's rows come once.
"""

from __future__ import annotations

import importlib
import json
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone
from functools import partial
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewire.operators.health import DISABLE_AT

from .parse import PLATFORMS
from .schemas import RAW_ITEMS, SOURCES
from .settings import secret

Transport = Callable[[dict, dict], str]
READER_AGENT = {"User-Agent": "FeedReader/1.0"}
# What platforms ask for besides the url, and seconds to wait for them
CODE_HOST = {"Accept": "application/vnd.github.v3+json"}
HEADERS = {"repo_search": CODE_HOST, "releases": CODE_HOST, "repo": CODE_HOST}
TIMEOUT, TIMEOUTS = 30, {"stix": 60}
UNKNOWN_PLATFORM = "未知 api_platform: "
#: Header, its form, and the name of the credential, which is sent if the environment holds it.
BEARER = ("Authorization", "Bearer {}", "GITHUB_TOKEN")
CREDENTIALS = {"scholar": ("x-api-key", "{}", "SCHOLAR_API_KEY"), "repo_search": BEARER, "releases": BEARER, "repo": BEARER}


def raw_row(source: dict, text: str = "", error: str | None = None, at: str | None = None) -> tuple:
    when = at or datetime.now(timezone.utc).replace(tzinfo=None).isoformat(timespec="seconds")
    return (source.get("name") or "", source.get("language") or "en", source.get("url") or "", source.get("type") or "rss", source.get("api_platform"), text, when, error)


def headers_of(platform: str) -> dict:
    headers = {**HEADERS.get(platform, {})}
    name, form, key = CREDENTIALS.get(platform, ("", "", ""))
    if name and (value := secret(key)):
        headers[name] = form.format(value)
    return headers


def fetch_one(source: dict, transport: Transport, at: str | None = None, platforms=()) -> tuple:
    """One source. Feeds that fail or come back empty are asked once more as a feed reader; APIs aren't.

    The transport finds the seconds to wait in the source's ``timeout``. An API of a platform that is neither built in nor
    among ``platforms`` is an error; one without a platform is asked plainly, unless its url has a place to be filled in (<).
    """
    platform = source.get("api_platform") or ""
    if source.get("type") == "api" and platform not in PLATFORMS and platform not in platforms and (platform or "<" in (source.get("url") or "")):
        return raw_row(source, "", UNKNOWN_PLATFORM + platform, at)
    headers = headers_of(platform)
    source = {"timeout": TIMEOUTS.get(platform, TIMEOUT), **source}
    try:
        text = transport(source, headers)
        if text or source.get("type") == "api":
            return raw_row(source, text, None, at)
    except Exception as e:  # noqa: BLE001  a failed fetch is a row
        if source.get("type") == "api" or source.get("ssl_verify") is False:
            return raw_row(source, "", f"{type(e).__name__}: {e}", at)
    try:
        return raw_row(source, transport(source, {**headers, **READER_AGENT}), None, at)
    except Exception as e:  # noqa: BLE001
        return raw_row(source, "", f"{type(e).__name__}: {e}", at)


def offline(source: dict, headers: dict) -> str:
    raise ConnectionError("no transport is set")


class Bucket:
    """Spaces calls: ``burst`` at once, then ``rate`` a second. Threads may share it."""

    def __init__(self, rate: float, burst: int = 1, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.slack, self.clock, self.sleep = 1 / rate, (burst - 1) / rate, clock, sleep
        self.due, self.lock = float("-inf"), threading.Lock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.due - self.slack)
            self.due = max(at, self.due) + self.gap
        if at > now:
            self.sleep(at - now)


def host_of(source: dict) -> str:
    try:
        return (urlsplit(source.get("url") or "").hostname or "").lower()
    except ValueError:  # a bracket that doesn't close
        return ""


def dealt(sources: list[dict], size: int, whole_hosts: bool) -> list[list[dict]]:
    """Parts of ``size`` sources in the catalogue's order; with ``whole_hosts`` a host isn't divided, and a part ends with the host that fills it."""
    if not whole_hosts:
        return [sources[k : k + size] for k in range(0, len(sources), size)]
    hosts: dict[str, list[dict]] = {}
    for s in sources:
        hosts.setdefault(host_of(s), []).append(s)
    parts: list[list[dict]] = []
    for group in hosts.values():
        if not parts or len(parts[-1]) + len(group) > size:
            parts.append([])
        parts[-1] += group
    return parts


def limited(transport: Transport, rate: float, burst: int = 1, **clock) -> Transport:
    """The transport with a bucket for each host."""
    buckets: dict[str, Bucket] = {}
    lock = threading.Lock()

    def call(source: dict, headers: dict) -> str:
        with lock:
            bucket = buckets.setdefault(host_of(source), Bucket(rate, burst, **clock))
        bucket.take()
        return transport(source, headers)

    return call


#: Sources in work or waiting to be given, for each worker.
AHEAD = 2


def in_order(work: Callable, sources: list[dict], workers: int) -> Iterator:
    """The results in the sources' order, up to ``workers`` at once."""
    if workers <= 1:
        yield from map(work, sources)
        return
    with ThreadPoolExecutor(workers) as pool:
        held: deque = deque()
        try:
            for s in sources:
                held.append(pool.submit(work, s))
                if len(held) >= AHEAD * workers:
                    yield held.popleft().result()
            while held:
                yield held.popleft().result()
        finally:
            for f in held:
                f.cancel()


def failures_of(source: dict, status: dict) -> int | None:
    """The failures for which a status disables the source, or None."""
    told = status.get(source.get("name") or "")
    fails = told.get("consecutive_failures") or 0 if isinstance(told, dict) else 0
    return fails if fails >= DISABLE_AT and not told.get("recovered") else None


class Part(InputPartition):
    def __init__(self, sources: list[dict], at: str | None = None):
        self.sources, self.at = sources, at


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.sources = json.loads(options.get("catalogue", "[]"))
        self.size = int(options.get("per_task", "8"))
        self.named, self.at = options.get("transport"), options.get("at")
        self.platforms = tuple(json.loads(options.get("platforms", "[]")))
        self.workers, self.rate, self.burst = int(options.get("workers", "4")), float(options.get("rate", "0")), int(options.get("burst", "1"))
        self.status = json.loads(options.get("status", "{}"))

    def parts(self, at: str | None) -> list[Part]:
        wanted = [s for s in self.sources if s.get("enabled", True)]
        return [Part(p, at) for p in dealt(wanted, self.size, self.rate > 0)] or [Part([], at)]

    def partitions(self) -> list[Part]:
        return self.parts(self.at)

    def one(self, transport: Transport, at: str | None, source: dict) -> tuple:
        fails = failures_of(source, self.status)
        return fetch_one(source, transport, at, self.platforms) if fails is None else raw_row(source, "", skipped_error(fails), at)

    def read(self, partition: Part) -> Iterator[tuple]:
        transport: Transport = offline
        if self.named:
            module, _, name = self.named.partition(":")
            transport = getattr(importlib.import_module(module), name)
        if self.rate > 0:
            transport = limited(transport, self.rate, self.burst)
        yield from in_order(partial(self.one, transport, partition.at), partition.sources, self.workers)


class FeedRuns(FeedReader, DataSourceStreamReader):
    """The catalogue once for each run that is due. Offsets: how many runs were due."""

    def __init__(self, options: dict):
        FeedReader.__init__(self, options)
        if "start" not in options:
            raise ValueError("a stream of feeds needs the option start, the first run's time (ISO, UTC)")
        self.start, self.every = datetime.fromisoformat(options["start"]), float(options.get("every", "3600"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"runs": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        past = (datetime.now(timezone.utc).replace(tzinfo=None) - self.start).total_seconds()
        return {"runs": max(0, int(past // self.every) + 1)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if end["runs"] <= start["runs"]:
            return [Part([])]
        at = self.start + timedelta(seconds=self.every * (end["runs"] - 1))
        return self.parts(at.isoformat(timespec="seconds"))

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""

    def stop(self) -> None:
        """Nothing stays open."""


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return RAW_ITEMS

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedRuns:  # noqa: N802
        return FeedRuns(self.options)


def skipped_error(failures: int) -> str:
    return f"auto_disabled: {failures} failures"


def skipped_rows(skipped: DataFrame) -> DataFrame:
    """Disabled sources as raw rows with an error. skipped: source columns and consecutive_failures."""
    return skipped.selectExpr(
        "name as source_name", "language", "url", "type", "api_platform", "'' as xml_text", "cast(null as string) as fetch_time",
        "concat('auto_disabled: ', consecutive_failures, ' failures') as error",
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The YAML catalogue of sources; of repeated keys the last counts. Read by Spark, so that any of its stores will do."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    listed = yaml.safe_load(text) or []
    rows = listed.get("sources", []) if isinstance(listed, dict) else listed
    bodies = spark.createDataFrame([(json.dumps(r),) for r in rows], "body string")
    return bodies.select(F.from_json("body", SOURCES).alias("s")).select("s.*")


def read_items(spark: SparkSession, *paths: str, schema: str) -> DataFrame:
    """The first of the paths that exists: a JSON array, as earlier steps write it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return spark.createDataFrame([], schema)
