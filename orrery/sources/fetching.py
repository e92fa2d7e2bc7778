"""Polite fetching: one task owns a host, requests to it are spaced, and refusals are waited out.

What sends a request is injected: transport(url) gives (status, headers, body, final url) or raises. A task with many
hosts goes to whichever may be asked next, so that one host's pause holds up no other.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orrery.functions import web
from orrery.sources.snapshots import Snapshots

Transport = Callable[[str], tuple[int, dict[str, str], bytes, str]]
SCHEMA = "url string, host string, final_url string, redirected_host string, status int, attempts int, error string, sha256 string, body binary"
#: Answers that are worth another try.
AGAIN = (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Manners:
    """Seconds between requests to a host, tries after the first one, seconds before the first of them (then doubled)."""

    interval: float = 2.0
    retries: int = 3
    backoff: float = 1.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep


def host_of(url: str) -> str:
    return (urlsplit(url).hostname or "").removeprefix("www.")


def _pause(headers: dict[str, str], usual: float) -> float:
    """Seconds that Retry-After asks for, if it does so in seconds."""
    asked = next((v for k, v in headers.items() if k.lower() == "retry-after"), None)
    try:
        return max(0.0, float(asked))
    except (TypeError, ValueError):
        return usual


def visit(urls: Iterator[str], transport: Transport, manners: Manners) -> Iterator[tuple]:
    """Rows of SCHEMA, in the order in which they are done."""
    waiting: dict[str, list[tuple[str, int]]] = {}
    for u in urls:
        waiting.setdefault(host_of(u), []).append((u, 0))
    for queue in waiting.values():
        queue.reverse()
    turns = [(0.0, h) for h in sorted(waiting)]
    while turns:
        ready, host = heapq.heappop(turns)
        if (early := ready - manners.clock()) > 0:
            manners.sleep(early)
        url, tried = waiting[host].pop()
        began = manners.clock()
        pause, more = manners.interval, tried < manners.retries
        try:
            status, headers, body, final = transport(url)
        except Exception as error:  # noqa: BLE001 - whatever a transport raises is the request's outcome
            if more:
                pause = max(pause, manners.backoff * 2**tried)
            else:
                yield url, host, None, None, None, tried + 1, f"{type(error).__name__}: {error}", None, None
        else:
            more = more and status in AGAIN
            if more:
                pause = max(pause, _pause(headers, manners.backoff * 2**tried))
            else:
                other = host_of(final)
                yield url, host, final, other if other and other != host else None, status, tried + 1, None, hashlib.sha256(body).hexdigest(), body
        if more:
            waiting[host].append((url, tried + 1))
        if waiting[host]:
            heapq.heappush(turns, (began + pause, host))


def _batch(rows: Sequence[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(),) * 4 + (pa.int32(),) * 2 + (pa.string(),) * 2 + (pa.binary(),)
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def fetched(requests: DataFrame, transport: Transport, manners: Manners = Manners(), rows: int = 64) -> DataFrame:
    """SCHEMA of requests (url): every host is in one task, wherever its rows came from. Null urls are left out, equal ones asked once.

    A task that is run again asks again; keep_captures() stores what came once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for row in visit((u for b in batches for u in b.column("url").to_pylist()), transport, manners):
            got.append(row)
            if len(got) == rows:
                yield _batch(got)
                got = []
        if got:
            yield _batch(got)

    one = requests.select("url").dropna().distinct().withColumn("host", web.domain(F.col("url")))
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return one.repartition(parts, "host").sortWithinPartitions("host", "url").select("url").mapInArrow(run, SCHEMA)


@dataclass
class Host(InputPartition):
    urls: tuple[str, ...]


class Polite(DataSource):
    """spark.read.format(...) over a list of urls, a partition for each host. Option urls: a JSON list, for a run's request list.

    Subclasses from source() carry the transport; tables of urls go through fetched().
    """

    transport: Transport
    manners = Manners()
    title = "polite"

    @classmethod
    def name(cls) -> str:
        return cls.title

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002 - Spark's signature
        own = type(self)
        manners = Manners(float(self.options.get("interval", own.manners.interval)), int(self.options.get("retries", own.manners.retries)), float(self.options.get("backoff", own.manners.backoff)), own.manners.clock, own.manners.sleep)
        return _Reader(json.loads(self.options.get("urls", "[]")), own.transport, manners)


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], transport: Transport, manners: Manners):
        self.urls, self.transport, self.manners = urls, transport, manners

    def partitions(self) -> Sequence[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for u in dict.fromkeys(self.urls):
            hosts.setdefault(host_of(u), []).append(u)
        return [Host(tuple(x)) for x in hosts.values()] or [Host(())]

    def read(self, partition: Host) -> Iterator[pa.RecordBatch]:
        for row in visit(iter(partition.urls), self.transport, self.manners):
            yield _batch([row])


def source(title: str, transport: Transport, manners: Manners = Manners()) -> type[Polite]:
    """A data source to register: spark.dataSource.register(source("shop", send))."""
    return type("PoliteSource", (Polite,), {"title": title, "transport": staticmethod(transport), "manners": manners})


CAPTURE = "sha256 string, body binary"


def keep_captures(pages: DataFrame, captures: Snapshots, batch: str) -> bool:
    """Bodies of fetched pages under their sha256, each once however often it came. captures has the schema CAPTURE and the key sha256."""
    fresh = pages.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.any_value("body").alias("body"))
    return captures.apply(batch, fresh, lambda old, new: old.unionByName(new.join(old.select("sha256"), "sha256", "left_anti")))
