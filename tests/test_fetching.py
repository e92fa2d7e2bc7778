"""Polite fetching with a transport of known behaviour, and drains by host under a budget."""

from __future__ import annotations

import collections
import hashlib
import json
import sys

import pytest
from pyspark import cloudpickle

from orrery.operators import drains
from orrery.sources import fetching
from orrery.sources.snapshots import Snapshots

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Clock:
    def __init__(self):
        self.now = 100.0

    def sleep(self, seconds):
        assert seconds > 0
        self.now += seconds


def site(log, clock):
    """429 with Retry-After, 503 twice, an error that passes, one that stays, a redirect, a page."""
    seen = collections.Counter()

    def send(url):
        seen[url] += 1
        log.append((fetching.host_of(url), clock(), url))
        n, name = seen[url], url.rsplit("/", 1)[1]
        if name == "busy" and n == 1:
            return 429, {"retry-AFTER": "30"}, b"", url
        if name == "ill" and n <= 2:
            return 503, {"Retry-After": "soon"}, b"", url
        if name == "dead" or (name == "blip" and n == 1):
            raise ConnectionError("reset")
        if name == "gone":
            return 404, {}, b"no", url
        if name == "down":
            return 500, {}, b"err", url
        return 200, {}, b"same body", "https://www.other.in/x" if name == "moved" else url

    return send


def test_spacing_retries_and_outcomes():
    clock, log = Clock(), []
    urls = [f"https://{h}/{n}" for h in ("a.in", "www.b.in") for n in ("page", "busy", "ill", "dead", "blip", "gone", "down", "moved")]
    manners = fetching.Manners(clock=lambda: clock.now, sleep=clock.sleep)
    got = {r[0]: r for r in fetching.visit(iter(urls), site(log, lambda: clock.now), manners)}
    assert set(got) == set(urls)
    name = lambda n: got[f"https://a.in/{n}"]
    assert [name(n)[4:7] for n in ("page", "busy", "ill", "blip", "gone", "down")] == [(200, 1, None), (200, 2, None), (200, 3, None), (200, 2, None), (404, 1, None), (500, 4, None)]
    assert name("dead")[4:7] == (None, 4, "ConnectionError: reset") and name("moved")[3] == "other.in" and name("page")[3] is None
    assert name("page")[7] == hashlib.sha256(b"same body").hexdigest() and got["https://www.b.in/page"][1] == "b.in"
    for host in ("a.in", "b.in"):
        own = [(t, u) for h, t, u in log if h == host]
        assert all(b[0] - a[0] >= 2 for a, b in zip(own, own[1:], strict=False))
        busy = [t for t, u in own if u.endswith("busy")]
        ill = [t for t, u in own if u.endswith("ill")]
        assert busy[1] - busy[0] >= 30 and ill[1] - ill[0] >= 2 and ill[2] - ill[1] >= 2
    assert clock.now - 100 < 2 * 30 + 40  # the hosts' pauses overlap


def quick(url):
    import os

    return 200, {"pid": str(os.getpid())}, url.rsplit("/", 1)[1].encode(), url


def test_source_and_table_form(spark, tmp_path):
    urls = [f"https://h{k % 5}.in/{k % 3}" for k in range(30)] + ["https://h0.in/0"]
    manners = fetching.Manners(interval=0.0)
    spark.dataSource.register(fetching.source("fixture_site", quick, manners))
    df = spark.read.format("fixture_site").option("urls", json.dumps(urls)).load()
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 5 and {r.url for r in rows} == set(urls) and len(rows) == 15
    assert all(r.sha256 == hashlib.sha256(r.body).hexdigest() and r.attempts == 1 for r in rows)
    assert spark.read.format("fixture_site").load().collect() == []
    t = spark.createDataFrame([(u,) for u in urls] + [(None,)], "url string").repartition(7)
    again = fetching.fetched(t, quick, manners)
    assert sorted((r.url, r.sha256) for r in again.collect()) == sorted((r.url, r.sha256) for r in rows)
    store = Snapshots(spark, f"file://{tmp_path}/raw", fetching.CAPTURE, ["sha256"], 2)
    assert fetching.keep_captures(again, store, "a") and fetching.keep_captures(again, store, "b")
    assert sorted(r.body for r in store.read().collect()) == [b"0", b"1", b"2"]


@pytest.fixture()
def ledger(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/ledger", drains.LEDGER, ["id"], 2)


def test_hosts_stay_together_unless_salted(spark):
    from pyspark.sql import functions as F

    rows = [(i, "0", f"https://{h}/{i}") for i in range(200) for h in ("a.in", "cdn.b.in")] + [(999, "0", None)]
    t = spark.createDataFrame(rows, "id long, prompt string, url string")
    placed = t.select(drains.shard(F.col("url")).alias("host")).repartition(8, "host").select("host", F.spark_partition_id().alias("p")).distinct().collect()
    assert all(n == 1 for n in collections.Counter(r.host for r in placed).values())
    assert sum(r.host.startswith("cdn.b.in#") for r in placed) == 8 and {"a.in", ""} < {r.host for r in placed}


def test_spend_ends_within_a_round_and_quarantine_sticks(spark, ledger):
    todo = spark.createDataFrame([(i, "r" if i % 5 == 0 else "x" if i % 5 == 1 else "1", f"https://s{i % 3}.in/a") for i in range(100)], "id long, prompt string, url string")
    check = lambda a: a if int(a) > 0 else None
    assert drains.drain_within(todo, ledger, drains.numbered, check, budget=100, size=20) == 3
    spent = ledger.read().groupBy().sum("cost").first()[0]
    assert ledger.read().count() == 60 and 100 <= spent <= 100 + 20 * 4
    assert drains.drain_within(todo, ledger, drains.numbered, check, budget=100, size=20) == 0
    assert drains.drain_within(todo, ledger, drains.numbered, check, budget=10_000, size=50, again=("api_error", "quarantined")) == 2
    got = {r.id: r for r in ledger.read().collect()}
    assert len(got) == 100 and {r.status for r in got.values()} == {"quarantined", "api_error", "enriched"}
    assert all(r.attempts == 1 for r in got.values() if r.status == "quarantined") and got[1].reason == "down"
    assert got[2].attempts == 2 and got[2].cost == 4 and got[2].answer == "0"
