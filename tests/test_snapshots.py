"""Versioned tables, batches that are applied once, streams that survive a restart, and the keyword index on them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import batches, keyword_index, search
from orrery.sources.snapshots import Conflict, Snapshots, added, latest
from orrery.streaming import sinks

SHAPE = "id long, day int, v string"


def table(spark, path, **options):
    return Snapshots(spark, f"file://{path}/t", SHAPE, ["id"], **{"blocks": 4, **options})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_batch_takes_effect_once(spark, tmp_path):
    t, merge = table(spark, tmp_path), latest(["id"], "day")
    one = spark.createDataFrame([(i, 1, "a") for i in range(20)] + [(None, 1, "n")], SHAPE)
    two = spark.createDataFrame([(3, 2, "b"), (4, 0, "old"), (5, 1, "same day"), (99, 1, None)], SHAPE)
    assert t.read().count() == 0 and t.version() == 0 and not t.applied("one")
    assert t.apply("one", one, merge) and not t.apply("one", two, merge) and t.apply("two", two, merge) and not t.apply("two", two, merge)
    got = {r.id: (r.day, r.v) for r in t.read().collect()}
    assert len(got) == 22 and (got[3], got[4], got[5], got[99], got[None]) == ((2, "b"), (1, "a"), (1, "same day"), (1, None), (1, "n"))
    assert t.version() == 2 and t.read(version=1).count() == 21 and t.entry()["batch"] == "two"
    assert t.apply("none", one.limit(0), merge) and t.version() == 3 and t.read().count() == 22
    assert t.clean() >= 0 and t.read().count() == 22


def test_a_killed_writer_leaves_no_trace(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    rows = spark.createDataFrame([(i, 1, "a") for i in range(9)], SHAPE)
    t.apply("one", rows, added)
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(Snapshots, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        t.apply("two", rows, added)
    assert t.version() == 1 and t.read().count() == 9
    assert t.apply("two", rows, added) and t.read().count() == 18
    assert t.clean() > 0 and t.clean() == 0 and t.read().count() == 18


def test_two_writers(spark, tmp_path):
    """The loser of a race keeps its files if other blocks changed, and starts again from the new rows if its own did."""
    t = table(spark, tmp_path, blocks=64)
    block = {r.id: r.b for r in spark.range(50).select("id", t.block.alias("b")).collect()}
    row = lambda i, v: spark.createDataFrame([(i, 1, v)], SHAPE)
    t.apply("base", row(0, "base"), added)
    other = next(i for i in block if block[i] != block[0])
    once = []

    def meanwhile(i):
        def merge(old, new):
            if not once:
                once.append(1)
                table(spark, tmp_path, blocks=64).apply(f"rival {i}", row(i, "rival"), added)
            return added(old, new)

        return merge

    assert t.apply("mine", row(0, "mine"), meanwhile(other)) and t.version() == 3
    once.clear()
    assert t.apply("again", row(0, "again"), meanwhile(0)) and t.version() == 5
    assert rows_of(t.read().select("id", "v")) == sorted([(0, "again"), (0, "base"), (0, "mine"), (0, "rival"), (other, "rival")], key=str)
    with pytest.raises(Conflict):
        t.apply("never", row(0, "x"), lambda old, new: table(spark, tmp_path, blocks=64).apply(str(random.random()), row(0, "y"), added) and added(old, new), tries=2)


def test_only_named_blocks_are_listed(spark, tmp_path):
    t = table(spark, tmp_path, blocks=16)
    t.apply("all", spark.range(400).select("id", F.lit(1).alias("day"), F.lit("x").alias("v")), added)
    some = t.read(blocks=[2, 3])
    assert {f.split("_block=")[1].split("/")[0] for f in some.inputFiles()} == {"2", "3"} and some.select(t.block.alias("b")).distinct().count() == 2


def test_submit_stays_within_the_budget(spark, tmp_path):
    state = batches.request_state(spark, f"file://{tmp_path}/s", blocks=3)
    state.apply("enqueue", spark.createDataFrame([(i, "pending", i % 2, 1) for i in range(10)], batches.STATE), batches.MERGE)
    assert batches.submit(state, "s", 2, F.lit(3), 10) and not batches.submit(state, "s", 2, F.lit(3), 1000)
    assert sorted(r.key for r in state.read().filter("status = 'submitted'").collect()) == [0, 2, 4]
    assert batches.submit(state, "poor", 3, F.lit(3), 2) and state.read().filter("status = 'submitted'").count() == 3


def test_stream_is_exactly_once_over_a_restart(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(i, k, f"v{k}") for i in range(5)] + [(100 + k, k, None)], SHAPE).coalesce(1).write.mode("append").parquet(source)
    good, dead = table(spark, tmp_path), Snapshots(spark, f"file://{tmp_path}/dead", "raw string, batch long", ["raw"], 2)
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(source)

    def run():
        sinks.upsert_sink(stream, good, latest(["id"], "day"), "obs", str(tmp_path / "check"), F.col("v").isNotNull(), dead).trigger(availableNow=True).start().awaitTermination(300)

    put, calls = Snapshots.apply, []

    def dies(self, batch, *a, **k):  # after the good rows of the second batch are in, before its dead rows and the checkpoint are
        calls.append(batch)
        if len(calls) == 4:
            raise RuntimeError("killed")
        return put(self, batch, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "apply", dies)
        with pytest.raises(Exception, match="killed"):
            run()
    assert (good.version(), dead.version()) == (2, 1)
    run()
    run()
    assert (good.version(), dead.version()) == (3, 3)
    assert rows_of(good.read()) == sorted([(i, 2, "v2") for i in range(5)], key=str)
    assert sorted(r.raw for r in dead.read().collect()) == [f'{{"id":{100 + k},"day":{k}}}' for k in range(3)]


def scanned(df):
    """Rows that leave the file scans of an executed query."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan]
    while stack:
        p = stack.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(p.plan())
        if name == "FileSourceScanExec":
            total += p.metrics().apply("numOutputRows").value()
        stack += [p.children().apply(k) for k in range(p.children().size())]
    return total


def test_index_equals_the_scan_and_opens_little(spark, tmp_path):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5))) for _ in range(3000)]
    body = lambda: " ".join(vocab[min(int(rng.expovariate(0.004)), 2999)] for _ in range(rng.randint(0, 60)))
    rows = [(i, body()) for i in range(600)] + [(700, None), (701, ""), (702, "Zebra zebra! zebras, ZEBRA-zebu"), (703, "zebra " * 3)]
    docs = spark.createDataFrame(rows, "id long, body string")
    index = keyword_index.KeywordIndex(spark, f"file://{tmp_path}/k", blocks=16)
    assert index.upsert("one", docs) and not index.upsert("one", docs.limit(3))
    for text in ("zeb", "a", "ab cde", vocab[0], "zebra zebu", "nothing-here xyz", "!?"):
        assert rows_of(index.search(text, 10)) == rows_of(search.bm25(docs, text, 10)), text
    index.search("zebra zebu", 2)
    assert len(index.opened) <= 2  # of 16 blocks
    hit, every = index.matching(["zebra"]), index.lists.read()
    assert hit.collect() and every.collect() and scanned(hit) <= scanned(every)
    changed = spark.createDataFrame([(1, "zebra crossing"), (702, "gone"), (999, "new zebra")], "id long, body string")
    before = index.lists.entry()["files"]
    assert index.upsert("two", changed) and not index.upsert("two", changed)
    after = index.lists.entry()["files"]
    assert 1 <= sum(before.get(b) != after[b] for b in after) <= 3  # only the touched blocks were rebuilt
    now = docs.filter("id NOT IN (1, 702)").unionByName(changed)
    for text in ("zeb", "cross new", "a"):
        assert rows_of(index.search(text, 10)) == rows_of(search.bm25(now, text, 10)), text


def test_an_upsert_that_died_between_its_tables_goes_on(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} all") for i in range(30)], "id long, body string")
    index = keyword_index.KeywordIndex(spark, f"file://{tmp_path}/k", blocks=4)
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(keyword_index, "postings", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        index.upsert("one", docs)
    assert index.docs.version() == 1 and index.lists.version() == 0
    assert index.upsert("one", docs) and index.search("all", 50).count() == 30
