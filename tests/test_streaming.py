"""Streams against their batch twins."""

from __future__ import annotations

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orrery.streaming import live

SF = Path("/root/testdata/sf0.001")


def finish(df, name: str, mode: str):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_demand_windows(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    stream = live.demand_windows(live.read_events(spark, str(SF), batch.schema))
    got = {(r.start, r.event_type): r.n for r in finish(stream, "demand", "complete").collect()}
    want = batch.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day")["start"].alias("start"), "event_type").count()
    assert got == {(r.start, r.event_type): r["count"] for r in want.collect()}


def observations(spark, path):
    rows = [(1, "2024-01-01 00:00:00", 5.0), (1, "2024-01-03 00:00:00", 7.0), (1, "2024-01-02 00:00:00", 9.0), (2, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:00", 5.0)]
    df = spark.createDataFrame(rows, "product_id long, at string, price double").select("product_id", F.col("at").cast("timestamp").alias("ts"), "price")
    df.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_first_seen(spark, tmp_path):
    out = finish(live.first_seen(observations(spark, tmp_path / "o"), ["product_id", "price"]), "seen", "append")
    assert out.count() == 4


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a state with an end would keep the query awake
    yield
    spark.conf.unset(name)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_job_states(spark, tmp_path, rocks):
    moves = [(1, 1, "enqueue"), (1, 2, "claim"), (1, 3, "fail"), (1, 4, "complete"), (1, 5, "claim"), (1, 6, "fail"), (1, 7, "retry"), (2, 1, "enqueue"), (2, 2, "enqueue"), (2, 3, "claim"), (2, 4, "complete")]
    df = spark.createDataFrame(moves, "id long, n int, event string").select("id", F.timestamp_seconds("n").alias("at"), "event", F.lit(2).alias("max_attempts"))
    df.coalesce(1).write.parquet(str(tmp_path / "m"))
    out = finish(live.job_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "m"))), "jobs", "update")
    got = [(r.id, r.status, r.attempts) for r in out.orderBy("id", "at").collect()]
    assert got == [(1, "pending", 0), (1, "running", 0), (1, "pending", 1), (1, "running", 1), (1, "failed", 2), (1, "pending", 0), (2, "pending", 0), (2, "running", 0), (2, "done", 0)]


def test_freshest_state(spark, tmp_path, rocks):
    out = finish(live.freshest_state(observations(spark, tmp_path / "o")), "fresh", "update")
    assert {(r.product_id, r.price) for r in out.collect()} == {(1, 7.0), (2, 1.0)}


def visits(spark, path, files):
    """A stream with one file per micro-batch, in the given order."""
    frames = [spark.createDataFrame(rows, "event_id long, user_id long, at string").select("event_id", "user_id", F.to_timestamp("at").alias("ts")) for rows in files]
    seen, base = set(), time.time() - 1000
    for k, f in enumerate(frames):  # the source takes files by their times
        f.coalesce(1).write.mode("append").parquet(str(path))
        for p in set(Path(path).glob("*.parquet")) - seen:
            os.utime(p, (base + 10 * k, base + 10 * k))
            seen.add(p)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(path)), frames


DAY = "2024-01-01 {}:00"


def test_sessions_and_late_rows(spark, tmp_path):
    files = [[(1, 1, DAY.format("10:00")), (2, 1, DAY.format("10:20")), (3, 2, DAY.format("10:00"))], [(4, 1, DAY.format("10:45")), (5, 2, DAY.format("15:00"))], [(7, 1, DAY.format("14:30"))], [(6, 2, DAY.format("10:10")), (8, 3, DAY.format("23:00"))], [(9, 3, DAY.format("23:59"))]]
    stream, frames = visits(spark, tmp_path / "v", files)
    got = {(r.user_id, str(r.start)[11:16], r.n) for r in finish(live.demand_sessions(stream), "sessions", "append").collect()}
    # row 6 came after a batch with a watermark of 14:00: it is dropped; row 7 is in time; visits that are still open are not there
    assert got == {(1, "10:00", 3), (2, "10:00", 1), (2, "15:00", 1), (1, "14:30", 1)}
    batch = live.demand_sessions(frames[0].unionByName(frames[1]).unionByName(frames[2]).filter("event_id <> 6"))
    assert {(r.user_id, str(r.start)[11:16], r.n) for r in batch.collect()} == got


def test_sliding_windows(spark, tmp_path):
    stream, frames = visits(spark, tmp_path / "v", [[(1, 1, DAY.format("10:00")), (2, 1, DAY.format("13:00"))], [(3, 1, DAY.format("23:00"))]])
    kind = lambda d: d.withColumn("event_type", F.lit("view"))
    got = {(str(r.start), r.n) for r in finish(live.sliding_demand(kind(stream)), "sliding", "complete").collect()}
    assert got == {(str(r.start), r.n) for r in live.sliding_demand(kind(frames[0].unionByName(frames[1]))).collect()} and len(got) == 6


def test_stream_of_clicks_meets_stream_of_searches(spark, tmp_path):
    searches, s = visits(spark, tmp_path / "s", [[(1, 1, DAY.format("10:00")), (2, 1, DAY.format("10:40"))], [(3, 2, DAY.format("12:00"))]])
    clicks, c = visits(spark, tmp_path / "c", [[(11, 1, DAY.format("10:50")), (12, 1, DAY.format("09:59"))], [(13, 1, DAY.format("11:00")), (14, 2, DAY.format("13:00")), (15, 2, DAY.format("13:01"))]])
    got = {tuple(r) for r in finish(live.clicks_after(searches, clicks), "clicks", "append").collect()}
    want = {tuple(r) for r in live.clicks_after(s[0].unionByName(s[1]), c[0].unionByName(c[1])).collect()}
    assert got == want == {(1, 11, 3_000_000_000), (1, 13, 3_600_000_000), (2, 11, 600_000_000), (2, 13, 1_200_000_000), (3, 14, 3_600_000_000)}
