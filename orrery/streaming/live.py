"""Streaming twins of time-windowed and deduplicating queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def read_events(spark: SparkSession, directory: str, schema, glob: str = "events.parquet") -> DataFrame:
    """Parquet files as a stream; event time becomes a UTC timestamp, because watermarks reject times without a zone."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 16).parquet(directory)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def demand_windows(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their value per window and kind."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def demand_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Visits of a user: events no further apart than gap, with their number and end (the last event plus gap)."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("last")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "last")


def sliding_demand(events: DataFrame, size: str = "1 day", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events per kind in windows that overlap."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def clicks_after(searches: DataFrame, clicks: DataFrame, within: int = 3600, late: str = "1 hour") -> DataFrame:
    """search_id, click_id, waited_us of a user's clicks up to `within` seconds after a search.

    Both sides are (event_id, user_id, ts). They meet in slots of `within` seconds, a search in its own and the next,
    so that a busy user's rows are not all paired. On streams, watermarks and the bound let either side's state end.
    """
    slot = lambda ts: F.floor(F.unix_micros(ts) / (within * 1_000_000))
    s = searches.withWatermark("ts", late).select(F.col("event_id").alias("search_id"), F.col("user_id").alias("searcher"), F.col("ts").alias("searched"), F.explode(F.sequence(slot("ts"), slot("ts") + 1)).alias("at"))
    c = clicks.withWatermark("ts", late).select(F.col("event_id").alias("click_id"), "user_id", "ts", slot("ts").alias("slot"))
    soon = (F.col("ts") >= F.col("searched")) & (F.col("ts") <= F.col("searched") + F.expr(f"INTERVAL {int(within)} SECONDS"))
    return s.join(c, (F.col("searcher") == F.col("user_id")) & (F.col("at") == F.col("slot")) & soon).select("search_id", "click_id", (F.unix_micros("ts") - F.unix_micros("searched")).alias("waited_us"))


def first_seen(observations: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """Insert-or-ignore on a stream; state is kept for the watermark's span only."""
    return observations.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


KEEP_DAYS = 90


class Freshest(StatefulProcessor):
    """Keeps the newest (time, price) of a product; the state ends when no newer one came for KEEP_DAYS."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "micros long, price double", ttlDurationMs=KEEP_DAYS * 86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        old = tuple(self.best.get()) if self.best.exists() else None
        new = old
        for f in rows:
            micros = pd.DatetimeIndex(f["ts"]).tz_localize(None).as_unit("us").asi8
            new = max([*([new] if new else []), *zip(micros.tolist(), f["price"].tolist(), strict=True)], default=None)
        if new is not None and new != old:
            self.best.update(new)
            yield pd.DataFrame({"product_id": [key[0]], "ts": pd.to_datetime([new[0]], unit="us"), "price": [new[1]]})

    def close(self) -> None:
        pass


def freshest_state(observations: DataFrame) -> DataFrame:
    """product_id, ts, price whenever a product's freshest observation changes; one small state per product, with an end. Needs the RocksDB state store."""
    return observations.groupBy("product_id").transformWithStateInPandas(Freshest(), "product_id long, ts timestamp, price double", "Update", "ProcessingTime")


class JobState(StatefulProcessor):
    """A queue job as a state machine: enqueue, claim, complete, fail and retry move it; other moves are ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "status string, attempts int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        status, attempts = self.job.get() if self.job.exists() else (None, 0)
        out = []
        events = pd.concat(list(rows)).sort_values("at", kind="stable")
        for at, event, most in zip(events["at"], events["event"], events["max_attempts"], strict=True):
            after = moved(status, attempts, event, int(most))
            if after != (status, attempts):
                status, attempts = after
                out.append((key[0], at, status, attempts))
        if out:
            self.job.update((status, attempts))
            yield pd.DataFrame(out, columns=["id", "at", "status", "attempts"])

    def close(self) -> None:
        pass


def moved(status: str | None, attempts: int, event: str, most: int) -> tuple[str | None, int]:
    """State and attempts of a job after an event."""
    if event == "enqueue" and status is None:
        return "pending", 0
    if event == "claim" and status == "pending":
        return "running", attempts
    if event == "complete" and status == "running":
        return "done", attempts
    if event == "fail" and status == "running":
        return ("failed" if attempts + 1 >= most else "pending"), attempts + 1
    if event == "retry" and status == "failed":
        return "pending", 0
    return status, attempts


def job_states(events: DataFrame) -> DataFrame:
    """id, at, status, attempts after every move of jobs, from a stream of events (id, at, event, max_attempts). Needs the RocksDB state store."""
    return events.groupBy("id").transformWithStateInPandas(JobState(), "id long, at timestamp, status string, attempts int", "Update", "None")
