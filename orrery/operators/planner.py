"""The planner as a query, and streaming results as queries over a finished stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.image_colour import colour_families
from orrery.operators.quality import SCORED
from orrery.operators.resolve import GROUP_SQL
from orrery.plans.flywheel import pass_over, run
from orrery.registry import ORACLES, query
from orrery.relations import NOW, oracle, relation
from orrery.session import read_table
from orrery.streaming import live


@query(oracle("product price", f"WITH {SCORED}, {GROUP_SQL} SELECT key, value FROM (SELECT (SELECT count(*) FROM scored) AS total, (SELECT count(*) FROM scored WHERE publish_ready) AS ready, (SELECT count(DISTINCT variant_group_id) FROM grouped) AS groups) UNPIVOT (value FOR key IN (total, ready, groups))"))
def planner_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(relation(spark, sf_dir, "product"), relation(spark, sf_dir, "price"), NOW).metrics.select("key", "value")


def _one(name: str) -> str:
    return f"({ORACLES[name]})"


@query(f"""WITH q AS (SELECT * FROM {_one('quality_report')}), g AS (SELECT count(*) AS n, count(DISTINCT variant_group_id) AS groups FROM {_one('variant_groups')} WHERE variant_group_id IS NOT NULL), s AS (SELECT count(*) AS n FROM {_one('variant_audit')}),
c AS (SELECT round(sum(same) / sum(n), 4) AS accuracy FROM (SELECT seen AS n, round(same * seen) AS same FROM {_one('colour_eval')}))
SELECT key, CAST(value AS DOUBLE) AS value FROM (VALUES ('total', (SELECT total FROM q)), ('ready', (SELECT ready FROM q)), ('unverified', (SELECT unverified FROM q)), ('median_completeness', (SELECT median FROM q)), ('groups', (SELECT groups FROM g)), ('grouped_products', (SELECT n FROM g)), ('suspect_variant_groups', (SELECT n FROM s)), ('colour_accuracy', (SELECT accuracy FROM c))) v(key, value)""")
def planner_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pass with audit and colour evaluation; attributes are not filled, so that scores equal the other reports'."""
    return pass_over(relation(spark, sf_dir, "product"), relation(spark, sf_dir, "price"), NOW, seen=colour_families(spark, sf_dir)).metrics


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def demand_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin of streaming.live.demand_windows."""
    e = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOURS THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOURS AS "end", count(*) AS n, max(ts) AS last FROM s GROUP BY user_id, k""")
def demand_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin of streaming.live.demand_sessions: a gap of twelve hours ends a visit."""
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return live.demand_sessions(_timed(spark, sf_dir), gap="12 hours").select("user_id", plain("start"), plain("end"), "n", plain("last"))


@query("""SELECT s.event_id AS search_id, c.event_id AS click_id, epoch_us(c.ts) - epoch_us(s.ts) AS waited_us FROM events s JOIN events c ON c.user_id = s.user_id AND c.event_type = 'click' AND c.ts BETWEEN s.ts AND s.ts + INTERVAL 6 HOURS WHERE s.event_type = 'view'""")
def clicks_after_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin of streaming.live.clicks_after: clicks within six hours of a search."""
    e = _timed(spark, sf_dir)
    return live.clicks_after(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), within=6 * 3600)
