"""The planner pass over a catalogue snapshot: fill, classify, score, group, audit, measure colours, snapshot metrics, queue what is missing.

run() is the short form, plain transformations of one snapshot. pass_over() is the whole pass: it writes the scored
products with their keys once, and every report is one aggregation of that table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.enrichment import text_pass
from orrery.operators.quality import classified, scored
from orrery.operators.resolve import grouped, keyed, with_group
from orrery.session import shared_folder, spread


@dataclass
class Plan:
    products: DataFrame
    metrics: DataFrame
    jobs: DataFrame


def run(products: DataFrame, prices: DataFrame, day: str) -> Plan:
    """products with class, score, tier and group; metrics as rows; one enrichment job per supplier with gaps."""
    full = with_group(classified(scored(products, prices, day)))
    totals = full.agg(F.count("*").alias("total"), F.count_if("publish_ready").alias("ready"), F.countDistinct("variant_group_id").alias("groups"))
    metrics = totals.selectExpr(f"'{day}' AS captured", "stack(3, 'total', total, 'ready', ready, 'groups', groups) AS (key, value)")
    gaps = full.filter(~F.col("publish_ready") & F.col("source_url").isNotNull())
    jobs = gaps.groupBy(F.col("supplier_domain").alias("target")).agg(F.least(F.count("*"), F.lit(100)).cast("int").alias("priority")).withColumn("stage", F.lit("enrich"))
    return Plan(full, metrics, jobs)


SUSPECT = "ncat > 1 OR (mn > 0 AND mx > 20 * mn)"


@dataclass
class Pass:
    products: DataFrame  # the table that was written, with groups
    groups: DataFrame  # suspect groups: gid, ncat, mn, mx, n
    metrics: DataFrame  # key, value
    jobs: DataFrame


def prepared(products: DataFrame, prices: DataFrame, day: str, fill: bool = False) -> DataFrame:
    """What the pass writes: filled, scored, classified, with last_price and the key k of a group.

    Prices are brought to one row per product once. What takes patterns on a product's words comes after rows are dealt, by
    the join or before the filling, as a small file is one split.
    """
    full = scored(text_pass(spread(products)) if fill else products, prices, day, price="last_price")
    return keyed(classified(full))


def pass_over(products: DataFrame, prices: DataFrame, day: str, seen: DataFrame | None = None, fill: bool = False) -> Pass:
    """All steps. prices are (product_id, price_inr, observed_at, ...); seen are colour families of pixels (id, said, seen).

    fill takes attributes out of titles first. Group sizes, categories and price ranges come from one row per group and category.
    """
    spark = products.sparkSession
    path = shared_folder(spark, "planned")
    prepared(products, prices, day, fill).write.option("compression", "zstd").parquet(path)
    planned = spark.read.parquet(path)
    part = planned.groupBy("k", "category").agg(F.count("*").alias("n"), F.min("last_price").alias("mn"), F.max("last_price").alias("mx"))
    groups = part.filter("k IS NOT NULL").groupBy(F.col("k").alias("gid")).agg(F.count("category").alias("ncat"), F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.sum("n").alias("n")).filter("n > 1")
    suspect = groups.filter(SUSPECT)
    by = planned.groupBy("completeness", "tier").agg(F.count("*").alias("n"), F.count_if("publish_ready").alias("ready"))  # at most 101 scores x tiers
    upto = by.withColumn("upto", F.sum("n").over(Window.orderBy("completeness", "tier"))).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(1))))
    tell = {"total": F.sum("n"), "ready": F.sum("ready"), "unverified": F.sum(F.when(F.col("tier") == "unverified", F.col("n")).otherwise(0)), "median_completeness": F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("completeness")))}
    counts = {"groups": F.count("*"), "grouped_products": F.coalesce(F.sum("n"), F.lit(0)), "suspect_variant_groups": F.count_if(F.expr(SUSPECT))}
    told = [_rows(upto, tell), _rows(groups, counts)]
    if seen is not None:
        told.append(_rows(seen.filter("said IS NOT NULL AND seen IS NOT NULL"), {"colour_accuracy": F.round(F.avg((F.col("said") == F.col("seen")).cast("double")), 4)}))
    metrics = told[0]
    for t in told[1:]:
        metrics = metrics.unionByName(t)
    gaps = planned.filter(~F.col("publish_ready") & F.col("source_url").isNotNull())
    jobs = gaps.groupBy(F.col("supplier_domain").alias("target")).agg(F.least(F.count("*"), F.lit(100)).cast("int").alias("priority")).withColumn("stage", F.lit("enrich"))
    return Pass(grouped(planned), suspect, metrics, jobs)


def _rows(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """key and value of measures over all rows."""
    one = df.agg(*[m.cast("double").alias(k) for k, m in measures.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in measures])).alias("m")).select("m.*")
