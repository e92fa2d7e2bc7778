"""Append-only price observations: deduplication, the freshest price, upserts of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.registry import query
from orrery.relations import now, oracle, relation

STALE_DAYS = 90
#: Freshest first; the reference leaves ties open, so every column takes part.
FRESHER = ("observed_at", "price_inr", "supplier", "order_key", "line")

LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id
  ORDER BY observed_at DESC, price_inr DESC, supplier DESC, order_key DESC, line DESC) AS rn FROM price) WHERE rn = 1)"""


def freshest(prices: DataFrame, columns: tuple[str, ...] = (*FRESHER, "basis", "source_url")) -> DataFrame:
    """One row per product: its latest observation. max(struct) aggregates before the shuffle, a window would not.

    columns may be the first of these, which the others do not change; the time alone needs no sort.
    """
    if len(columns) == 1:
        return prices.groupBy("product_id").agg(F.max(columns[0]).alias(columns[0]))
    return prices.groupBy("product_id").agg(F.max(F.struct(*columns)).alias("x")).select("product_id", "x.*")


def age_days(observed, at) -> F.Column:
    """Age in days, with fraction."""
    return (F.unix_micros(at.cast("timestamp")) - F.unix_micros(observed.cast("timestamp"))) / F.lit(86_400_000_000)


@query(oracle("price", f"""WITH {LATEST} SELECT product_id, price_inr, supplier, strftime(observed_at, '%Y-%m-%d') AS observed,
  CAST(floor((epoch_us($NOW) - epoch_us(observed_at)) / 86400000000.0) AS BIGINT) AS age_days, floor((epoch_us($NOW) - epoch_us(observed_at)) / 86400000000.0) > 90 AS stale FROM latest"""))
def freshest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole days of age and the staleness flag that retrieval uses."""
    age = F.floor(age_days(F.col("observed_at"), now()))
    return freshest(relation(spark, sf_dir, "price")).select("product_id", "price_inr", "supplier", F.date_format("observed_at", "yyyy-MM-dd").alias("observed"), age.alias("age_days"), (age > STALE_DAYS).alias("stale"))


def first_observations(prices: DataFrame) -> DataFrame:
    """Insert-or-ignore on (product, url, price, basis): the earliest row stays; a null url is never equal to another."""
    key = ["product_id", "source_url", "price_inr", "basis"]
    one = F.min_by(F.struct("observed_at", "order_key", "line"), F.struct("observed_at", "order_key", "line"))
    known = prices.filter("source_url IS NOT NULL").groupBy(key).agg(one.alias("x")).select(*key, "x.*")
    return known.unionByName(prices.filter("source_url IS NULL").select(*key, "observed_at", "order_key", "line"))


@query(oracle("price", """SELECT product_id, source_url, price_inr, basis, strftime(min(observed_at), '%Y-%m-%d') AS observed FROM price GROUP BY product_id, source_url, price_inr, basis"""))
def price_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_observations(relation(spark, sf_dir, "price")).select("product_id", "source_url", "price_inr", "basis", F.date_format("observed_at", "yyyy-MM-dd").alias("observed"))


@query(oracle("product price", f"""WITH {LATEST} SELECT id, COALESCE(p.source_url, l.source_url) AS source_url FROM product p LEFT JOIN latest l ON l.product_id = p.id"""))
def backfill_source_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = freshest(relation(spark, sf_dir, "price")).select(F.col("product_id").alias("id"), F.col("source_url").alias("seen"))
    return relation(spark, sf_dir, "product").join(latest, "id", "left").select("id", F.coalesce("source_url", "seen").alias("source_url"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], overwrite: list[str], keep: list[str]) -> DataFrame:
    """Snapshot after an upsert: `overwrite` columns come from new rows, nulls too; `keep` columns only fill or replace by values."""
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
    came = F.col("_n").isNotNull()
    columns = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in key]
    columns += [F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in overwrite]
    columns += [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in keep]
    return joined.select(*columns)


@query(oracle("product", """WITH o AS (SELECT * FROM product WHERE id % 3 <> 0), n AS (SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE upper(title) END AS title, NULL AS finish, CASE WHEN id % 2 = 0 THEN image_url END AS image_url FROM product WHERE id % 2 = 0)
SELECT COALESCE(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN n.id IS NOT NULL THEN n.finish ELSE o.finish END AS finish, COALESCE(n.image_url, o.image_url) AS image_url FROM o FULL OUTER JOIN n ON n.id = o.id"""))
def upsert_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = relation(spark, sf_dir, "product")
    new = p.filter("id % 2 = 0").select("id", F.when(F.col("id") % 5 != 0, F.upper("title")).alias("title"), F.lit(None).cast("string").alias("finish"), "image_url")
    return upsert(p.filter("id % 3 <> 0"), new, ["id"], ["title", "finish"], ["image_url"])


@query(oracle("product", """SELECT id, supplier_domain, CASE WHEN count(*) OVER (PARTITION BY supplier_domain, image_url) >= 3 AND image_url IS NOT NULL THEN NULL ELSE image_url END AS image_url FROM (SELECT id, supplier_domain, concat('img', CAST(id % 300 AS STRING)) AS image_url FROM product)"""))
def shared_default_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image that three or more products of a domain share is a placeholder and is dropped."""
    p = relation(spark, sf_dir, "product").select("id", "supplier_domain", F.concat(F.lit("img"), (F.col("id") % 300).cast("string")).alias("image_url"))
    shared = p.groupBy("supplier_domain", "image_url").count().filter("count >= 3").withColumn("shared", F.lit(True)).drop("count")
    joined = p.join(shared, ["supplier_domain", "image_url"], "left")
    return joined.select("id", "supplier_domain", F.when(F.col("shared").isNull(), F.col("image_url")).alias("image_url"))
