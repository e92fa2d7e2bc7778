"""Variant grouping of products and its audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.prices import LATEST, freshest
from orrery.registry import query
from orrery.relations import oracle, relation
from orrery.session import made_here, spread


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def group_key(domain: Column, brand: Column, title: Column) -> Column:
    """Key of a variant group from normalised names; null where the title has fewer than two words."""
    norm = lambda c: F.array_join(tokens(c), " ")
    raw = F.concat(norm(domain), F.lit("|"), norm(brand), F.lit("|"), norm(title))
    return F.when(F.size(tokens(title)) >= 2, F.substring(F.sha1(raw), 1, 16))


def keyed(products: DataFrame) -> DataFrame:
    """Adds k, the key of the variant group that a product may be in."""
    return made_here(products, k=group_key(F.lit("catalogue"), F.col("brand"), F.regexp_replace("title", r" \d.*$", "")))


def grouped(keyed: DataFrame) -> DataFrame:
    """variant_group_id in place of k; a group of one product has none."""
    many = keyed.filter("k IS NOT NULL").groupBy("k").count().filter("count > 1").select("k", F.col("k").alias("variant_group_id"))
    return keyed.join(many, "k", "left").drop("k")


def with_group(products: DataFrame) -> DataFrame:
    """Adds variant_group_id. Keys take several patterns a row, and a small file is one split, so products are dealt first."""
    return grouped(keyed(spread(products)))


_NORM = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), ' ')"
GROUP_SQL = f"""keyed AS (SELECT *, regexp_replace(title, ' \\d.*$', '') AS base FROM product),
hashed AS (SELECT *, CASE WHEN len(regexp_extract_all(lower(base), '[a-z0-9]+')) >= 2 THEN substr(sha1(concat('catalogue|', {_NORM.format('brand')}, '|', {_NORM.format('base')})), 1, 16) END AS k FROM keyed),
grouped AS (SELECT *, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 THEN k END AS variant_group_id FROM hashed)"""


@query(oracle("product", f"WITH {GROUP_SQL} SELECT id, variant_group_id FROM grouped"))
def variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_group(relation(spark, sf_dir, "product")).select("id", "variant_group_id")


@query(oracle("product price", f"""WITH {LATEST}, {GROUP_SQL} SELECT variant_group_id AS gid, count(DISTINCT category) AS ncat, min(price_inr) AS mn, max(price_inr) AS mx, count(*) AS n
FROM grouped g LEFT JOIN latest l ON l.product_id = g.id WHERE variant_group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT category) > 1 OR (min(price_inr) > 0 AND max(price_inr) > 20 * min(price_inr))"""))
def variant_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that span categories or whose prices spread more than twenty-fold."""
    latest = freshest(relation(spark, sf_dir, "price")).select(F.col("product_id").alias("id"), "price_inr")
    m = with_group(relation(spark, sf_dir, "product")).filter("variant_group_id IS NOT NULL").join(latest, "id", "left")
    g = m.groupBy(F.col("variant_group_id").alias("gid")).agg(F.countDistinct("category").alias("ncat"), F.min("price_inr").alias("mn"), F.max("price_inr").alias("mx"), F.count("*").alias("n"))
    return g.filter("ncat > 1 OR (mn > 0 AND mx > 20 * mn)")


@query(oracle("product", f"""WITH {GROUP_SQL} SELECT a.id, b.id AS variant FROM grouped a JOIN grouped b ON a.variant_group_id = b.variant_group_id AND a.id <> b.id WHERE a.id < 50"""))
def variants_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings of the first fifty products: a lookup of a page, so the looked-up side is small by definition."""
    g = with_group(relation(spark, sf_dir, "product")).filter("variant_group_id IS NOT NULL")
    own = g.filter("id < 50").select("id", "variant_group_id")
    return own.join(g.select(F.col("id").alias("variant"), "variant_group_id"), "variant_group_id").filter("id <> variant").select("id", "variant")
