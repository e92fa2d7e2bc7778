"""Faceted listing, collapsed design cards, supplier rollups and catalogue statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.prefix import running_sum
from orrery.operators.prices import LATEST, freshest
from orrery.operators.resolve import GROUP_SQL, with_group
from orrery.registry import query
from orrery.relations import oracle, relation

MOST = 200


def filters(
    *, supplier: str | None = None, brand: str | None = None, category: str | None = None, family: str | None = None, category_std: str | None = None, q: str | None = None,
    has_image: bool | None = None, priced: bool | None = None, min_price: float | None = None, max_price: float | None = None, publish_ready: bool | None = None,
) -> Column:
    """Equality, case-insensitive containment, presence and price bounds; None filters nothing. % and _ in q are live wildcards, as in the reference.

    Price filters need a column price_inr (priced()), family, category_std and publish_ready those of classification and scoring.
    """
    out = F.lit(True)
    for name, value in {"supplier_domain": supplier, "brand": brand, "family": family, "category_std": category_std, "publish_ready": publish_ready}.items():
        if value is not None:
            out &= F.col(name) == value
    for name, value in {"category": category, "title": q}.items():
        if value is not None:
            out &= F.col(name).ilike(f"%{value}%")
    for name, value in {"image_url": has_image, "price_inr": priced}.items():
        if value is not None:
            out &= F.col(name).isNotNull() if value else F.col(name).isNull()
    if min_price is not None:
        out &= F.col("price_inr") >= min_price
    if max_price is not None:
        out &= F.col("price_inr") <= max_price
    return out


def priced(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Products with their freshest price as price_inr."""
    return products.join(freshest(prices).select(F.col("product_id").alias("id"), "price_inr"), "id", "left")


@query(oracle("product price", f"WITH {LATEST} SELECT p.id, l.price_inr FROM product p JOIN latest l ON l.product_id = p.id WHERE l.price_inr BETWEEN 500 AND 900 AND p.image_url IS NULL AND p.category ILIKE '%a%'"))
def list_products_in_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = priced(relation(spark, sf_dir, "product"), relation(spark, sf_dir, "price"))
    return p.filter(filters(priced=True, min_price=500, max_price=900, has_image=False, category="A")).select("id", "price_inr")


@query(oracle("product", "SELECT id, brand, title, category FROM product WHERE category ILIKE '%TILE%' AND title ILIKE '%bolt%' AND image_url IS NOT NULL"))
def list_products_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "product").filter(filters(category="TILE", q="bolt", has_image=True)).select("id", "brand", "title", "category")


def page(products: DataFrame, prices: DataFrame, order: str = "title", descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page with freshest prices. Unless the order needs prices, the page is cut first and prices of its ids alone are read."""
    limit, offset = min(max(limit, 1), MOST), max(offset, 0)
    key = (F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_first(), F.col("id"))
    if order == "price_inr":
        latest = freshest(prices).select(F.col("product_id").alias("id"), "price_inr")
        return products.join(latest, "id", "left").orderBy(*key).offset(offset).limit(limit)
    cut = products.orderBy(*key).offset(offset).limit(limit)
    own = prices.join(F.broadcast(cut.select(F.col("id").alias("product_id"))), "product_id", "left_semi")  # at most MOST ids
    return cut.join(freshest(own).select(F.col("product_id").alias("id"), "price_inr"), "id", "left")


@query(oracle("product price", f"""WITH {LATEST} SELECT p.id, p.title, l.price_inr FROM (SELECT * FROM product ORDER BY title, id LIMIT 50 OFFSET 100) p LEFT JOIN latest l ON l.product_id = p.id"""))
def list_products_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(relation(spark, sf_dir, "product"), relation(spark, sf_dir, "price"), offset=100).select("id", "title", "price_inr")


@query(oracle("product price", f"""WITH {LATEST} SELECT p.id, p.title, l.price_inr FROM product p LEFT JOIN latest l ON l.product_id = p.id ORDER BY l.price_inr DESC NULLS LAST, p.id LIMIT 25"""))
def list_products_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(relation(spark, sf_dir, "product"), relation(spark, sf_dir, "price"), order="price_inr", descending=True, limit=25).select("id", "title", "price_inr")


def designs(products: DataFrame, prices: DataFrame, low: float | None = None, high: float | None = None, limit: int = MOST, offset: int = 0) -> DataFrame:
    """One card per variant group (products without a group stand alone): counts, price band, sizes, finishes and the fullest member.

    Member filters belong on products, before grouping; the band is a filter on groups, and groups without a price
    fail it. Aggregates and representative come from one shuffle.
    """
    latest = freshest(prices).select(F.col("product_id").alias("id"), "price_inr")
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("size_mm", "finish", "image_url", "source_url")), F.lit(0))
    members = with_group(products).join(latest, "id", "left").withColumn("completeness", filled)
    members = members.withColumn("gkey", F.coalesce("variant_group_id", F.concat(F.lit("p"), F.col("id").cast("string"))))
    best = F.struct((-F.col("completeness")).alias("c"), F.col("id").alias("i"))
    cards = members.groupBy("gkey").agg(
        F.count("*").alias("variant_count"),
        F.min("price_inr").alias("min_price"),
        F.max("price_inr").alias("max_price"),
        F.array_join(F.array_sort(F.collect_set("size_mm")), "|").alias("sizes"),
        F.array_join(F.array_sort(F.collect_set("finish")), "|").alias("finishes"),
        F.min_by(F.struct("id", "title", "completeness"), best).alias("rep"),
    )
    if low is not None:
        cards = cards.filter(F.col("max_price") >= low)
    if high is not None:
        cards = cards.filter(F.col("min_price") <= high)
    cards = cards.select("gkey", "variant_count", "min_price", "max_price", "sizes", "finishes", F.col("rep.id").alias("id"), F.col("rep.title").alias("title"), F.col("rep.completeness").alias("completeness"))
    return cards.orderBy(F.desc("variant_count"), F.desc_nulls_last("completeness"), "id").offset(max(offset, 0)).limit(min(max(limit, 1), MOST))


@query(oracle("product price", f"""WITH {LATEST}, {GROUP_SQL},
m AS (SELECT g.*, l.price_inr, (size_mm IS NOT NULL)::INT + (finish IS NOT NULL)::INT + (image_url IS NOT NULL)::INT + (g.source_url IS NOT NULL)::INT AS completeness, COALESCE(variant_group_id, concat('p', CAST(id AS VARCHAR))) AS gkey FROM grouped g LEFT JOIN latest l ON l.product_id = g.id),
a AS (SELECT gkey, count(*) AS variant_count, min(price_inr) AS min_price, max(price_inr) AS max_price, COALESCE(string_agg(DISTINCT size_mm, '|' ORDER BY size_mm), '') AS sizes, COALESCE(string_agg(DISTINCT finish, '|' ORDER BY finish), '') AS finishes FROM m GROUP BY gkey),
r AS (SELECT gkey, id, title, completeness FROM (SELECT *, row_number() OVER (PARTITION BY gkey ORDER BY completeness DESC NULLS LAST, id) AS place FROM m) WHERE place = 1)
SELECT a.gkey, variant_count, min_price, max_price, sizes, finishes, r.id, r.title, r.completeness FROM a JOIN r USING (gkey) WHERE max_price >= 1000 AND min_price <= 90000 ORDER BY variant_count DESC, completeness DESC NULLS LAST, id LIMIT 200"""))
def list_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs(relation(spark, sf_dir, "product"), relation(spark, sf_dir, "price"), low=1000, high=90000)


@query(oracle("product price supplier", """SELECT p.supplier_domain AS domain, COALESCE(min(s.brand), p.supplier_domain) AS brand, count(*) AS products, count(DISTINCT o.product_id) AS priced, count(DISTINCT CASE WHEN p.image_url IS NOT NULL THEN p.id END) AS with_image
FROM product p LEFT JOIN supplier_rel s ON s.domain = p.supplier_domain LEFT JOIN price o ON o.product_id = p.id GROUP BY p.supplier_domain"""))
def list_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """products counts rows after the fan-out over observations, as the reference does.

    Observations are counted per product first, so the fan-out is a sum instead of joined rows.
    """
    seen = relation(spark, sf_dir, "price").groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("n"))
    per = relation(spark, sf_dir, "product").join(seen, "id", "left").groupBy(F.col("supplier_domain").alias("domain")).agg(
        F.sum(F.coalesce("n", F.lit(1))).alias("products"), F.count("n").alias("priced"), F.count("image_url").alias("with_image"))
    names = relation(spark, sf_dir, "supplier").groupBy("domain").agg(F.min("brand").alias("brand"))
    return per.join(names, "domain", "left").select("domain", F.coalesce("brand", "domain").alias("brand"), "products", "priced", "with_image")


@query(oracle("product dealer supplier", """WITH d AS (SELECT supplier_domain, string_agg(name, '|' ORDER BY state, city, id) AS dealers FROM (SELECT *, row_number() OVER (PARTITION BY supplier_domain ORDER BY state, city, id) AS k FROM dealer) WHERE k <= 40 GROUP BY supplier_domain),
p AS (SELECT supplier_domain, count(*) AS products, count(source_url) AS with_url FROM product GROUP BY supplier_domain)
SELECT s.domain, s.brand, s.state, COALESCE(p.products, 0) AS products, COALESCE(p.with_url, 0) AS with_url, COALESCE(d.dealers, '') AS dealers FROM supplier_rel s LEFT JOIN p ON p.supplier_domain = s.domain LEFT JOIN d ON d.supplier_domain = s.domain"""))
def supplier_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile, catalogue counts and up to 40 dealers by state and city; the window cuts before rows are collected."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("supplier_domain").orderBy("state", "city", "id"))
    some = relation(spark, sf_dir, "dealer").withColumn("k", nth).filter("k <= 40")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("state", "city", "id", "name"))), lambda x: x["name"]), "|")
    dealers = some.groupBy(F.col("supplier_domain").alias("domain")).agg(names.alias("dealers"))
    counts = relation(spark, sf_dir, "product").groupBy(F.col("supplier_domain").alias("domain")).agg(F.count("*").alias("products"), F.count("source_url").alias("with_url"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return relation(spark, sf_dir, "supplier").join(counts, "domain", "left").join(dealers, "domain", "left").select("domain", "brand", "state", zero("products"), zero("with_url"), F.coalesce("dealers", F.lit("")).alias("dealers"))


@query(oracle("product price supplier", """WITH x AS (SELECT list(price_inr ORDER BY price_inr) AS a FROM price)
SELECT (SELECT count(*) FROM product) AS products, (SELECT count(DISTINCT supplier_domain) FROM product) AS suppliers, (SELECT count(DISTINCT brand) FROM product) AS brands, (SELECT count(image_url) FROM product) AS with_image, (SELECT count(*) FROM price) AS observations, (SELECT count(DISTINCT product_id) FROM price) AS priced, (SELECT a[len(a) // 2 + 1] FROM x) AS median_price, (SELECT count(*) FROM supplier_rel WHERE status = 'active') AS active"""))
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the upper median (the value at place n div 2) of all prices."""
    p = relation(spark, sf_dir, "product").agg(F.count("*").alias("products"), F.countDistinct("supplier_domain").alias("suppliers"), F.countDistinct("brand").alias("brands"), F.count("image_url").alias("with_image"))
    prices = relation(spark, sf_dir, "price")
    o = prices.agg(F.count("*").alias("observations"), F.countDistinct("product_id").alias("priced"))
    s = relation(spark, sf_dir, "supplier").agg(F.count_if(F.col("status") == "active").alias("active"))
    # equal prices are counted together; the place is found on the running sum of their counts
    upto = running_sum(prices.filter("price_inr IS NOT NULL").groupBy("price_inr").agg(F.count("*").alias("n")), [], ["price_inr"], "n", "upto")
    total = upto.agg(F.max("upto").alias("total"))
    m = upto.crossJoin(F.broadcast(total)).filter(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("price_inr").alias("median_price"))
    return p.crossJoin(o).crossJoin(m).crossJoin(s).select("products", "suppliers", "brands", "with_image", "observations", "priced", "median_price", "active")  # one row each


@query(oracle("product", "SELECT supplier_domain AS domain, count(*) AS n FROM product GROUP BY 1 ORDER BY n DESC, domain LIMIT 12"))
def top_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "product").groupBy(F.col("supplier_domain").alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(12)


@query(oracle("supplier", """SELECT 'tier' AS facet, scrape_tier AS value, count(*) AS n, CAST(sum(sku_estimate) AS BIGINT) AS skus FROM supplier_rel GROUP BY 2 UNION ALL
SELECT 'status', status, count(*), CAST(sum(sku_estimate) AS BIGINT) FROM supplier_rel GROUP BY 2 UNION ALL SELECT 'price', price_published, count(*), CAST(sum(sku_estimate) AS BIGINT) FROM supplier_rel GROUP BY 2"""))
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = relation(spark, sf_dir, "supplier").selectExpr("sku_estimate", "stack(3, 'tier', scrape_tier, 'status', status, 'price', price_published) AS (facet, value)")
    return s.groupBy("facet", "value").agg(F.count("*").alias("n"), F.sum("sku_estimate").alias("skus"))


@query(oracle("supplier", "SELECT domain, scrape_tier FROM supplier_rel WHERE status = 'active' AND scrape_tier = 'jsonld'"))
def select_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "supplier").filter("status = 'active' AND scrape_tier = 'jsonld'").select("domain", "scrape_tier")
