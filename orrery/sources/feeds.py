"""Product feeds, page markup and registry files as relations. Fetching is left to whoever supplies the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import jsonld, web
from orrery.functions.text import positive_price

SHOPIFY = """products array<struct<id: bigint, title: string, handle: string, vendor: string, product_type: string,
  variants: array<struct<id: bigint, title: string, sku: string, price: string, featured_image: struct<src: string>>>, images: array<struct<src: string>>>>"""
WOO = """array<struct<id: bigint, name: string, sku: string, permalink: string, prices: struct<price: string, currency_minor_unit: int>, images: array<struct<src: string>>>>"""


def shopify_variants(pages: DataFrame) -> DataFrame:
    """One row per variant of /products.json bodies (domain, body); variants without a positive price are left out."""
    p = pages.select("domain", F.explode(F.from_json("body", f"struct<{SHOPIFY}>")["products"]).alias("p")).select("domain", "p", F.explode("p.variants").alias("v"))
    plain = F.coalesce(F.col("v.title"), F.lit("Default Title")) == "Default Title"
    return p.select(
        "domain",
        F.coalesce(F.nullif("v.sku", F.lit("")), F.concat(F.lit("shopify-"), F.col("v.id").cast("string"))).alias("sku"),
        F.when(plain, F.col("p.title")).otherwise(F.concat_ws(" - ", "p.title", "v.title")).alias("title"),
        F.col("p.product_type").alias("category"),
        positive_price(F.col("v.price")).alias("price_inr"),
        F.coalesce("v.featured_image.src", F.get("p.images", F.lit(0))["src"]).alias("image_url"),
        F.concat(F.lit("https://"), "domain", F.lit("/products/"), "p.handle").alias("source_url"),
    ).filter("price_inr IS NOT NULL")


def woo_products(pages: DataFrame) -> DataFrame:
    """Rows of store API bodies; prices are whole minor units. A product without a price stays."""
    p = pages.select("domain", F.explode(F.from_json("body", WOO)).alias("p"))
    price = F.col("p.prices.price").try_cast("double") / F.pow(F.lit(10.0), F.coalesce("p.prices.currency_minor_unit", F.lit(2)))
    return p.select("domain", F.coalesce(F.nullif("p.sku", F.lit("")), F.concat(F.lit("woo-"), F.col("p.id").cast("string"))).alias("sku"), F.col("p.name").alias("title"), F.when(price > 0, price).alias("price_inr"), F.get("p.images", F.lit(0))["src"].alias("image_url"), F.col("p.permalink").alias("source_url"))


def json_ld_products(pages: DataFrame) -> DataFrame:
    """One row per page (url, html): title, sku, brand, image_url, price_inr, structured.

    The first Product node of the page's structured data counts, wherever it stands: alone, in a list, in @graph or
    inside other nodes, with one type or several. A name that is a part number gives way to the page's own heading, a
    missing price to one that the page states; a page without a Product falls back to heading and image.
    """
    n, html = F.col("_node"), F.col("html")
    found = jsonld.with_nodes(pages.select("url", "html"), html).withColumn("_node", F.get(F.filter("nodes", lambda v: jsonld.has_type(v, "product")), F.lit(0)))
    name, code = jsonld.field(n, "name"), jsonld.field(n, "sku", "productID", "mpn")
    spoken = lambda x: F.when(~jsonld.code_like(x), x)
    heading = F.coalesce(spoken(web.tag_text(html, "h1")), spoken(web.meta(html, "og:title")))
    named = F.when(F.lower(name).eqNullSafe(F.lower(code)), F.lit(None).cast("string")).otherwise(spoken(name))
    brand = jsonld.at(n, "brand")
    return found.select(
        "url", F.coalesce(named, heading, name).alias("title"), F.coalesce(code, web.url_slug(F.col("url"))).alias("sku"), F.coalesce(jsonld.text(brand), jsonld.field(brand, "name")).alias("brand"),
        F.coalesce(jsonld.image(n), web.meta(html, "og:image")).alias("image_url"), F.coalesce(jsonld.offer_price(n), jsonld.page_price(html)).alias("price_inr"), n.isNotNull().alias("structured"),
    )


def item_list_urls(pages: DataFrame) -> DataFrame:
    """url, item_url: what the ItemLists of listing pages (url, html) point to, each once."""
    lists = F.filter("nodes", lambda v: jsonld.has_type(v, "itemlist"))
    found = jsonld.with_nodes(pages.select("url", "html"), F.col("html")).select("url", F.explode(F.flatten(F.transform(lists, lambda v: jsonld.listed(jsonld.at(v, "itemListElement"))))).alias("e"))
    item = jsonld.at(F.col("e"), "item")
    target = F.coalesce(jsonld.field(F.col("e"), "url"), jsonld.text(item), jsonld.field(item, "url", "@id"))
    return found.select("url", target.alias("item_url")).filter("item_url IS NOT NULL").distinct()


def registry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Curated registry: price and tier columns are only hints and move into the notes."""
    r = spark.read.csv(path, header=True, escape='"', schema="brand string, domain string, categories string, price_published string, scrape_tier string, domain_confidence string, status string, notes string")
    hint = F.concat(F.lit("[seed hint: "), F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.nullif(F.trim(c), F.lit(""))) for c in ("price_published", "scrape_tier")]), F.lit("]"))
    return r.filter(F.trim("domain") != "").select("brand", web.domain(F.col("domain")).alias("domain"), "categories", "domain_confidence", "status", F.concat_ws(" ", F.nullif(F.trim("notes"), F.lit("")), hint).alias("notes"))


def merge_seeds(*seeds: DataFrame) -> DataFrame:
    """Seeds in order of precedence: the first row of a domain wins, notes of later ones are appended unless it has them."""
    ranked = [s.select("domain", "brand", "notes").withColumn("rank", F.lit(i)) for i, s in enumerate(seeds)]
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    g = rows.groupBy("domain").agg(F.min_by("brand", "rank").alias("brand"), F.array_sort(F.collect_list(F.struct("rank", F.coalesce("notes", F.lit("")).alias("notes")))).alias("n"))
    grafted = F.aggregate("n", F.lit(""), lambda a, x: F.when((x["notes"] == "") | F.contains(a, x["notes"]), a).when(a == "", x["notes"]).otherwise(F.concat_ws("; ", a, x["notes"])))
    return g.select("domain", "brand", grafted.alias("notes"))


def sitemap_pages(maps: DataFrame, hint: str = "product", least: int = 10) -> DataFrame:
    """Urls of sitemaps (domain, xml): those that look like products if a domain has at least `least` of them, else all."""
    urls = maps.select("domain", F.explode(web.sitemap_urls(F.col("xml"))).alias("url")).distinct()
    hits = urls.filter(F.contains("url", F.lit(hint))).groupBy("domain").count().filter(F.col("count") >= least).select("domain", F.lit(True).alias("_enough"))
    joined = urls.join(hits, "domain", "left")
    return joined.filter(F.col("_enough").isNull() | F.contains("url", F.lit(hint))).select("domain", "url")


def quarantine_split(rows: DataFrame, valid: F.Column, stage: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others as quarantine rows with stage and reason; a null verdict is not valid."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.filter(ok), rows.filter(~ok).select(F.lit(stage).alias("stage"), F.lit(reason).alias("reason"), F.to_json(F.struct("*")).alias("raw"))
