"""Dealers: deduplication, regions served; company records merged from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.functions import web
from orrery.registry import query
from orrery.relations import oracle, relation
from orrery.session import read_table

PAN = 18  # states served that count as the whole country


@query(oracle("dealer", "SELECT supplier_domain, city, pincode, min(id) AS id FROM dealer GROUP BY supplier_domain, city, pincode"))
def dealer_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First dealer of each place, whatever the name; store_dealers keeps dealers apart by name. Nulls are equal in grouping."""
    return relation(spark, sf_dir, "dealer").groupBy("supplier_domain", "city", "pincode").agg(F.min("id").alias("id"))


_CLEAN = "nullif(trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS {0}"


@query(oracle("dealer", f"""WITH c AS (SELECT id, supplier_domain, {_CLEAN.format('name')}, {_CLEAN.format('city')}, {_CLEAN.format('pincode')} FROM dealer)
SELECT supplier_domain, name, city, pincode, min(id) AS id FROM c WHERE name IS NOT NULL AND (city IS NOT NULL OR pincode IS NOT NULL) GROUP BY ALL"""))
def store_dealers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each dealer as the reference stores them: the name counts besides the place, an empty part is a
    null one, and rows without a name or without any place are left out. Tags and spare spaces go before."""
    return distinct_dealers(relation(spark, sf_dir, "dealer"))


def distinct_dealers(dealers: DataFrame) -> DataFrame:
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")), F.lit("")).alias(c)
    d = dealers.select("id", "supplier_domain", clean("name"), clean("city"), clean("pincode"))
    return d.filter("name IS NOT NULL AND (city IS NOT NULL OR pincode IS NOT NULL)").groupBy("supplier_domain", "name", "city", "pincode").agg(F.min("id").alias("id"))


@query(oracle("dealer", "SELECT supplier_domain, string_agg(DISTINCT state, '|' ORDER BY state) AS states, string_agg(DISTINCT city, '|' ORDER BY city) AS cities, count(*) AS n, count(DISTINCT state) >= 18 AS pan FROM dealer GROUP BY supplier_domain"))
def dealer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = relation(spark, sf_dir, "dealer").groupBy("supplier_domain").agg(F.array_sort(F.collect_set("state")).alias("s"), F.array_sort(F.collect_set("city")).alias("c"), F.count("*").alias("n"))
    return d.select("supplier_domain", F.array_join("s", "|").alias("states"), F.array_join("c", "|").alias("cities"), "n", (F.size("s") >= PAN).alias("pan"))


@query("""WITH x AS (SELECT regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[/?#].*$', ''), '^www\\.', '') AS domain, page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'gs'), '\\s+', ' ', 'g')), '') AS name FROM pages)
SELECT domain, count(*) AS n_pages, first(name ORDER BY page_id) FILTER (name IS NOT NULL) AS name FROM x GROUP BY domain""")
def merge_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per domain: number of pages and the first page's name; intake.merged_company merges all fields and channels."""
    p = read_table(spark, sf_dir, "pages").select(web.domain(F.col("url")).alias("domain"), "page_id", web.tag_text(F.col("html"), "title").alias("name"))
    return p.groupBy("domain").agg(F.count("*").alias("n_pages"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("page_id"))).alias("name"))


def company_record(pages: DataFrame) -> DataFrame:
    """domain, emails, mobiles, gstin, cin of pages (url, html): tax ids are taken out before numbers are read as phones.

    Channels become rows, each once per domain before the shuffle, so that no page's lists travel whole.
    """
    html = F.col("html")
    bare = web.strip_tags(F.regexp_replace(F.regexp_replace(html, T.GSTIN, " "), T.CIN, " "))
    one = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    x = pages.select(web.domain(F.col("url")).alias("domain"), "url", T.emails(bare).alias("emails"), T.mobiles(bare).alias("mobiles"), one(T.GSTIN).alias("gstin"), one(T.CIN).alias("cin"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("url"))).alias(c)
    out = x.groupBy("domain").agg(first("gstin"), first("cin"))
    for c in ("emails", "mobiles"):
        found = x.select("domain", F.explode(c).alias("x")).distinct().groupBy("domain").agg(F.array_sort(F.collect_set("x")).alias(c))
        out = out.join(found, "domain", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out.select("domain", "emails", "mobiles", "gstin", "cin")
