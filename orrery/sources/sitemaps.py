"""Sitemap indexes followed down to pages, as joins of fetched files; cycles end because a file counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a product's address holds, and endings of files that are no pages.
HINTS = ("product", "/pdp")
CHILDREN, PAGES = 50, 1000  # of a domain: sitemaps followed from its indexes, pages taken


def entries(files: DataFrame) -> DataFrame:
    """domain, file, kind (index or urlset), place, loc of fetched files (domain, url, xml); files of another kind give none."""
    root = F.lower(F.regexp_extract("xml", r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<(?:\w+:)?(sitemapindex|urlset)\b", 1))
    locs = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:\w+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?loc>"), F.lit(1))
    kind = F.when(root == "sitemapindex", "index").when(root == "urlset", "urlset")
    found = files.select("domain", F.col("url").alias("file"), kind.alias("kind"), F.posexplode(locs).alias("place", "loc")).filter("kind IS NOT NULL")
    return found.withColumn("loc", F.regexp_replace("loc", "&amp;", "&")).filter("loc <> ''")


def _hinted(url: F.Column) -> F.Column:
    low = F.lower(url)
    return F.contains(low, F.lit(HINTS[0])) | F.contains(low, F.lit(HINTS[1]))


def page_urls(files: DataFrame, roots: DataFrame, depth: int = 3, children: int = CHILDREN, pages: int = PAGES) -> DataFrame:
    """domain, url, depth of the pages that sitemaps lead to, from roots (domain, url) through fetched files (domain, url, xml).

    An index leads to its product sitemaps, or to all of its sitemaps where none has a product's name; of a domain's at
    most `children` are followed per level, product sitemaps and early places first. Indexes in indexes are followed to
    `depth`; a file that was already read is not read again, so cycles end. Pages are those that look like products if
    a domain has ten of them, else all; at most `pages` per domain, by depth, file and place. Asset files are left out.
    """
    lines = entries(files)
    seen = at = roots.select("domain", F.col("url").alias("file")).distinct().withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        below = lines.filter("kind = 'index'").join(at, ["domain", "file"]).withColumn("hint", _hinted(F.col("loc")))
        some = F.max("hint").over(Window.partitionBy("domain", "file"))
        below = below.withColumn("some", some).filter("hint OR NOT some")
        fresh = below.groupBy("domain", F.col("loc").alias("file")).agg(F.min("place").alias("place")).join(seen, ["domain", "file"], "left_anti")
        order = F.row_number().over(Window.partitionBy("domain").orderBy("place", "file"))
        at = fresh.withColumn("n", order).filter(F.col("n") <= children).select("domain", "file", F.lit(k).alias("depth"))
        seen = seen.unionByName(at)
    found = lines.filter("kind = 'urlset'").join(seen, ["domain", "file"]).filter(~F.regexp_like(F.lower("loc"), F.lit(r"\.(jpe?g|png|webp|gif|svg|pdf|css|js)(\?|$)")))
    one = found.groupBy("domain", F.col("loc").alias("url")).agg(F.min(F.struct("depth", "file", "place")).alias("at"))
    hits = F.count_if(_hinted(F.col("url"))).over(Window.partitionBy("domain"))
    kept = one.withColumn("hits", hits).filter(_hinted(F.col("url")) | (F.col("hits") < 10))
    order = F.row_number().over(Window.partitionBy("domain").orderBy("at", "url"))
    return kept.withColumn("n", order).filter(F.col("n") <= pages).select("domain", "url", F.col("at.depth").alias("depth"))


def sku_estimates(files: DataFrame, roots: DataFrame, **limits: int) -> DataFrame:
    """domain, sku_estimate: how many pages the sitemaps lead to; null where there are none."""
    n = page_urls(files, roots, **limits).groupBy("domain").agg(F.count("*").alias("sku_estimate"))
    return roots.select("domain").distinct().join(n, "domain", "left")
