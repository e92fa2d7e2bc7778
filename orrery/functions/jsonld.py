"""Structured data of pages as VARIANT trees: nodes of a type wherever they stand, and their fields, in the JVM.

A tree is laid out level by level, so that its nodes are one array in order of depth, then place; an object's members
come in the order of their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import web

DEPTH = 12  # of objects and lists inside each other; product data nests about six deep


def elements(v: Column) -> Column:
    """Members of an object or a list; none of anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<variant>"))


def listed(v: Column) -> Column:
    """A list as it is, any other value as a list of one, null as an empty list."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)), F.array().cast("array<variant>"))


def at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f'$["{name}"]', "variant")


def text(v: Column) -> Column:
    """A string or a number as trimmed text; null for objects, lists and blank strings."""
    nested = F.try_variant_get(v, "$", "array<variant>").isNotNull() | F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    return F.when(~nested, F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")))


def field(v: Column, *names: str) -> Column:
    """text of the first member that has some."""
    return F.coalesce(*[text(at(v, n)) for n in names])


def has_type(v: Column, *kinds: str) -> Column:
    """Whether @type, a string or a list of strings, names one of kinds (lower case)."""
    own = F.transform(listed(at(v, "@type")), lambda t: F.lower(text(t)))
    return F.exists(own, lambda t: F.coalesce(t.isin(*kinds), F.lit(False)))


def with_nodes(pages: DataFrame, html: Column, name: str = "nodes", depth: int = DEPTH) -> DataFrame:
    """Adds the nodes of a page's ld+json scripts, as array<variant>; scripts that are no JSON count for nothing.

    Levels are columns of their own, since each is read twice.
    """
    level = lambda k: F.col(f"_level{k}")
    bodies = F.coalesce(web.json_ld(html), F.array().cast("array<string>"))
    out = pages.withColumn("_level0", F.filter(F.transform(bodies, lambda b: F.try_parse_json(F.trim(b))), lambda v: v.isNotNull()))
    for k in range(depth):
        out = out.withColumn(f"_level{k + 1}", F.flatten(F.transform(level(k), elements)))
    return out.withColumn(name, F.concat(*[level(k) for k in range(depth + 1)])).drop(*[f"_level{k}" for k in range(depth + 1)])


def amount(raw: Column) -> Column:
    """A positive number of a price text; thousands commas and rupee signs go."""
    x = F.regexp_replace(raw, r"[,₹\s]", "").try_cast("double")
    return F.when(x > 0, x)


def offer_price(node: Column) -> Column:
    """The first positive price of a node's offers: one or a list, priced themselves or by offers inside them."""
    offers = listed(at(node, "offers"))
    inner = F.flatten(F.transform(offers, lambda o: listed(at(o, "offers"))))
    prices = F.transform(F.concat(offers, inner), lambda o: F.coalesce(amount(text(at(o, "price"))), amount(text(at(o, "lowPrice")))))
    return F.get(F.filter(prices, lambda p: p.isNotNull()), F.lit(0))


def image(node: Column) -> Column:
    """The first web address among a node's images (texts or objects with a url), one with an image's ending if there is any."""
    urls = F.filter(F.transform(listed(at(node, "image")), lambda i: F.coalesce(text(i), field(i, "url", "contentUrl"))), lambda u: F.startswith(u, F.lit("http")))
    shown = F.filter(urls, lambda u: F.regexp_like(F.lower(u), F.lit(r"\.(jpe?g|png|webp)(\?|$)")))
    return F.coalesce(F.get(shown, F.lit(0)), F.get(urls, F.lit(0)))


def code_like(title: Column) -> Column:
    """One word with a digit or all in capitals: a part number in a title's place."""
    return ~F.contains(title, F.lit(" ")) & (F.regexp_like(title, F.lit(r"\d")) | (F.regexp_like(title, F.lit("[A-Z]")) & (title == F.upper(title))))


def page_price(html: Column) -> Column:
    """A price that the page states outside structured data: price tags, then microdata, then a number after a rupee sign."""
    tags = [amount(web.meta(html, p)) for p in ("product:price:amount", "og:price:amount")]
    micro = F.regexp_extract(html, r"""(?i)itemprop=["']price["'][^>]*content=["']([\d.,]+)""", 1)
    stated = F.regexp_extract(html, r"(?:₹|&#8377;|\bRs\.?\s|\bINR\s)\s*(\d[\d,]{2,})", 1)
    return F.coalesce(*tags, F.when(micro != "", amount(micro)).otherwise(amount(stated)))


#: Kinds of organisation nodes, and the networks of the hosts in their links.
ORGANISATIONS = ("organization", "localbusiness", "corporation", "store", "onlinestore")
NETWORKS = {"facebook.com": "facebook", "instagram.com": "instagram", "twitter.com": "twitter", "x.com": "twitter", "linkedin.com": "linkedin", "youtube.com": "youtube", "pinterest.com": "pinterest"}


def with_organisation(pages: DataFrame, html: Column, name: str = "org") -> DataFrame:
    """Adds the fields of the page's first organisation, the shallowest one: a struct of nulls and an empty map without one."""
    found = with_nodes(pages, html, "_nodes").withColumn("_org", F.get(F.filter("_nodes", lambda n: has_type(n, *ORGANISATIONS)), F.lit(0)))
    placed = found.withColumn("_place", F.get(listed(at(F.col("_org"), "address")), F.lit(0)))
    return placed.withColumn(name, _organisation(F.col("_org"), F.col("_place"))).drop("_nodes", "_org", "_place")


def _organisation(org: Column, place: Column) -> Column:
    parts = {n: field(place, n) for n in ("streetAddress", "addressLocality", "addressRegion", "postalCode")}
    logo, links = at(org, "logo"), F.transform(listed(at(org, "sameAs")), text)

    def first_link(network: str) -> Column:
        hosts = [h for h, n in NETWORKS.items() if n == network]
        return F.get(F.filter(links, lambda u: reduce(lambda a, h: a | F.contains(u, F.lit(h)), hosts, F.lit(False))), F.lit(0))

    first = {n: first_link(n) for n in dict.fromkeys(NETWORKS.values())}
    social = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), u.alias("value")) for n, u in first.items()]), lambda e: e["value"].isNotNull()))
    return F.struct(
        field(org, "legalName", "name").alias("legal_name"), field(org, "telephone").alias("phone"), field(org, "email").alias("email"), F.nullif(F.array_join(F.array_compact(F.array(*parts.values())), ", "), F.lit("")).alias("address"),
        parts["addressLocality"].alias("city"), parts["addressRegion"].alias("state"), parts["postalCode"].alias("pincode"), F.coalesce(text(logo), field(logo, "url")).alias("logo_url"), F.left(field(org, "foundingDate"), F.lit(4)).alias("year_established"), social.alias("social"),
    )
