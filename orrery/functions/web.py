"""Column builders for urls, html and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain(url: Column) -> Column:
    """Host in lower case without scheme, user, port and leading www."""
    host = F.regexp_replace(F.lower(F.trim(url)), "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "[/?#].*$", ""), "^.*@", ""), r":\d*$", "")
    return F.regexp_replace(F.regexp_replace(host, r"^\.+|\.+$", ""), r"^www\.", "")


def segments(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "")
    return F.filter(F.split(path, "/"), lambda x: x != "")


def url_slug(url: Column) -> Column:
    return F.try_element_at(segments(url), F.lit(-1))


def strip_tags(html: Column) -> Column:
    body = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, "(?s)<[^>]+>", " "), r"\s+", " "))


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first tag of this name, null without one or if it is blank."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(inner, "(?s)<[^>]+>", " "), r"\s+", " ")), F.lit(""))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?href="([^"]*)"'), F.lit(1))


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag, with the attributes in either order."""
    a = F.regexp_extract(html, rf'(?is)<meta\b[^>]*?(?:property|name)="{name}"[^>]*?content="([^"]*)"', 1)
    b = F.regexp_extract(html, rf'(?is)<meta\b[^>]*?content="([^"]*)"[^>]*?(?:property|name)="{name}"', 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def sitemap_urls(xml: Column) -> Column:
    """All <loc> of a sitemap or an index, namespaces apart, without asset files."""
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1))
    return F.filter(found, lambda u: ~F.regexp_like(F.lower(u), F.lit(r"\.(jpg|jpeg|png|gif|webp|svg|css|js|pdf|mp4)(\?|$)")))


def json_ld(html: Column) -> Column:
    """Bodies of ld+json scripts, control characters replaced by spaces."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"[\x00-\x1f]+", " "))
