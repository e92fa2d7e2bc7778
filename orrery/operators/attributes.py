"""Attribute, url and page queries over the column builders in orrery.functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.functions import web
from orrery.registry import query
from orrery.relations import oracle, relation
from orrery.session import read_table

COLOUR_SQL = " ".join(f"WHEN '{w}' THEN '{c}|{f}'" for w, (c, f) in T.COLOURS.items())
SPACE_SQL = "regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'gs'), '\\s+', ' ', 'g')"


@query(oracle("product", """WITH x AS (SELECT id, title, regexp_extract(title, '(\\d+)x(\\d+) mm', ['a', 'b']) AS mm, regexp_extract(title, '(\\d+)x(\\d+) ft', ['a', 'b']) AS ft, regexp_extract(title, '(\\d+) x (\\d+) cm', ['a', 'b']) AS cm FROM product)
SELECT id, CASE WHEN mm.a <> '' THEN concat(mm.a, 'x', mm.b) WHEN cm.a <> '' THEN concat(CAST(TRY_CAST(cm.a AS INT) * 10 AS VARCHAR), 'x', CAST(TRY_CAST(cm.b AS INT) * 10 AS VARCHAR)) WHEN ft.a <> '' THEN concat(CAST(CAST(round_even(COALESCE(TRY_CAST(ft.a AS DOUBLE), 0) * 304.8, 0) AS INT) AS VARCHAR), 'x', CAST(CAST(round_even(COALESCE(TRY_CAST(ft.b AS DOUBLE), 0) * 304.8, 0) AS INT) AS VARCHAR)) END AS size_mm FROM x"""))
def extract_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "product").select("id", T.size_mm(F.col("title")).alias("size_mm"))


@query(oracle("product", "SELECT id, CAST(nullif(regexp_extract(title, 'Teak (\\d+) mm', 1), '') AS DOUBLE) AS thickness_mm FROM product"))
def extract_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "product").select("id", T.thickness_mm(F.col("title")).alias("thickness_mm"))


@query(oracle("product", "SELECT id, CASE WHEN regexp_matches(title, '(?i)\\bgloss(y)?\\b') THEN 'Glossy' WHEN regexp_matches(title, '(?i)\\bmatte?\\b') THEN 'Matte' WHEN regexp_matches(title, '(?i)\\bsatin\\b') THEN 'Satin' END AS finish FROM product"))
def extract_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "product").select("id", T.finish(F.col("title")).alias("finish"))


@query(oracle("product", f"""WITH x AS (SELECT id, CASE lower(regexp_extract(title, '(?i)\\b({'|'.join(T.COLOURS)})\\b', 1)) {COLOUR_SQL} END AS hit FROM product)
SELECT id, split_part(hit, '|', 1) AS color, split_part(hit, '|', 2) AS family FROM x"""))
def extract_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, family = T.colour(F.col("title"))
    return relation(spark, sf_dir, "product").select("id", name.alias("color"), family.alias("family"))


@query(oracle("product", """WITH x AS (SELECT id, category, TRY_CAST(split_part(size_mm, 'x', 1) AS DOUBLE) / 304.8 * (TRY_CAST(split_part(size_mm, 'x', 2) AS DOUBLE) / 304.8) AS area FROM product)
SELECT id, CASE WHEN contains(category, 'laminate') AND area BETWEEN 4 AND 64 THEN round(area, 2) END AS coverage FROM x"""))
def sheet_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "product").select("id", T.sheet_coverage(F.col("size_mm"), F.col("category")).alias("coverage"))


@query(oracle("product", "SELECT id, concat(trim(regexp_replace(lower(category), '[^a-z0-9]+', '-', 'g'), '-'), '.', trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-')) AS slug, concat('v4:', substr(sha1(concat(title, '|', COALESCE(source_url, ''))), 1, 16)) AS hash FROM product"))
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "product").select("id", T.slug(F.col("category"), F.col("title")).alias("slug"), T.novelty_hash(F.col("title"), F.col("source_url")).alias("hash"))


@query(oracle("product", "SELECT id, regexp_matches(lower(category), 'tile|paint|laminate|floor|veneer') AS surface, regexp_matches(trim(lower(title)), '^(untitled|default title|product|test)$') AS placeholder FROM product"))
def surface_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c, p: F.regexp_like(F.lower(c), F.lit(p))
    return relation(spark, sf_dir, "product").select("id", flag(F.col("category"), "tile|paint|laminate|floor|veneer").alias("surface"), flag(F.trim("title"), "^(untitled|default title|product|test)$").alias("placeholder"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct([lower(x) FOR x IN regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b') IF NOT contains(lower(x), 'example.com') AND NOT regexp_matches(lower(x), '\\.(png|jpg|gif|webp)$')])), '|') AS emails FROM documents""")
def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.emails(F.col("text")), "|").alias("emails"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?:^|[^0-9])([6-9][0-9]{9})(?:$|[^0-9])', 1))), '|') AS phones FROM (SELECT doc_id, regexp_replace(text, '([^0-9])', '\\1\\1', 'g') AS text FROM documents)""")
def extract_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-digit mobile numbers that no other digit touches."""
    found = F.regexp_extract_all("text", F.lit(r"(?<!\d)([6-9]\d{9})(?!\d)"), F.lit(1))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), "|").alias("phones"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[/?#].*$', ''), '^www\\.', '') AS domain, CAST(len([x FOR x IN string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/') IF x <> '']) AS INTEGER) AS depth FROM pages")
def normalize_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", web.domain(F.col("url")).alias("domain"), F.size(web.segments(F.col("url"))).alias("depth"))


@query("SELECT page_id, [x FOR x IN string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/') IF x <> ''][-1] AS slug FROM pages")
def url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", web.url_slug(F.col("url")).alias("slug"))


@query(f"""SELECT page_id, nullif(trim({SPACE_SQL.format("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")}), '') AS h1, nullif(trim({SPACE_SQL.format("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")}), '') AS title FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", web.tag_text(F.col("html"), "h1").alias("h1"), web.tag_text(F.col("html"), "title").alias("title"))


@query("SELECT page_id, u.link AS link FROM pages, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?href=\"([^\"]*)\"', 1)) AS u(link)")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", F.explode(web.links(F.col("html"))).alias("link"))


@query("""SELECT page_id, CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b[^>]*>.*?</script>', ' ', 'gis'), '<style\\b[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '\\s+', ' ', 'g'))) AS INTEGER) AS n FROM pages""")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", F.length(web.strip_tags(F.col("html"))).alias("n"))


@query("SELECT p_partkey AS id, CAST(ceil(p_size * 10 * 1.1 / (CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size * 0.7 END) - 1e-9) AS BIGINT) AS boxes FROM part")
def bom_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes for an area with 10% waste; without a positive coverage there is no answer."""
    area, cover = F.col("p_size") * 10, F.when(F.col("p_size") % 4 != 0, F.col("p_size") * F.lit(0.7))
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), boxes(area, cover, F.lit(0.1)).alias("boxes"))


def boxes(area, coverage, waste) -> F.Column:
    return F.when((coverage > 0) & (area >= 0) & (waste >= 0), F.ceil(area * (1 + waste) / coverage - F.lit(1e-9)))
