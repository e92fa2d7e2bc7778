"""Taxonomy, completeness score, verification tier, publish gate and catalogue quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.prices import FRESHER, LATEST, age_days, freshest
from orrery.registry import query
from orrery.relations import now, oracle, relation

# Ordered taxonomy rules (terms; family; category; class code). Terms match as substrings, the first rule wins.
RULES = (
    (("plant", "planter", "gardening", "pots"), "Decor & Greenery", "Plants & Planters", None),
    (("monitor arm", "monitor mount", "vesa", "sit-stand", "riser", "monitor arms"), "Furniture", "Ergonomic Accessories", "23-40 20 00"),
    (("sanitaryware", "bath_fitting", "bathware", "faucet", "washbasin", "water closet", "wc"), "Bath & Sanitary", "Sanitaryware & Fittings", "23-45 05 14"),
    (("plumbing", "pipe"), "Bath & Sanitary", "Plumbing", "23-45 00 00"),
    (("wallpaper", "mural", "wall_decor", "wall covering", "wallcovering"), "Surfaces", "Wallpaper & Wall Coverings", "23-35 10 00"),
    (("laminate",), "Surfaces", "Laminates", "23-35 10 00"),
    (("cladding", "louver", "veneer", "hpl", "panel", "acrylic"), "Surfaces", "Panels & Cladding", "23-35 10 00"),
    (("tile",), "Surfaces", "Tiles", "23-35 50 14"),
    (("quartz", "marble", "granite", "engineered stone", "countertop", "solid surface"), "Surfaces", "Stone & Engineered Surfaces", None),
    (("paint", "coating", "primer", "texture"), "Paint & Coatings", "Paint", "23-35 00 00"),
    (("rug", "carpet"), "Flooring", "Rugs & Carpets", "23-35 50 00"),
    (("wood_flooring", "wood flooring", "vinyl", "lvt", "flooring", "decking", "laminate_flooring"), "Flooring", "Hard Flooring", "23-35 50 00"),
    (("mattress",), "Furniture", "Mattresses", "23-40 20 00"),
    (("sofa", "recliner", "lounge", "couch"), "Furniture", "Sofas & Lounge", "23-40 20 14"),
    (("phone booth", "booth", "acoustic pod", "acoustic"), "Partitions & Acoustic", "Booths & Pods", None),
    (("seating", "chair", "stool", "workspace"), "Furniture", "Seating", "23-40 20 14"),
    (("workstation", "desk", "table", "worktable"), "Furniture", "Desks & Tables", "23-40 20 00"),
    (("storage", "wardrobe", "cabinet", "shelv", "casework"), "Furniture", "Storage", "23-40 20 24"),
    (("partition", "door"), "Partitions & Acoustic", "Partitions & Doors", None),
    (("fan",), "Lighting & Electrical", "Fans", None),
    (("lighting", "lamp", "luminaire", "light", "chandelier", "pendant"), "Lighting & Electrical", "Lighting", None),
    (("soft_furnishing", "bed_bath", "curtain", "fabric", "drapery", "cushion", "upholstery"), "Soft Furnishings", "Soft Furnishings", "23-40 00 00"),
    (("furniture",), "Furniture", "General Furniture", "23-40 20 00"),
    (("decor",), "Decor & Greenery", "Decor & Accessories", None),
)
# Points of present fields; surfaces count both sets
CORE = {"title": 10, "brand": 5, "image_url": 20, "category": 5, "fresh_price": 25, "source_url": 5}
SURFACE = {"size_mm": 10, "finish": 5, "price_unit": 10, "coverage_sqft_per_box": 5}
GATE = {"surface": 70, "default": 60}
STALE_DAYS = 90


def classify(category: Column, title: Column) -> Column:
    """Struct of family, category_std and omniclass: all rules on the category come before any rule on the title."""
    out = None
    for text in (category, title):
        low = F.lower(F.coalesce(text, F.lit("")))
        for rule in RULES:
            hit = None
            for t in rule[0]:
                one = F.contains(low, F.lit(t))
                hit = one if hit is None else hit | one
            node = F.struct(F.lit(rule[1]).alias("family"), F.lit(rule[2]).alias("category_std"), F.lit(rule[3]).cast("string").alias("omniclass"))
            out = F.when(hit, node) if out is None else out.when(hit, node)
    return out.otherwise(F.struct(F.lit("Other").alias("family"), F.lit("Unclassified").alias("category_std"), F.lit(None).cast("string").alias("omniclass")))


def _rules_sql(field: str, pick: int) -> str:
    cases = []
    for column in ("category", "title"):
        for rule in RULES:
            test = " OR ".join(f"contains(lower({column}), '{t}')" for t in rule[0])
            cases.append(f"WHEN {test} THEN " + ("NULL" if rule[pick] is None else "'" + rule[pick] + "'"))
    other = {1: "'Other'", 2: "'Unclassified'", 3: "NULL"}[pick]
    return f"CASE {' '.join(cases)} ELSE {other} END AS {field}"


CLASSIFIED = f"classified AS (SELECT *, {_rules_sql('family', 1)}, {_rules_sql('category_std', 2)}, {_rules_sql('omniclass', 3)} FROM product)"


def classified(products: DataFrame) -> DataFrame:
    return products.withColumn("_n", classify(F.col("category"), F.col("title"))).select(*products.columns, "_n.*")


@query(oracle("product", f"WITH {CLASSIFIED} SELECT id, family, category_std, omniclass FROM classified"))
def classify_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(relation(spark, sf_dir, "product")).select("id", "family", "category_std", "omniclass")


@query(oracle("product", f"WITH {CLASSIFIED} SELECT family, category_std, max(omniclass) AS omniclass, count(*) AS n, CAST(sum(CASE WHEN image_url IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS ready FROM classified GROUP BY family, category_std"))
def taxonomy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(relation(spark, sf_dir, "product")).groupBy("family", "category_std").agg(F.max("omniclass").alias("omniclass"), F.count("*").alias("n"), F.count("image_url").alias("ready"))


def is_surface(category: Column) -> Column:
    return F.regexp_like(F.lower(F.coalesce(category, F.lit(""))), F.lit("tile|paint|laminate|floor|veneer"))


def present(name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def scored(products: DataFrame, prices: DataFrame, day: str | None = None, price: str | None = None) -> DataFrame:
    """Adds price_age, surface, completeness (0-100), verification tier and publish_ready; the latest price too if price names it."""
    latest = freshest(prices, FRESHER[: 2 if price else 1]).withColumnsRenamed({"product_id": "id", "price_inr": price or "price_inr"})
    at = now(day) if day else now()
    p = products.join(latest, "id", "left").withColumn("price_age", age_days(F.col("observed_at"), at)).withColumn("surface", is_surface(F.col("category")))
    points = lambda table: sum((F.when(F.coalesce(F.col("price_age") <= STALE_DAYS, F.lit(False)) if f == "fresh_price" else present(f), w).otherwise(0) for f, w in table.items()), F.lit(0))
    got = points(CORE) + F.when(F.col("surface"), points(SURFACE)).otherwise(0)
    total = F.when(F.col("surface"), sum(CORE.values()) + sum(SURFACE.values())).otherwise(sum(CORE.values()))
    title = F.trim(F.coalesce("title", F.lit("")))
    wrong = (F.length(title) < 3) | F.regexp_like(F.lower(title), F.lit("^(untitled|default title|product|test)$"))
    wrong = wrong | (present("size_mm") & ~F.regexp_like(F.trim("size_mm"), F.lit(r"^\d+(\.\d+)?x\d+(\.\d+)?$"))) | F.coalesce(F.col("coverage_sqft_per_box") <= 0, F.lit(False))
    held = F.col("verification_tier") if "verification_tier" in products.columns else F.lit(None).cast("string")
    tier = F.when(held.isin("reviewed", "golden"), held).when(wrong, "unverified").otherwise("auto_validated")
    p = p.withColumn("completeness", F.bround(F.lit(100) * got / total).cast("int")).withColumn("tier", tier)
    gate = F.when(F.col("surface"), GATE["surface"]).otherwise(GATE["default"])
    return p.withColumn("publish_ready", (F.col("completeness") >= gate) & (F.col("tier") != "unverified") & present("source_url"))


_P = lambda c: f"({c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '')"
_PTS = lambda t: " + ".join(f"CASE WHEN {'COALESCE(price_age <= 90, false)' if f == 'fresh_price' else _P(f)} THEN {w} ELSE 0 END" for f, w in t.items())
SCORED = f"""{LATEST}, aged AS (SELECT p.*, (epoch_us($NOW) - epoch_us(l.observed_at)) / 86400000000.0 AS price_age, regexp_matches(lower(p.category), 'tile|paint|laminate|floor|veneer') AS surface FROM product p LEFT JOIN latest l ON l.product_id = p.id),
points AS (SELECT *, CAST(round_even(100 * CAST({_PTS(CORE)} + CASE WHEN surface THEN {_PTS(SURFACE)} ELSE 0 END AS DOUBLE) / CASE WHEN surface THEN 100 ELSE 70 END, 0) AS INTEGER) AS completeness,
  CASE WHEN length(trim(title)) < 3 OR ({_P('size_mm')} AND NOT regexp_matches(size_mm, '^\\d+(\\.\\d+)?x\\d+(\\.\\d+)?$')) OR COALESCE(coverage_sqft_per_box <= 0, false) THEN 'unverified' ELSE 'auto_validated' END AS tier FROM aged),
scored AS (SELECT *, completeness >= CASE WHEN surface THEN 70 ELSE 60 END AND tier <> 'unverified' AND {_P('source_url')} AS publish_ready FROM points)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(relation(spark, sf_dir, "product"), relation(spark, sf_dir, "price"))


@query(oracle("product price", f"WITH {SCORED} SELECT id, surface, completeness, tier, publish_ready FROM scored"))
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", "surface", "completeness", "tier", "publish_ready")


@query(oracle("product", "WITH k AS (SELECT lower(brand) AS b, size_mm, count(DISTINCT supplier_domain) AS n FROM product WHERE size_mm IS NOT NULL GROUP BY 1, 2) SELECT count(*) AS keys, count(CASE WHEN n >= 2 THEN 1 END) AS shared, round(count(CASE WHEN n >= 2 THEN 1 END) / count(*), 6) AS rate FROM k"))
def overlap_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = relation(spark, sf_dir, "product").filter("size_mm IS NOT NULL").groupBy(F.lower("brand").alias("b"), "size_mm").agg(F.countDistinct("supplier_domain").alias("n"))
    return k.agg(F.count("*").alias("keys"), F.count_if(F.col("n") >= 2).alias("shared"), F.round(F.count_if(F.col("n") >= 2) / F.count("*"), 6).alias("rate"))


@query(oracle("product price", f"WITH {SCORED}, o AS (SELECT list(completeness ORDER BY completeness) AS a FROM scored) SELECT count(*) AS total, count(CASE WHEN publish_ready THEN 1 END) AS ready, count(CASE WHEN tier = 'unverified' THEN 1 END) AS unverified, (SELECT a[len(a) // 2 + 1] FROM o) AS median FROM scored"))
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and the upper median; scores have at most 101 values, so the median comes from their counts."""
    from pyspark.sql import Window as W

    s = _scored(spark, sf_dir).groupBy("completeness").agg(F.count("*").alias("n"), F.count_if("publish_ready").alias("ready"), F.count_if(F.col("tier") == "unverified").alias("bad"))
    upto = s.withColumn("upto", F.sum("n").over(W.orderBy("completeness"))).withColumn("all", F.sum("n").over(W.partitionBy(F.lit(1))))
    return upto.agg(F.sum("n").alias("total"), F.sum("ready").alias("ready"), F.sum("bad").alias("unverified"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("completeness"))).alias("median"))


@query(oracle("product price", f"WITH {SCORED} SELECT category, count(*) AS n, CAST(trunc(avg(completeness)) AS INTEGER) AS median FROM scored GROUP BY category HAVING count(*) >= 200 ORDER BY avg(completeness), category LIMIT 8"))
def worst_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _scored(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.avg("completeness").alias("m")).filter("n >= 200")
    return g.orderBy("m", "category").limit(8).select("category", "n", F.col("m").cast("int").alias("median"))


@query(oracle("product price", f"WITH {SCORED}, r AS (SELECT count(*) AS total, count(CASE WHEN publish_ready THEN 1 END) AS ready, count(CASE WHEN surface THEN 1 END) AS surface FROM scored) SELECT 'catalog' AS scope, key, CAST(value AS DOUBLE) AS value FROM r UNPIVOT (value FOR key IN (total, ready, surface))"))
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot as rows (scope, key, value), ready to append to the metrics series."""
    r = _scored(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("publish_ready").alias("ready"), F.count_if("surface").alias("surface"))
    return r.selectExpr("'catalog' AS scope", "stack(3, 'total', total, 'ready', ready, 'surface', surface) AS (key, value)").withColumn("value", F.col("value").cast("double"))


@query(oracle("product price", f"WITH {SCORED} SELECT supplier_domain AS domain, count(*) AS n, CAST(least(count(*), 100) AS BIGINT) AS priority FROM scored WHERE NOT publish_ready AND source_url IS NOT NULL GROUP BY 1"))
def enrich_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products below the gate that have a page to read again, per supplier."""
    todo = _scored(spark, sf_dir).filter(~F.col("publish_ready") & F.col("source_url").isNotNull())
    return todo.groupBy(F.col("supplier_domain").alias("domain")).agg(F.count("*").alias("n")).withColumn("priority", F.least("n", F.lit(100)).cast("long"))


@query(oracle("product price", f"WITH {SCORED} SELECT id, completeness FROM scored WHERE title IS NOT NULL ORDER BY COALESCE(completeness, 0) DESC, id LIMIT 100"))
def value_order_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next hundred products for enrichment, most complete first."""
    return _scored(spark, sf_dir).filter("title IS NOT NULL").select("id", "completeness").orderBy(F.coalesce("completeness", F.lit(0)).desc(), "id").limit(100)


@query(oracle("product", "SELECT id, concat_ws('|', " + ", ".join(f"CASE WHEN regexp_matches(category, 'tile|paint|laminate') AND {c} IS NULL THEN '{c}' END" for c in ("price_unit", "coverage_sqft_per_box", "size_mm", "finish")) + ") AS missing FROM product"))
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit fields that a surface must have and has not."""
    lacking = [F.when(is_surface(F.col("category")) & F.col(c).isNull(), F.lit(c)) for c in ("price_unit", "coverage_sqft_per_box", "size_mm", "finish")]
    return relation(spark, sf_dir, "product").select("id", F.concat_ws("|", *lacking).alias("missing"))
