"""Registry upserts, embeddings, batch collection, probe decisions, claim checks and other record-level queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.functions.colour import ciede2000
from orrery.operators.monitor import COSTED, with_cost
from orrery.operators.quality import SCORED, scored
from orrery.registry import query
from orrery.relations import oracle, relation
from orrery.session import read_table

# Use-case tags in order, each with the words that are evidence for it
USE_CASES = {
    "bathroom": ("bathroom", "bath ", "sanitary", "washroom", "shower", "toilet", "vanity", "lavatory", "wc "),
    "kitchen": ("kitchen", "backsplash", "splashback", "countertop", "worktop"),
    "living-room": ("living room", "living-room", "lounge", "drawing room"),
    "bedroom": ("bedroom", "headboard"),
    "outdoor": ("outdoor", "exterior", "facade", "garden", "terrace", "balcony", "frost", "weatherproof", "parking", "driveway", "alfresco", "landscape"),
    "commercial": ("commercial", "office", "hospitality", "hotel", "retail", "showroom", "institutional", "corporate", "mall", "airport", "restaurant", "cafe", "lobby", "workspace"),
    "residential": ("residential",),
    "high-traffic": ("high traffic", "high-traffic", "heavy duty", "heavy-duty", "anti-skid", "anti skid", "antiskid", "anti-static", "anti static", "antistatic", "conductive", "industrial", "warehouse"),
    "wet-area": ("wet area", "wet-area", "pool", "swimming", "spa", "wetroom"),
    "flooring": ("floor", "flooring", "vitrified", "underfoot"),
    "wall": ("wall", "cladding", "elevation", "wainscot"),
    "facade": ("facade", "ventilated facade", "exterior elevation"),
    "backsplash": ("backsplash", "splashback"),
    "countertop": ("countertop", "worktop", "vanity top"),
    "office": ("office", "workstation", "cubicle", "boardroom", "desk"),
    "hospitality": ("hospitality", "hotel", "resort", "restaurant", "banquet", "lounge"),
}


@query(oracle("product", "SELECT id, array_to_string([trim(x) FOR x IN string_split(lower(replace(category, '|', ' / ')), '/') IF trim(x) <> ''], '|') AS categories FROM product"))
def seed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slash-separated categories of the legacy registry as a pipe list."""
    raw = F.lower(F.replace("category", F.lit("|"), F.lit(" / ")))
    return relation(spark, sf_dir, "product").select("id", F.array_join(F.filter(F.transform(F.split(raw, "/"), lambda x: F.trim(x)), lambda x: x != ""), "|").alias("categories"))


@query(oracle("supplier", """WITH n AS (SELECT domain, upper(brand) AS brand, 'seed' AS notes FROM supplier_rel WHERE supplier_id % 2 = 0 UNION ALL SELECT 'new.example.com', 'NEW', 'seed')
SELECT COALESCE(n.domain, o.domain) AS domain, COALESCE(n.brand, o.brand) AS brand, o.scrape_tier, n.notes FROM supplier_rel o FULL OUTER JOIN n ON n.domain = o.domain"""))
def seed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity columns come from the seed, probed columns survive."""
    old = relation(spark, sf_dir, "supplier")
    new = old.filter("supplier_id % 2 = 0").select("domain", F.upper("brand").alias("b"), F.lit("seed").alias("notes")).union(spark.createDataFrame([("new.example.com", "NEW", "seed")], "domain string, b string, notes string"))
    return old.join(new, "domain", "full_outer").select("domain", F.coalesce("b", "brand").alias("brand"), "scrape_tier", "notes")


@query(oracle("product", "SELECT id, CASE WHEN regexp_matches(category, 'tile|paint|laminate') AND (price_unit IS NULL OR coverage_sqft_per_box IS NULL) THEN 'units' WHEN COALESCE(coverage_sqft_per_box, 1) <= 0 THEN 'coverage' END AS reason FROM product WHERE (regexp_matches(category, 'tile|paint|laminate') AND (price_unit IS NULL OR coverage_sqft_per_box IS NULL)) OR COALESCE(coverage_sqft_per_box, 1) <= 0"))
def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = F.regexp_like("category", F.lit("tile|paint|laminate"))
    reason = F.when(surface & (F.col("price_unit").isNull() | F.col("coverage_sqft_per_box").isNull()), "units").when(F.coalesce("coverage_sqft_per_box", F.lit(1)) <= 0, "coverage")
    return relation(spark, sf_dir, "product").select("id", reason.alias("reason")).filter("reason IS NOT NULL")


@query("SELECT label AS kind, vec_id % 50 AS product_id, max(vec_id) AS vec_id, round(arg_max(embedding[1], vec_id), 6) AS first FROM embeddings GROUP BY 1, 2")
def embedding_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write per (product, kind)."""
    g = read_table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("kind"), (F.col("vec_id") % 50).alias("product_id"))
    return g.agg(F.max("vec_id").alias("vec_id"), F.round(F.max_by("embedding", "vec_id")[0], 6).alias("first"))


@query("SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'supplier', count(*) FROM supplier")
def backup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts that a restored copy has to show."""
    parts = [read_table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("part", "orders", "supplier")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT page_id, regexp_matches(split_part(split_part(lower(url), '://', 2), '/', 1), '(^|\\.)(example\\.net|example\\.org)$|^(cdn|img|static)\\.') AS cdn FROM pages")
def cdn_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that serve for others, which are fetched faster than a supplier's own."""
    host = F.lower(F.parse_url("url", F.lit("HOST")))
    return read_table(spark, sf_dir, "pages").select("page_id", F.regexp_like(host, F.lit(r"(^|\.)(example\.net|example\.org)$|^(cdn|img|static)\.")).alias("cdn"))


@query(oracle("product price", "SELECT p.supplier_domain AS domain, count(DISTINCT p.id) AS priced FROM product p JOIN price o ON o.product_id = p.id GROUP BY 1"))
def supplier_priced_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced products per supplier; a semi join keeps observations from multiplying rows."""
    seen = relation(spark, sf_dir, "price").select(F.col("product_id").alias("id"))
    return relation(spark, sf_dir, "product").join(seen, "id", "left_semi").groupBy(F.col("supplier_domain").alias("domain")).agg(F.count("*").alias("priced"))


@query(oracle("job call", "SELECT DISTINCT target FROM job WHERE status = 'done' AND target NOT IN (SELECT concat('supplier-', CAST(product_id AS VARCHAR), '.example.com') FROM call WHERE model = 'flash')"))
def orphan_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished work that the ledger has not recorded."""
    known = relation(spark, sf_dir, "call").filter("model = 'flash'").select(F.concat(F.lit("supplier-"), F.col("product_id").cast("string"), F.lit(".example.com")).alias("target"))
    return relation(spark, sf_dir, "job").filter("status = 'done'").select("target").distinct().join(known, "target", "left_anti")


@query(oracle("call", "SELECT model, count(*) AS n, round(count(*) FILTER (status = 'enriched') / count(*), 6) AS pass_rate, round(count(*) FILTER (status = 'api_error') / count(*), 6) AS malformed_rate FROM call GROUP BY model"))
def ab_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda s: F.round(F.count_if(F.col("status") == s) / F.count("*"), 6)
    return relation(spark, sf_dir, "call").groupBy("model").agg(F.count("*").alias("n"), share("enriched").alias("pass_rate"), share("api_error").alias("malformed_rate"))


@query("WITH x AS (SELECT doc_id, concat(text, CASE WHEN doc_id % 10 = 0 THEN ' GSTIN 27ABCDE1234F1Z5' ELSE '' END, CASE WHEN doc_id % 15 = 0 THEN ' CIN L12345MH2001PLC123456' ELSE '' END) AS t FROM documents) SELECT doc_id, nullif(regexp_extract(t, '\\b(\\d{2}[A-Z]{5}\\d{4}[A-Z][1-9A-Z]Z[0-9A-Z])\\b', 1), '') AS gstin, nullif(regexp_extract(t, '\\b([LU]\\d{5}[A-Z]{2}\\d{4}[A-Z]{3}\\d{6})\\b', 1), '') AS cin FROM x")
def extract_tax_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.when(F.col("doc_id") % 10 == 0, " GSTIN 27ABCDE1234F1Z5").otherwise(""), F.when(F.col("doc_id") % 15 == 0, " CIN L12345MH2001PLC123456").otherwise(""))
    one = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return read_table(spark, sf_dir, "documents").select("doc_id", one(T.GSTIN).alias("gstin"), one(T.CIN).alias("cin"))


@query(oracle("product", "SELECT id, nullif(replace(trim(regexp_replace(regexp_replace(concat('<b>', title, '</b>  &amp; ', category), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '&amp;', '&'), '') AS clean FROM product"))
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "product").select("id", T.sanitize(F.concat(F.lit("<b>"), "title", F.lit("</b>  &amp; "), "category")).alias("clean"))


DIFFERENCE = """WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) * 2 AS l1, CAST(p_partkey % 41 AS DOUBLE) - 20 AS a1, CAST(p_partkey % 37 AS DOUBLE) - 18 AS b1, 55.0::DOUBLE AS l2, 12.0::DOUBLE AS a2, -7.0::DOUBLE AS b2 FROM part),
g AS (SELECT *, 0.5 * (1 - sqrt(pow((sqrt(a1*a1+b1*b1) + sqrt(a2*a2+b2*b2)) / 2, 7) / (pow((sqrt(a1*a1+b1*b1) + sqrt(a2*a2+b2*b2)) / 2, 7) + pow(25.0::DOUBLE, 7)))) AS g FROM p),
c AS (SELECT *, sqrt(a1*(1+g)*a1*(1+g)+b1*b1) AS c1, sqrt(a2*(1+g)*a2*(1+g)+b2*b2) AS c2, CASE WHEN a1 = 0 AND b1 = 0 THEN 0 ELSE degrees(atan2(b1, a1*(1+g))) END AS r1, degrees(atan2(b2, a2*(1+g))) AS r2 FROM g),
h AS (SELECT *, CASE WHEN r1 < 0 THEN r1 + 360 ELSE r1 END AS h1, CASE WHEN r2 < 0 THEN r2 + 360 ELSE r2 END AS h2 FROM c),
d AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS turn, CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh, (l1 + l2) / 2 AS ml, (c1 + c2) / 2 AS mc FROM h),
t AS (SELECT *, 1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) - 0.2 * cos(radians(4 * mh - 63)) AS t FROM d),
z AS (SELECT id, (l2 - l1) / (1 + 0.015 * pow(ml - 50, 2) / sqrt(20 + pow(ml - 50, 2))) AS x, (c2 - c1) / (1 + 0.045 * mc) AS y, 2 * sqrt(c1 * c2) * sin(radians(turn / 2)) / (1 + 0.015 * mc * t) AS z, -2 * sqrt(pow(mc, 7) / (pow(mc, 7) + pow(25.0::DOUBLE, 7))) * sin(radians(60 * exp(-pow((mh - 275) / 25, 2)))) AS rt FROM t)
SELECT id, round(sqrt(x*x + y*y + z*z + rt*y*z), 4) AS difference FROM z"""


@query(DIFFERENCE)
def colour_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda v: F.lit(v).cast("double")
    p = F.col("p_partkey")
    d = ciede2000(F.col("p_size").cast("double") * 2, (p % 41).cast("double") - 20, (p % 37).cast("double") - 18, n(55), n(12), n(-7))
    return read_table(spark, sf_dir, "part").select(p.alias("id"), F.round(d, 4).alias("difference"))


_TAGS = ", ".join(f"CASE WHEN {' OR '.join(f'''contains(t, '{w}')''' for w in words)} THEN '{tag}' END" for tag, words in USE_CASES.items())


@query(oracle("product", f"WITH x AS (SELECT id, lower(concat(' ', title, ' ', category, ' ')) AS t FROM product) SELECT id, array_to_string(list_filter([{_TAGS}], lambda x: x IS NOT NULL)[1:3], '|') AS tags FROM x"))
def use_case_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("title", F.lit(" "), "category")
    return relation(spark, sf_dir, "product").select("id", F.array_join(T.tags(text, USE_CASES), "|").alias("tags"))


def probe_decision(feed: Column, store: Column, product: Column, priced: Column, blocked: Column) -> Column:
    """Tier from what a probe saw: the first rung that holds decides."""
    return F.when(blocked, "blocked").when(feed, "shopify").when(store, "woocommerce").when(product & priced, "jsonld").when(product, "jsonld-unpriced").otherwise("tier3")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 13 = 0 THEN 'blocked' WHEN s_suppkey % 5 = 0 THEN 'shopify' WHEN s_suppkey % 7 = 0 THEN 'woocommerce' WHEN s_suppkey % 2 = 0 AND s_acctbal > 0 THEN 'jsonld' WHEN s_suppkey % 2 = 0 THEN 'jsonld-unpriced' ELSE 'tier3' END AS tier FROM supplier")
def probe_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read_table(spark, sf_dir, "supplier").select(k.alias("id"), probe_decision(k % 5 == 0, k % 7 == 0, k % 2 == 0, F.col("s_acctbal") > 0, k % 13 == 0).alias("tier"))


def invented_numbers(claim: Column, source: Column) -> Column:
    """Numbers of a claim that its source does not hold."""
    return F.filter(F.regexp_extract_all(claim, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: ~F.contains(F.coalesce(source, F.lit("")), n))


@query(oracle("product", "WITH x AS (SELECT id, concat('Measures ', COALESCE(size_mm, 'any'), ', ', CAST(id % 9 AS VARCHAR), ' years, best in class') AS claim, concat_ws(' ', title, size_mm) AS src FROM product) SELECT id, array_to_string([n FOR n IN regexp_extract_all(claim, '\\d+(?:\\.\\d+)?') IF NOT contains(src, n)], '|') AS invented, contains(lower(claim), 'best in class') AS banned FROM x"))
def verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented numbers and one banned phrase of generated claims; enrichment.claim_checks has every check."""
    claim = F.concat(F.lit("Measures "), F.coalesce("size_mm", F.lit("any")), F.lit(", "), (F.col("id") % 9).cast("string"), F.lit(" years, best in class"))
    return relation(spark, sf_dir, "product").select("id", F.array_join(invented_numbers(claim, F.concat_ws(" ", "title", "size_mm")), "|").alias("invented"), F.contains(F.lower(claim), F.lit("best in class")).alias("banned"))


@query(oracle("call", "WITH r AS (SELECT product_id, max(id) AS id FROM call GROUP BY product_id) SELECT c.product_id, c.status, CASE WHEN c.status = 'enriched' THEN 'store' WHEN c.attempt < 2 THEN 'retry' ELSE 'give up' END AS next FROM call c JOIN r ON r.id = c.id"))
def batch_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens next to each product after a batch came back: its last answer decides."""
    last = relation(spark, sf_dir, "call").groupBy("product_id").agg(F.max_by(F.struct("status", "attempt"), "id").alias("x"))
    step = F.when(F.col("x.status") == "enriched", "store").when(F.col("x.attempt") < 2, "retry").otherwise("give up")
    return last.select("product_id", "x.status", step.alias("next"))


@query(oracle("price", "SELECT supplier, count(DISTINCT product_id) FILTER (observed_at < TIMESTAMP '2000-01-01') AS before, count(DISTINCT product_id) - count(DISTINCT product_id) FILTER (observed_at < TIMESTAMP '2000-01-01') AS net_new FROM price GROUP BY supplier"))
def net_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that a supplier's later harvests added: first sightings are counted once per product."""
    first = relation(spark, sf_dir, "price").groupBy("supplier", "product_id").agg(F.min("observed_at").alias("at"))
    old = F.col("at") < F.lit("2000-01-01").cast("timestamp_ntz")
    return first.groupBy("supplier").agg(F.count_if(old).alias("before"), F.count_if(~old).alias("net_new"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS price FROM part")
def positive_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices from text: thousands separators go, zero and words are no price."""
    p = F.col("p_partkey")
    text = F.when(p % 3 == 0, F.element_at(F.array(F.lit("0.00"), F.lit("on request"), F.lit("")), (p % 2 + 1).cast("int"))).otherwise(F.col("p_retailprice").cast("string"))
    return read_table(spark, sf_dir, "part").select(p.alias("id"), T.positive_price(text).alias("price"))


FIELDS = ("title", "brand", "category", "size_mm", "finish")


@query(oracle("product", "WITH x AS (SELECT id, list_filter([" + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN '[{f}]: ' || {f} END" for f in FIELDS) + "], lambda x: x IS NOT NULL) AS a FROM product) SELECT id, array_to_string([concat('f', CAST(i AS VARCHAR), ' ', a[i]) FOR i IN range(1, len(a) + 1)], chr(10)) AS lines FROM x"))
def serialise_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled fields as numbered lines, for a prompt."""
    filled = F.array_compact(F.array(*[F.concat(F.lit(f"[{f}]: "), F.col(f)) for f in FIELDS]))
    return relation(spark, sf_dir, "product").select("id", F.array_join(F.transform(filled, lambda x, i: F.concat(F.lit("f"), (i + 1).cast("string"), F.lit(" "), x)), "\n").alias("lines"))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events")
def usage_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts from usage JSON; a missing part counts as zero."""
    part = lambda name: F.coalesce(F.get_json_object("props", f"$.{name}").cast("long"), F.lit(0))
    return read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (part("k") + part("thoughts")).alias("tokens"))


@query(oracle("product price", f"WITH {SCORED} SELECT id, supplier_domain FROM (SELECT *, row_number() OVER (PARTITION BY supplier_domain ORDER BY id) AS k FROM scored WHERE NOT publish_ready AND source_url IS NOT NULL) WHERE k <= 5"))
def enrich_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five products of each supplier that are worth reading again."""
    from pyspark.sql import Window as W

    todo = scored(relation(spark, sf_dir, "product"), relation(spark, sf_dir, "price")).filter(~F.col("publish_ready") & F.col("source_url").isNotNull())
    return todo.withColumn("k", F.row_number().over(W.partitionBy("supplier_domain").orderBy("id"))).filter("k <= 5").select("id", "supplier_domain")


@query(oracle("call", f"WITH {COSTED} SELECT id, CAST(cost AS DOUBLE) AS cost, model IN ('flash', 'lite') AS known FROM costed"))
def ledger_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cost(relation(spark, sf_dir, "call")).select("id", F.col("cost").cast("double").alias("cost"), F.col("model").isin("flash", "lite").alias("known"))


@query("SELECT page_id, [x FOR x IN string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/') IF x <> ''][1] AS category FROM pages")
def url_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.functions import web

    return read_table(spark, sf_dir, "pages").select("page_id", F.try_element_at(web.segments(F.col("url")), F.lit(1)).alias("category"))


@query(oracle("product", "WITH x AS (SELECT id, concat('Size: ', COALESCE(size_mm, '-'), ' mm; Thickness: ', CAST(id % 20 AS VARCHAR), ' mm; Coverage: ', COALESCE(CAST(coverage_sqft_per_box AS VARCHAR), '-'), ' sqft') AS s FROM product) SELECT id, TRY_CAST(regexp_extract(s, 'Thickness: (\\d+)', 1) AS INTEGER) AS thickness, TRY_CAST(nullif(regexp_extract(s, 'Coverage: (\\d+\\.\\d+)', 1), '') AS DOUBLE) AS coverage FROM x"))
def spec_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thickness and coverage from a line of specifications."""
    s = F.concat(F.lit("Size: "), F.coalesce("size_mm", F.lit("-")), F.lit(" mm; Thickness: "), (F.col("id") % 20).cast("string"), F.lit(" mm; Coverage: "), F.coalesce(F.col("coverage_sqft_per_box").cast("string"), F.lit("-")), F.lit(" sqft"))
    return relation(spark, sf_dir, "product").select("id", F.regexp_extract(s, r"Thickness: (\d+)", 1).cast("int").alias("thickness"), F.nullif(F.regexp_extract(s, r"(?<!-)Coverage: (\d+\.\d+)", 1), F.lit("")).cast("double").alias("coverage"))
