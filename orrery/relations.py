"""The catalogue's relations as views over the driver tables, in Spark and (CTE) as DuckDB SQL.

product <- part, price <- lineitem, supplier <- supplier and nation, dealer <- customer and nation,
harvest <- orders by month and priority, job <- orders, event <- events, call <- conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import read_table

#: The reference date of ages and windows; queries take it as a parameter so that results can be repeated.
NOW = "2001-11-05"

PRODUCT = """
SELECT p_partkey AS id,
  concat('supplier-', CAST(p_partkey % 100 AS STRING), '.example.com') AS supplier_domain,
  p_brand AS brand,
  CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat(p_name, ' 600x600 mm Glossy White') WHEN 1 THEN concat(p_name, ' 8x4 ft Matte Teak 18 mm')
    WHEN 3 THEN concat(p_name, ' 60 x 30 cm Satin Grey') ELSE p_name END AS title,
  CASE p_type WHEN 'ECONOMY' THEN 'tile|surface' WHEN 'PROMO' THEN 'laminates|panel' WHEN 'LARGE' THEN 'sofas|lounge'
    WHEN 'SMALL' THEN 'lighting|lamp' WHEN 'MEDIUM' THEN 'paint' ELSE 'misc goods' END AS category,
  CASE WHEN p_size % 3 = 0 THEN concat(CAST(p_size * 10 AS STRING), 'x', CAST(p_size * 20 AS STRING)) WHEN p_size % 7 = 0 THEN 'n/a' END AS size_mm,
  CASE WHEN p_size % 2 = 0 THEN 'Matte' END AS finish,
  CASE WHEN p_size % 5 <> 0 THEN 'sqft' END AS price_unit,
  CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DOUBLE) * 1.5 WHEN p_size % 8 = 0 THEN CAST(-1 AS DOUBLE) END AS coverage_sqft_per_box,
  CASE WHEN p_partkey % 5 <> 0 THEN concat('https://img.example.com/', CAST(p_partkey % 700 AS STRING), '.jpg') END AS image_url,
  CASE WHEN p_partkey % 11 <> 0 THEN concat('https://supplier-', CAST(p_partkey % 100 AS STRING), '.example.com/products/', CAST(p_partkey AS STRING)) END AS source_url
FROM part
"""
PRICE = """
SELECT l_partkey AS product_id, l_extendedprice / l_quantity AS price_inr, l_shipdate AS observed_at, l_suppkey AS supplier,
  l_returnflag AS basis, concat('https://s', CAST(l_suppkey AS STRING), '.example.com') AS source_url, l_orderkey AS order_key, l_linenumber AS line
FROM lineitem
"""
SUPPLIER = """
SELECT concat('supplier-', CAST(s_suppkey AS STRING), '.example.com') AS domain, s_name AS brand, n_name AS state,
  CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 'shopify' WHEN 1 THEN 'woocommerce' WHEN 2 THEN 'jsonld' WHEN 3 THEN 'jsonld' ELSE 'tier3' END AS scrape_tier,
  CASE WHEN s_suppkey % 2 = 0 THEN 'yes' ELSE 'no' END AS price_published,
  CASE WHEN s_suppkey % 7 = 0 THEN 'paused' ELSE 'active' END AS status,
  CAST(floor(s_acctbal) AS BIGINT) AS sku_estimate, s_suppkey AS supplier_id
FROM supplier JOIN nation ON n_nationkey = s_nationkey
"""
DEALER = """
SELECT c_custkey AS id, concat('supplier-', CAST(c_custkey % 100 AS STRING), '.example.com') AS supplier_domain, c_name AS name,
  n_name AS state, c_mktsegment AS city, CASE WHEN c_custkey % 3 <> 0 THEN CAST(100000 + c_custkey % 50 AS STRING) END AS pincode
FROM customer JOIN nation ON n_nationkey = c_nationkey
"""
HARVEST = """
SELECT o_orderpriority AS domain, date_trunc('month', o_orderdate) AS observed_at, count(*) AS products,
  count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS quarantined
FROM orders GROUP BY o_orderpriority, date_trunc('month', o_orderdate)
"""
JOB = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'harvest' ELSE 'enrich' END AS stage,
  concat('supplier-', CAST(o_custkey % 100 AS STRING), '.example.com') AS target,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END AS status,
  CAST(o_orderkey % 5 AS INT) AS attempts, 3 AS max_attempts, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS updated_at
FROM orders
"""
EVENT = """
SELECT event_id AS id, ts AS occurred_at, user_id AS session_id,
  CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'result_click' WHEN 'purchase' THEN 'quote_request' WHEN 'signup' THEN 'product_view' ELSE 'other' END AS kind
FROM events
"""
CALL = """
SELECT conv_id * 1000 + turn AS id, conv_id AS product_id,
  CASE CAST(conv_id % 3 AS INT) WHEN 0 THEN 'flash' WHEN 1 THEN 'lite' ELSE 'unlisted' END AS model,
  length(text) AS input_tokens, length(text) * 2 AS output_tokens, CAST(turn AS INT) AS attempt,
  CASE WHEN role = 'user' THEN 'enriched' WHEN turn % 3 = 1 THEN 'verifier_failed' ELSE 'api_error' END AS status,
  CASE WHEN role <> 'user' AND turn % 3 = 1 THEN concat('reason ', CAST(turn AS STRING)) END AS fail_reason,
  CAST(conv_id % 28 AS INT) AS day
FROM conversations
"""
SOURCES = {"product": ("part", PRODUCT), "price": ("lineitem", PRICE), "supplier": ("supplier nation", SUPPLIER), "dealer": ("customer nation", DEALER), "harvest": ("orders", HARVEST), "job": ("orders", JOB), "event": ("events", EVENT), "call": ("conversations", CALL)}
ALIAS = {"supplier": "supplier_rel", "product": "product", "price": "price"}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One relation; its tables are named inside the SQL text, so nothing is registered in the session."""
    tables, text = SOURCES[name]
    frames = {t: read_table(spark, sf_dir, t) for t in tables.split()}
    for t in frames:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **frames)


def oracle(names: str, body: str, now: str = NOW) -> str:
    """DuckDB SQL with the named relations as CTEs (supplier is called supplier_rel there)."""
    parts = [f"{'supplier_rel' if n == 'supplier' else n} AS ({SOURCES[n][1]})" for n in names.split()]
    body = body.strip().replace("$NOW", f"TIMESTAMP '{now}'")
    if body.upper().startswith("WITH "):
        body = body[5:]
        return f"WITH {', '.join(parts)}, {body}"
    return f"WITH {', '.join(parts)} {body}"


def now(day: str = NOW):
    return F.lit(day).cast("timestamp_ntz")
