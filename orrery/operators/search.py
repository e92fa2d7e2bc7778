"""Keyword search (BM25), vector search, reciprocal-rank fusion and similar items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.nearest import nearest_of_kind
from orrery.operators.prices import LATEST, freshest
from orrery.registry import query
from orrery.relations import oracle, relation
from orrery.session import read_table

K1, B, RRF = 1.2, 0.75, 60


def prefix_terms(text: str) -> list[str]:
    """Words of a query, each matched as a prefix."""
    import re

    return list(dict.fromkeys(re.findall("[a-z0-9]+", text.lower())))


def bm25(docs: DataFrame, text: str, k: int = 20) -> DataFrame:
    """id, score: Okapi BM25 over (id, body), words matched by prefix, ties to the smaller id.

    Term frequencies are counted inside each row; the corpus sums are one aggregation of one row.
    """
    terms = prefix_terms(text)
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    low = F.lower(F.coalesce("body", F.lit("")))
    counted = docs.select("id", F.regexp_count(low, F.lit("[a-z0-9]+")).alias("len"), *[F.regexp_count(low, F.lit(f"(?<![a-z0-9]){t}")).alias(f"tf{i}") for i, t in enumerate(terms)])
    sums = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hit = counted.filter(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(sums))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        tf = F.col(f"tf{i}")
        score += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return hit.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


BM25_SQL = """words AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
tf AS (SELECT id, len(w) AS len, len([x FOR x IN w IF starts_with(x, 'wor')]) AS t0, len([x FOR x IN w IF starts_with(x, 'gen')]) AS t1 FROM words),
c AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM tf),
kw AS (SELECT id, round(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * len / mean)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score FROM tf, c WHERE t0 > 0 OR t1 > 0 ORDER BY score DESC, id LIMIT 20)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))


@query(f"WITH {BM25_SQL} SELECT id, score FROM kw")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(_documents(spark, sf_dir), "Wor, gen!")


def unit(v) -> F.Column:
    """L2-normalised; a zero vector stays zero."""
    x = F.transform(v, lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e))
    return F.transform(x, lambda e: F.when(norm > 0, e / norm).otherwise(F.lit(0.0)))


def dot(a, b) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


VEC_SQL = """u AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings)"""


@query(f"WITH {VEC_SQL} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round([x / sqrt(list_inner_product(v, v)) FOR x IN v][1], 6) AS first FROM u")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda e: e.cast("double"))
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(dot(x, x)), 6).alias("norm"), F.round(unit(F.col("embedding"))[0], 6).alias("first"))


def nearest(vectors: DataFrame, probe: DataFrame, k: int) -> DataFrame:
    """vec_id, score of the k rows nearest by cosine to one probe row (v), ties to the smaller id."""
    rows = vectors.select("vec_id", unit(F.col("embedding")).alias("v"))
    scored = rows.crossJoin(F.broadcast(probe.limit(1).select(F.col("v").alias("q"))))  # one row
    return scored.select("vec_id", F.round(dot(F.col("v"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").filter("vec_id = 7").select(unit(F.col("embedding")).alias("v"))


COS = "list_inner_product(a.v, q.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(q.v, q.v)))"


@query(f"WITH {VEC_SQL} SELECT a.vec_id, round({COS}, 6) AS score FROM u a, u q WHERE q.vec_id = 7 ORDER BY score DESC, a.vec_id LIMIT 7")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 7)


def fuse(keyword: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """id, score: sum of 1 / (60 + rank) over both ranked arms (id, score); ties: keyword rank first, then the other's.

    Both arms are top-k lists, so ranking them in one place is bounded.
    """
    def ranked(arm: DataFrame, name: str) -> DataFrame:
        return arm.select("id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias(name))

    both = ranked(keyword, "kw").join(ranked(semantic, "sem"), "id", "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + RRF), F.lit(0.0))
    return both.select("id", F.round(part("kw") + part("sem"), 6).alias("score"), "kw", "sem").orderBy(F.desc("score"), F.asc_nulls_last("kw"), F.asc_nulls_last("sem")).limit(k).select("id", "score")


RRF_SQL = f"""{BM25_SQL}, {VEC_SQL}, sm AS (SELECT a.vec_id AS id, round({COS}, 6) AS score FROM u a, u q WHERE q.vec_id = 7 ORDER BY score DESC, id LIMIT 20),
k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM kw), s AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM sm),
f AS (SELECT COALESCE(k.id, s.id) AS id, round(COALESCE(1.0::DOUBLE / (60 + k.r), 0) + COALESCE(1.0::DOUBLE / (60 + s.r), 0), 6) AS score, k.r AS kr, s.r AS sr FROM k FULL OUTER JOIN s ON k.id = s.id ORDER BY score DESC, kr NULLS LAST, sr NULLS LAST LIMIT 12)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    semantic = nearest(read_table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 20).withColumnRenamed("vec_id", "id")
    return fuse(bm25(_documents(spark, sf_dir), "wor gen"), semantic, 12)


@query(f"WITH {RRF_SQL} SELECT id, score FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)


@query(oracle("product price", f"WITH {LATEST}, {RRF_SQL} SELECT f.id, f.score, p.title, l.price_inr FROM f JOIN product p ON p.id = f.id LEFT JOIN latest l ON l.product_id = f.id"))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits with product and freshest price; only the hits' prices are read into the aggregation."""
    hits = F.broadcast(_fused(spark, sf_dir))  # at most k rows
    prices = relation(spark, sf_dir, "price").join(hits.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    latest = freshest(prices).select(F.col("product_id").alias("id"), "price_inr")
    return relation(spark, sf_dir, "product").join(hits, "id").join(latest, "id", "left").select("id", "score", "title", "price_inr")


@query(f"""WITH {VEC_SQL}, p AS (SELECT q.vec_id AS id, a.vec_id AS near_id, round({COS}, 4) AS score FROM u q JOIN u a ON a.label = q.label AND a.vec_id <> q.vec_id WHERE q.vec_id < 20)
SELECT id, near_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, near_id) AS k FROM p) WHERE k <= 6""")
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six most similar items of the same kind for a page of twenty items, which is what a product page asks for."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", unit(F.col("embedding")).alias("v"))
    page = e.filter("vec_id < 20").select(F.col("vec_id").alias("id"), "label", F.col("v").alias("q"))
    pairs = e.join(F.broadcast(page), "label").filter("vec_id <> id")  # a page of twenty
    scored = pairs.select("id", F.col("vec_id").alias("near_id"), F.round(dot(F.col("v"), F.col("q")), 4).alias("score"))
    k = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "near_id"))
    return scored.withColumn("k", k).filter("k <= 6").drop("k")


@query(f"""WITH {VEC_SQL}, p AS (SELECT q.vec_id AS id, a.vec_id AS near_id, round({COS}, 4) AS score FROM u q JOIN u a ON a.label = q.label AND a.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT id, near_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, near_id) AS k FROM p) WHERE k <= 6""")
def similar_items_by_hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six most similar items of the same kind for every id divisible by 100, a number that grows with the table."""
    e = read_table(spark, sf_dir, "embeddings")
    return nearest_of_kind(e, e.filter("vec_id % 100 = 0"), k=6)


@query("SELECT label, count(*) AS n, CAST(max(len(embedding)) AS INTEGER) AS dim FROM embeddings GROUP BY label")
def embedding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))


@query(oracle("product", "SELECT id, concat_ws('. ', title, split_part(category, '|', 1), 'size ' || size_mm, finish || ' finish') AS body FROM product"))
def product_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that an embedder sees; missing parts are left out."""
    return relation(spark, sf_dir, "product").select("id", F.concat_ws(". ", "title", F.split_part("category", F.lit("|"), F.lit(1)), F.concat(F.lit("size "), "size_mm"), F.concat("finish", F.lit(" finish"))).alias("body"))
