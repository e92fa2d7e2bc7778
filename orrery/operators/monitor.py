"""Job queue, refresh cadence, yield drift, demand metrics and cost accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.prefix import running_sum
from orrery.registry import query
from orrery.relations import now, oracle, relation
from orrery.session import read_table

LEAST, DROP, SPIKE, LEASE = 20, 0.30, 0.5, 1800  # fixed values: least yield, drop, quarantined share, lease in seconds

LAST = """last AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY observed_at DESC) AS k, lead(products) OVER (PARTITION BY domain ORDER BY observed_at DESC) AS prev FROM harvest)"""


def latest_two(history: DataFrame) -> DataFrame:
    """Newest harvest of each domain with the yield before it."""
    w = W.partitionBy("domain").orderBy(F.col("observed_at").desc())
    return history.withColumn("k", F.row_number().over(w)).withColumn("prev", F.lead("products").over(w)).filter("k = 1")


def drifted(last: DataFrame) -> DataFrame:
    drop = F.bround(F.lit(100) * (F.lit(1) - F.col("products") / F.col("prev")), 1)
    return last.filter((F.col("prev") >= LEAST) & (F.col("products") < F.col("prev") * (1 - DROP))).select("domain", "prev", F.col("products").alias("latest"), drop.alias("drop_pct"))


@query(oracle("harvest", f"WITH {LAST} SELECT domain, prev, products AS latest, round_even(100 * (1 - products / prev), 1) AS drop_pct FROM last WHERE k = 1 AND prev >= 20 AND products < prev * 0.7"))
def yield_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drifted(latest_two(relation(spark, sf_dir, "harvest")))


# Harvests by year and accepted and quarantined rows: a stand-in with shares on both sides of SPIKE
HARVESTS = """SELECT concat('d', CAST(o_custkey % 10 AS STRING)) AS domain, date_trunc('year', o_orderdate) AS observed_at,
  count(*) FILTER (WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderkey % 2 = 0)) AS products,
  count(*) FILTER (WHERE o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderkey % 2 = 1)) AS quarantined FROM {0} GROUP BY 1, 2"""
_LATEST = f"h AS ({HARVESTS.format('orders')}), last AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY observed_at DESC) AS k, lead(products) OVER (PARTITION BY domain ORDER BY observed_at DESC) AS prev FROM h)"


def harvests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HARVESTS.format("{orders}"), orders=read_table(spark, sf_dir, "orders"))


def spiked(last: DataFrame) -> DataFrame:
    """Latest harvests of at least LEAST rows with more than the share SPIKE quarantined."""
    total = F.coalesce("products", F.lit(0)) + F.coalesce("quarantined", F.lit(0))
    return last.filter((total >= LEAST) & (F.coalesce("quarantined", F.lit(0)) > total * SPIKE)).select("domain", "products", "quarantined")


@query(f"WITH {_LATEST} SELECT domain, products, quarantined FROM last WHERE k = 1 AND products + quarantined >= 20 AND quarantined > (products + quarantined) * 0.5")
def quarantine_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiked(latest_two(harvests(spark, sf_dir)))


@query(f"""WITH {_LATEST}, d AS (SELECT domain, 'yield_drop' AS reason FROM last WHERE k = 1 AND prev >= 20 AND products < prev * 0.7), s AS (SELECT domain, 'quarantine_spike' AS reason FROM last WHERE k = 1 AND products + quarantined >= 20 AND quarantined > (products + quarantined) * 0.5)
SELECT domain, reason FROM d UNION ALL SELECT domain, reason FROM s WHERE domain NOT IN (SELECT domain FROM d)""")
def drift_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair list; a yield drop wins over a spike of the same domain."""
    last = latest_two(harvests(spark, sf_dir))
    drop = drifted(last).select("domain", F.lit("yield_drop").alias("reason"))
    return drop.unionByName(spiked(last).select("domain", F.lit("quarantine_spike").alias("reason")).join(drop, "domain", "left_anti"))


@query(oracle("job", "SELECT s.status, count(j.id) AS n FROM (VALUES ('pending'), ('running'), ('done'), ('failed')) s(status) LEFT JOIN job j ON j.status = s.status GROUP BY s.status"))
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(s,) for s in ("pending", "running", "done", "failed")], "status string")
    n = relation(spark, sf_dir, "job").groupBy("status").agg(F.count("*").alias("n"))
    return names.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def claimable(jobs: DataFrame, at: Column) -> DataFrame:
    """Pending jobs, and running ones whose lease has run out."""
    stale = F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(F.col("updated_at").cast("timestamp")) > LEASE
    return jobs.filter((F.col("status") == "pending") | ((F.col("status") == "running") & stale))


@query(oracle("job", "SELECT id, stage, target FROM job WHERE status = 'pending' OR (status = 'running' AND epoch($NOW) - epoch(updated_at) > 1800) ORDER BY priority DESC, id LIMIT 50"))
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claimable(relation(spark, sf_dir, "job"), now()).orderBy(F.desc("priority"), "id").limit(50).select("id", "stage", "target")


def after_failure(jobs: DataFrame) -> DataFrame:
    """State after a failed run: one more attempt, dead at the limit, else pending after min(60 * 2 ** (n - 1), 3600) seconds."""
    n = F.col("attempts") + 1
    return jobs.withColumn("attempts", n).withColumn("status", F.when(F.col("attempts") >= F.col("max_attempts"), "failed").otherwise("pending")).withColumn("wait_s", F.when(F.col("status") == "pending", F.least(F.lit(60) * F.pow(F.lit(2), F.col("attempts") - 1), F.lit(3600)).cast("long")))


@query(oracle("job", "SELECT id, CAST(attempts + 1 AS INTEGER) AS attempts, CASE WHEN attempts + 1 >= max_attempts THEN 'failed' ELSE 'pending' END AS status, CASE WHEN attempts + 1 < max_attempts THEN CAST(least(60 * pow(2, attempts), 3600) AS BIGINT) END AS wait_s FROM job WHERE status = 'running'"))
def queue_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after_failure(relation(spark, sf_dir, "job").filter("status = 'running'")).select("id", "attempts", "status", "wait_s")


def enqueue(jobs: DataFrame, new: DataFrame, reset: bool = False) -> DataFrame:
    """The queue after adding (stage, target, priority, max_attempts): one job per stage and target. A job that is there stays as it is, or starts anew with reset."""
    key = ["stage", "target"]
    asked = new.dropDuplicates(key).select(*key, F.col("priority").alias("p"), F.col("max_attempts").alias("m"), F.lit(True).alias("asked"))
    q = jobs.join(asked, key, "full_outer")
    fresh = F.col("status").isNull() | (F.lit(reset) & F.col("asked").isNotNull())
    pick = lambda name, value: F.when(fresh, value).otherwise(F.col(name)).alias(name)
    return q.select("id", *key, pick("status", F.lit("pending")), pick("attempts", F.lit(0)), pick("max_attempts", F.col("m")), pick("priority", F.col("p")))


def claimed(jobs: DataFrame, at: Column, most: int) -> DataFrame:
    """The queue after a claim of up to `most` eligible jobs, by priority and id, which are then running since `at`."""
    mine = claimable(jobs, at).orderBy(F.desc("priority"), "id").limit(most).select("id", F.lit(True).alias("mine"))
    q = jobs.join(mine, "id", "left")
    return q.select(*[F.when(F.col("mine"), x).otherwise(F.col(c)).alias(c) if (x := {"status": F.lit("running"), "updated_at": at}.get(c)) is not None else F.col(c) for c in jobs.columns])


def completed(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The queue after the jobs of ids (id, result) are done; their last error goes."""
    return jobs.join(ids.select("id", F.coalesce("result", F.lit("{}")).alias("result")), "id", "left").withColumn("status", F.when(F.col("result").isNotNull(), "done").otherwise(F.col("status")))


def requeued(jobs: DataFrame, at: Column) -> DataFrame:
    """The queue with running jobs whose lease has run out pending again."""
    stale = (F.col("status") == "running") & (F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(F.col("updated_at").cast("timestamp")) > LEASE)
    return jobs.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def revived(jobs: DataFrame, stage: str | None = None) -> DataFrame:
    """The queue with failed jobs (of a stage) pending, without attempts."""
    dead = (F.col("status") == "failed") & (F.lit(True) if stage is None else F.col("stage") == stage)
    return jobs.withColumn("attempts", F.when(dead, 0).otherwise(F.col("attempts"))).withColumn("status", F.when(dead, "pending").otherwise(F.col("status")))


@query(oracle("job supplier", """WITH q AS (SELECT min(id) AS id, stage, target, min(status) AS status, CAST(max(attempts) AS INTEGER) AS attempts FROM job GROUP BY stage, target), n AS (SELECT 'harvest' AS stage, domain AS target FROM supplier_rel WHERE supplier_id % 2 = 0 UNION SELECT 'repair', domain FROM supplier_rel WHERE supplier_id % 3 = 0)
SELECT q.id, COALESCE(q.stage, n.stage) AS stage, COALESCE(q.target, n.target) AS target, CASE WHEN n.stage IS NOT NULL THEN 'pending' ELSE status END AS status, CASE WHEN n.stage IS NOT NULL THEN 0 ELSE attempts END AS attempts FROM q FULL OUTER JOIN n ON n.stage = q.stage AND n.target = q.target"""))
def queue_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old jobs of even suppliers start anew, repairs of every third are added."""
    old = relation(spark, sf_dir, "job").groupBy("stage", "target").agg(F.min("id").alias("id"), F.min("status").alias("status"), F.max("attempts").alias("attempts"), F.max("max_attempts").alias("max_attempts"), F.max("priority").alias("priority"))
    s = relation(spark, sf_dir, "supplier")
    new = s.filter("supplier_id % 2 = 0").select(F.lit("harvest").alias("stage"), F.col("domain").alias("target")).unionByName(s.filter("supplier_id % 3 = 0").select(F.lit("repair").alias("stage"), F.col("domain").alias("target")))
    return enqueue(old, new.withColumns({"priority": F.lit(1), "max_attempts": F.lit(4)}), reset=True).select("id", "stage", "target", "status", F.col("attempts").cast("int").alias("attempts"))


@query(oracle("job", """WITH c AS (SELECT id FROM job WHERE status = 'pending' OR (status = 'running' AND epoch($NOW) - epoch(updated_at) > 1800) ORDER BY priority DESC, id LIMIT 50), q AS (SELECT j.id, CASE WHEN c.id IS NOT NULL THEN 'running' ELSE status END AS status, CASE WHEN c.id IS NOT NULL THEN $NOW ELSE updated_at END AS updated_at FROM job j LEFT JOIN c ON c.id = j.id)
SELECT CASE WHEN id % 10 = 0 AND status = 'running' THEN 'done' WHEN status = 'running' AND epoch($NOW) + 60 - epoch(updated_at) > 1800 THEN 'pending' ELSE status END AS status, count(*) AS n FROM q GROUP BY 1"""))
def queue_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after a claim, completion of every tenth running job and, a minute later, return of stale ones."""
    q = claimed(relation(spark, sf_dir, "job"), now(), 50)
    q = completed(q, q.filter("id % 10 = 0 AND status = 'running'").select("id", F.lit("{}").alias("result")))
    return requeued(q, now() + F.expr("INTERVAL 60 SECOND")).groupBy("status").agg(F.count("*").alias("n"))


@query(oracle("job", "SELECT id, CASE WHEN dead AND stage = 'harvest' THEN 'pending' WHEN dead THEN 'failed' ELSE status END AS status, CASE WHEN dead AND stage = 'harvest' THEN 0 ELSE attempts END AS attempts FROM (SELECT *, status <> 'done' AND attempts >= max_attempts AS dead FROM job)"))
def queue_retry_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters of one stage are revived, the others stay dead."""
    dead = (F.col("status") != "done") & (F.col("attempts") >= F.col("max_attempts"))
    jobs = relation(spark, sf_dir, "job").withColumn("status", F.when(dead, "failed").otherwise(F.col("status")))
    return revived(jobs, "harvest").select("id", "status", "attempts")


@query(oracle("job", "SELECT id, stage, target, attempts FROM job WHERE attempts >= max_attempts AND status <> 'done'"))
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "job").filter("attempts >= max_attempts AND status <> 'done'").select("id", "stage", "target", "attempts")


DUE_AT = "2001-08-05"


@query(oracle("job supplier", """WITH j AS (SELECT target, max(updated_at) AS last FROM job WHERE stage = 'harvest' AND status = 'done' GROUP BY target)
SELECT j.target, s.scrape_tier FROM j JOIN supplier_rel s ON s.domain = j.target WHERE j.last < $NOW - CASE WHEN s.scrape_tier IN ('shopify', 'woocommerce') THEN INTERVAL 1 DAY WHEN s.scrape_tier = 'jsonld' AND s.price_published = 'yes' THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END""", DUE_AT))
def due_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Done harvests older than their tier's cadence: a day, a week, thirty days."""
    j = relation(spark, sf_dir, "job").filter("stage = 'harvest' AND status = 'done'").groupBy(F.col("target").alias("domain")).agg(F.max("updated_at").alias("last"))
    days = F.when(F.col("scrape_tier").isin("shopify", "woocommerce"), 1).when((F.col("scrape_tier") == "jsonld") & (F.col("price_published") == "yes"), 7).otherwise(30)
    due = j.join(relation(spark, sf_dir, "supplier"), "domain").filter(F.col("last") < now(DUE_AT) - F.make_dt_interval(days))
    return due.select(F.col("domain").alias("target"), "scrape_tier")


@query(oracle("product price", "SELECT id FROM product WHERE id NOT IN (SELECT product_id FROM price WHERE observed_at >= TIMESTAMP '2001-06-01')"))
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that no recent observation has seen: what a resumed harvest still has to read."""
    seen = relation(spark, sf_dir, "price").filter("observed_at >= TIMESTAMP_NTZ '2001-06-01'").select(F.col("product_id").alias("id"))
    return relation(spark, sf_dir, "product").join(seen, "id", "left_anti").select("id")


@query(oracle("job supplier", "SELECT domain, scrape_tier FROM supplier_rel WHERE status = 'active' AND scrape_tier IN ('shopify', 'woocommerce', 'jsonld') AND domain NOT IN (SELECT target FROM job WHERE stage = 'harvest' AND priority = 1 AND status = 'pending')"))
def seed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One harvest job per active supplier of an allowed tier that has none waiting."""
    waiting = relation(spark, sf_dir, "job").filter("stage = 'harvest' AND priority = 1 AND status = 'pending'").select(F.col("target").alias("domain"))
    allowed = relation(spark, sf_dir, "supplier").filter("status = 'active' AND scrape_tier IN ('shopify', 'woocommerce', 'jsonld')")
    return allowed.join(waiting, "domain", "left_anti").select("domain", "scrape_tier")


def demand(events: DataFrame, since: str) -> DataFrame:
    """Counts by kind, sessions and click-through of one window, in one pass."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    e = events.filter(F.col("occurred_at") >= F.lit(since).cast("timestamp_ntz"))
    out = e.agg(F.countDistinct("session_id").alias("active_sessions"), kind("search").alias("searches"), kind("product_view").alias("product_views"), kind("result_click").alias("result_clicks"), kind("quote_request").alias("quote_requests"))
    return out.withColumn("search_ctr", F.when(F.col("searches") > 0, F.round(F.col("result_clicks") / F.col("searches"), 3)).otherwise(0.0))


@query(oracle("event", """WITH e AS (SELECT * FROM event WHERE occurred_at >= TIMESTAMP '2024-01-24')
SELECT count(DISTINCT session_id) AS active_sessions, count(*) FILTER (kind = 'search') AS searches, count(*) FILTER (kind = 'product_view') AS product_views, count(*) FILTER (kind = 'result_click') AS result_clicks, count(*) FILTER (kind = 'quote_request') AS quote_requests, COALESCE(round(count(*) FILTER (kind = 'result_click') / nullif(count(*) FILTER (kind = 'search'), 0), 3), 0.0) AS search_ctr FROM e"""))
def demand_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand(relation(spark, sf_dir, "event"), "2024-01-24")


# Dollars per million input and output tokens, and rupees per dollar; unknown models take the dearest rate
RATES = {"flash": (1.50, 9.00), "lite": (0.25, 1.50)}
DEAREST, RUPEES = (1.50, 9.00), 83.0


def with_cost(calls: DataFrame, batch: bool = False) -> DataFrame:
    """Adds cost in rupees, as a decimal so that sums do not depend on their order."""
    rate = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for m, r in RATES.items() for x in (m, r[i])]), F.col("model")), F.lit(DEAREST[i]))
    usd = F.col("input_tokens") / F.lit(1e6) * rate(0) + F.col("output_tokens") / F.lit(1e6) * rate(1)
    return calls.withColumn("cost", F.round(usd * F.lit((0.5 if batch else 1.0) * RUPEES), 4).cast("decimal(18,4)"))


COSTED = "costed AS (SELECT *, CAST(round((input_tokens / 1e6 * CASE model WHEN 'lite' THEN 0.25::DOUBLE ELSE 1.5::DOUBLE END + output_tokens / 1e6 * CASE model WHEN 'lite' THEN 1.5::DOUBLE ELSE 9.0::DOUBLE END) * 83.0::DOUBLE, 4) AS DECIMAL(18,4)) AS cost FROM call)"


@query(oracle("call", f"WITH {COSTED} SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cost) AS DOUBLE) AS cost, round(count(*) FILTER (status = 'enriched') / nullif(count(*) FILTER (status IN ('enriched', 'verifier_failed')), 0), 6) AS pass_rate FROM costed GROUP BY model"))
def ledger_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens, cost and the pass rate; api errors count neither way."""
    good, judged = F.count_if(F.col("status") == "enriched"), F.count_if(F.col("status").isin("enriched", "verifier_failed"))
    return with_cost(relation(spark, sf_dir, "call")).groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("cost").cast("double").alias("cost"), F.round(good / F.nullif(judged, F.lit(0)), 6).alias("pass_rate"))


@query(oracle("call", "SELECT count(*) AS calls, count(*) FILTER (status = 'enriched') AS passed, count(*) FILTER (status = 'verifier_failed') AS failed, round(count(*) FILTER (status = 'enriched') / nullif(count(*) FILTER (status IN ('enriched', 'verifier_failed')), 0), 6) AS pass_rate FROM call"))
def ledger_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of judged calls that pass, over the whole ledger; null if none was judged."""
    n = lambda s: F.count_if(F.col("status") == s)
    c = relation(spark, sf_dir, "call").agg(F.count("*").alias("calls"), n("enriched").alias("passed"), n("verifier_failed").alias("failed"))
    return c.withColumn("pass_rate", F.round(F.col("passed") / F.nullif(F.col("passed") + F.col("failed"), F.lit(0)), 6))


@query(oracle("call", f"WITH {COSTED} SELECT day, count(*) AS calls, CAST(sum(cost) AS DOUBLE) AS cost FROM costed GROUP BY day ORDER BY day DESC LIMIT 14"))
def ledger_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cost(relation(spark, sf_dir, "call")).groupBy("day").agg(F.count("*").alias("calls"), F.sum("cost").cast("double").alias("cost")).orderBy(F.desc("day")).limit(14)


def reconciled(calls: DataFrame, bills: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """ours, billed, divergence, halt of each bill (billed) against the whole ledger; the difference is relative to the bill, and halts beyond the tolerance."""
    ours = with_cost(calls).agg(F.round(F.coalesce(F.sum("cost").cast("double"), F.lit(0.0)), 4).alias("ours"))
    off = F.when(F.col("billed") != 0, F.abs(F.col("ours") - F.col("billed")) / F.col("billed")).otherwise(F.when(F.col("ours") != 0, 1.0).otherwise(0.0))
    return bills.crossJoin(ours).select("ours", F.round("billed", 2).alias("billed"), F.round(off, 3).alias("divergence"), (off > tolerance).alias("halt"))  # one row of ours


BILLS = (0.0, 30.0, 60.0, 90.0, 120.0, 150.0)


@query(oracle("call", f"WITH {COSTED}, s AS (SELECT round(CAST(sum(cost) AS DOUBLE), 4) AS ours FROM costed), b AS (SELECT unnest([0.0, 30.0, 60.0, 90.0, 120.0, 150.0])::DOUBLE AS billed), d AS (SELECT ours, billed, CASE WHEN billed <> 0 THEN abs(ours - billed) / billed WHEN ours <> 0 THEN 1.0 ELSE 0.0 END AS off FROM b, s) SELECT ours, round(billed, 2) AS billed, round(off, 3) AS divergence, off > 0.1 AS halt FROM d"))
def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger against several bills, one of them nothing."""
    return reconciled(relation(spark, sf_dir, "call"), spark.createDataFrame([(x,) for x in BILLS], "billed double"))


@query(oracle("call product", "SELECT c.id, c.model, c.status, p.title FROM call c LEFT JOIN product p ON p.id = c.product_id ORDER BY c.id DESC LIMIT 40 OFFSET 10"))
def ledger_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page is cut before titles are looked up."""
    cut = relation(spark, sf_dir, "call").orderBy(F.desc("id")).offset(10).limit(40)
    titles = relation(spark, sf_dir, "product").select(F.col("id").alias("product_id"), "title")
    return cut.join(titles, "product_id", "left").select("id", "model", "status", "title")


@query(oracle("call", "SELECT product_id, (SELECT fail_reason FROM call x WHERE x.product_id = c.product_id AND fail_reason IS NOT NULL ORDER BY id DESC LIMIT 1) AS reason FROM (SELECT DISTINCT product_id FROM call) c"))
def last_failure_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "call").groupBy("product_id").agg(F.max_by("fail_reason", F.when(F.col("fail_reason").isNotNull(), F.col("id"))).alias("reason"))


@query(oracle("call", f"WITH {COSTED} SELECT id FROM (SELECT id, model, sum(cost) OVER (PARTITION BY model, day ORDER BY id ROWS UNBOUNDED PRECEDING) AS spent FROM costed) WHERE spent <= 1.5"))
def budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each model and day until the day's budget is spent."""
    return running_sum(with_cost(relation(spark, sf_dir, "call")).select("id", "model", "day", "cost"), ["model", "day"], ["id"], "cost", "spent").filter("spent <= 1.5").select("id")


def metrics_by_arm(calls: DataFrame) -> DataFrame:
    n = F.count("*")
    return calls.groupBy("model").agg(F.round(F.count_if(F.col("status") == "enriched") / n, 6).alias("pass_rate"), F.round(F.count_if(F.col("status") == "api_error") / n, 6).alias("malformed_rate"))


def decide(flash: DataFrame, lite: DataFrame) -> DataFrame:
    """The rule for arms without colour and keyword rates: more than 2% malformed loses, else the pass rate may be at most two points lower. enrichment.decide_arms has all of it."""
    f, x = flash.select(F.col("pass_rate").alias("fp")), lite.select(F.col("pass_rate").alias("lp"), F.col("malformed_rate").alias("lm"))
    return f.crossJoin(x).select(F.when(F.col("lm") > 0.02, "flash").when(F.col("lp") >= F.col("fp") - 0.02, "lite").otherwise("flash").alias("winner"))  # one row each


@query(oracle("call", """WITH m AS (SELECT model, round(count(*) FILTER (status = 'enriched') / count(*), 6) AS p, round(count(*) FILTER (status = 'api_error') / count(*), 6) AS b FROM call GROUP BY model)
SELECT CASE WHEN l.b > 0.02 THEN 'flash' WHEN l.p >= f.p - 0.02 THEN 'lite' ELSE 'flash' END AS winner FROM m f, m l WHERE f.model = 'flash' AND l.model = 'lite'"""))
def ab_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics_by_arm(relation(spark, sf_dir, "call"))
    return decide(m.filter("model = 'flash'"), m.filter("model = 'lite'"))
