"""The life of model requests in batches: submitted under a budget, collected, applied once, retried, swept, adopted.

The state of all keys is a versioned table; every step is a batch of it with a name, so that a step that ran twice, or
died and ran again, leaves the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.enrichment import batch_plan
from orrery.operators.prefix import running_sum
from orrery.registry import query
from orrery.relations import oracle, relation
from orrery.session import shared_folder
from orrery.sources.snapshots import Snapshots, latest

STATE = "key long, status string, attempt int, day int"
MERGE = latest(["key"])  # a step's rows replace what was there


def request_state(spark: SparkSession, path: str, blocks: int = 64) -> Snapshots:
    """The state table: status is pending, submitted, enriched or failed; day is the last change's."""
    return Snapshots(spark, path, STATE, ["key"], blocks)


def submit(state: Snapshots, batch: str, day: int, cost: Column, budget: int) -> bool:
    """Submits pending keys, fewest attempts first, as long as the running sum of cost (whole numbers) stays within budget."""
    if state.applied(batch):
        return False
    waiting = state.read().filter("status = 'pending'").select("key", "attempt", cost.cast("long").alias("cost"))
    fits = running_sum(waiting, [], ["attempt", "key"], "cost", "total").filter(F.col("total") <= budget)
    return state.apply(batch, fits.select("key", F.lit("submitted").alias("status"), "attempt", F.lit(day).alias("day")), MERGE)


def collect(state: Snapshots, batch: str, day: int, results: DataFrame, patience: int = 2, retries: int = 2) -> bool:
    """Applies results (key, status) to submitted keys by batch_plan; waiting keys stay as they are.

    A stored answer is enriched; a refused one is pending again with one more attempt, or failed after `retries`; a key
    swept after `patience` days is pending again; an answer that nobody waits for is taken as it came.
    """
    if state.applied(batch):
        return False
    now = state.read()
    asked = now.filter("status = 'submitted'").select("key", F.col("day").alias("submitted"), "attempt")
    steps = batch_plan(asked, results, day, patience, retries).filter("step <> 'wait'")
    known = steps.join(now.select("key", "attempt"), "key", "left").join(results.select("key", F.col("status").alias("came")), "key", "left")
    answered = F.when(F.col("came") == "enriched", "enriched").otherwise("failed")
    status = F.when(F.col("step") == "store", "enriched").when(F.col("step").isin("retry", "sweep"), "pending").when(F.col("step") == "adopt", answered).otherwise("failed")
    attempt = F.coalesce(F.col("attempt"), F.lit(0)) + F.when(F.col("step") == "retry", 1).otherwise(0)
    return state.apply(batch, known.select("key", status.alias("status"), attempt.cast("int").alias("attempt"), F.lit(day).alias("day")), MERGE)


@query(oracle("call", """WITH q AS (SELECT product_id AS key, max(day) AS submitted, max(attempt) AS attempt FROM call WHERE product_id % 5 <> 0 GROUP BY product_id),
a AS (SELECT product_id AS key, CASE WHEN max(id) % 2 = 0 THEN 'enriched' ELSE 'verifier_failed' END AS came FROM call WHERE product_id % 7 <> 0 GROUP BY product_id),
one AS (SELECT COALESCE(q.key, a.key) AS key, CASE WHEN q.key IS NULL THEN CASE WHEN came = 'enriched' THEN 'enriched' ELSE 'failed' END WHEN a.key IS NULL THEN CASE WHEN 20 - submitted > 2 THEN 'pending' ELSE 'submitted' END WHEN came = 'enriched' THEN 'enriched' WHEN attempt < 2 THEN 'pending' ELSE 'failed' END AS status,
  CASE WHEN q.key IS NOT NULL AND a.key IS NOT NULL AND came <> 'enriched' AND attempt < 2 THEN attempt + 1 ELSE COALESCE(attempt, 0) END AS attempt, CASE WHEN q.key IS NOT NULL AND a.key IS NULL AND 20 - submitted <= 2 THEN submitted ELSE 20 END AS day FROM q FULL JOIN a ON a.key = q.key),
due AS (SELECT key, sum(1 + key % 7) OVER (ORDER BY attempt, key) AS total FROM one WHERE status = 'pending'),
two AS (SELECT one.key, CASE WHEN total <= 120 THEN 'submitted' ELSE status END AS status, attempt, CASE WHEN total <= 120 THEN 21 ELSE day END AS day FROM one LEFT JOIN due USING (key)),
b AS (SELECT key, CASE WHEN key % 2 = 0 THEN 'enriched' ELSE 'verifier_failed' END AS came FROM two WHERE status = 'submitted' AND key % 3 <> 0)
SELECT two.key, CASE WHEN status <> 'submitted' THEN status WHEN came IS NULL THEN CASE WHEN 22 - day > 2 THEN 'pending' ELSE status END WHEN came = 'enriched' THEN 'enriched' WHEN attempt < 2 THEN 'pending' ELSE 'failed' END AS status,
  CAST(CASE WHEN came = 'verifier_failed' AND attempt < 2 THEN attempt + 1 ELSE attempt END AS INTEGER) AS attempt, CAST(CASE WHEN came IS NOT NULL OR status = 'submitted' AND 22 - day > 2 THEN 22 ELSE day END AS INTEGER) AS day FROM two LEFT JOIN b USING (key)"""))
def batch_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of batches over the ledger's keys; every step is given twice and takes effect once."""
    c = relation(spark, sf_dir, "call")
    state = request_state(spark, shared_folder(spark, "requests"), blocks=16)
    asked = c.filter("product_id % 5 <> 0").groupBy(F.col("product_id").alias("key")).agg(F.lit("submitted").alias("status"), F.max("attempt").cast("int").alias("attempt"), F.max("day").cast("int").alias("day"))
    came = c.filter("product_id % 7 <> 0").groupBy(F.col("product_id").alias("key")).agg(F.when(F.max("id") % 2 == 0, "enriched").otherwise("verifier_failed").alias("status"))
    cost = 1 + F.col("key") % 7
    for _ in range(2):
        state.apply("enqueue", asked, MERGE)
        collect(state, "collect 20", 20, came)
        submit(state, "submit 21", 21, cost, 120)
        later = state.read().filter("status = 'submitted' AND key % 3 <> 0").select("key", F.when(F.col("key") % 2 == 0, "enriched").otherwise("verifier_failed").alias("status"))
        collect(state, "collect 22", 22, later)
    state.clean()
    return state.read()
