"""Calls to a paid model, spread by host and stopped by a budget: rounds over what the ledger does not have yet.

The ledger is a versioned table, so a round that died is not counted and its rows are asked again; a round that is in
it is never repeated. Spend is read from the ledger before each round, so it ends within one round of the budget.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import web
from orrery.registry import query
from orrery.relations import oracle, relation
from orrery.session import shared_folder
from orrery.sources.snapshots import Snapshots, latest

#: Hosts that serve for many sites; their rows are dealt over several tasks.
CDN = ("cdn.", "img.", "static.", "images.", "media.", "assets.")
LEDGER = "id long, host string, status string, attempts int, answer string, reason string, cost long"


class Refused(Exception):
    """A client's word that a row will never do; it is put into quarantine and not asked again."""


def shard(url: Column, salts: int = 8) -> Column:
    """A host's name, with one of `salts` numbers for hosts that serve others."""
    host = F.coalesce(web.domain(url), F.lit(""))
    shared = F.lit(False)
    for prefix in CDN:
        shared |= F.startswith(host, F.lit(prefix))
    return F.when(shared, F.concat(host, F.lit("#"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("string"))).otherwise(host)


def calls(todo: DataFrame, client: Callable[[str, str | None], tuple[str, int]], check: Callable[[str], str | None], retries: int = 2, workers: int = 8) -> DataFrame:
    """LEDGER rows of (id, prompt, url): a host's rows are in one task, a salted one's in several; `workers` calls run at a time.

    client(prompt, feedback) gives an answer and its cost; check(answer) gives a reason to ask again, or None.
    """

    def one(row: tuple) -> tuple:
        i, prompt, host = row
        answer, reason, last, status, cost, n = None, None, None, "api_error", 0, 0
        for n in range(1, retries + 2):
            try:
                answer, price = client(prompt, reason)
                cost += price
                reason = check(answer)
                status = "verifier_failed" if reason else "enriched"
            except Refused as error:
                answer, reason, status = None, str(error)[:200], "quarantined"
            except Exception as error:  # noqa: BLE001 - whatever an injected client raises is the call's outcome
                answer, reason, status = None, None, "api_error"
                last = str(error)[:200]
            if status in ("enriched", "quarantined"):
                break
        return i, host, status, n, answer if status == "enriched" else None, last if status == "api_error" else reason, cost

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64())
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                rows = list(pool.map(one, zip(*(b.column(c).to_pylist() for c in ("id", "prompt", "host")), strict=True)))
                yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in LEDGER.split(", ")])

    parts = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return todo.select("id", "prompt", shard(F.col("url")).alias("host")).repartition(parts, "host").mapInArrow(run, LEDGER)


def drain_within(todo: DataFrame, ledger: Snapshots, client: Callable, check: Callable, budget: int, size: int = 10_000, again: tuple[str, ...] = (), rounds: int = 1000, **options: int) -> int:
    """Rounds of `size` rows of todo (id, prompt, url) by id, until the ledger's spend reaches the budget or nothing is left; rounds done.

    Rows in the ledger are left alone, but for those whose status is in `again`; quarantined rows are never asked again.
    """
    done = 0
    tried = ledger.spark.createDataFrame([], "id long")  # a row is asked again once in a run
    for done in range(rounds):
        have = ledger.read()
        if (have.agg(F.sum("cost")).first()[0] or 0) >= budget:
            return done
        settled = have.filter(~F.col("status").isin(*[s for s in again if s != "quarantined"])) if again else have
        chunk = todo.join(settled, "id", "left_anti").join(tried, "id", "left_anti").orderBy("id").limit(size)
        if chunk.isEmpty():
            return done
        if again:
            ids = chunk.select("id").collect()  # at most `size`
            tried = tried.unionByName(ledger.spark.createDataFrame(ids, "id long"))
            chunk = todo.join(F.broadcast(ledger.spark.createDataFrame(ids, "id long")), "id", "left_semi")
        # costs of earlier rounds stay with the row
        spent = have.select("id", F.col("cost").alias("before"))
        rows = calls(chunk, client, check, **options).join(spent, "id", "left").withColumn("cost", F.col("cost") + F.coalesce("before", F.lit(0))).drop("before")
        path = shared_folder(ledger.spark, "round")  # written before it is counted, so that no row is paid for twice
        rows.write.parquet(path)
        ledger.apply(f"round {ledger.version() + 1}", ledger.spark.read.schema(rows.schema).parquet(path), latest(["id"]))
    return done + 1


def numbered(prompt: str, feedback: str | None) -> tuple[str, int]:
    """A client for queries: right after as many reminders as the prompt says, two per call; refuses r, breaks down at x."""
    if prompt == "r":
        raise Refused("never")
    if prompt == "x":
        raise RuntimeError("down")
    return str(int(feedback) - 1 if feedback else int(prompt)), 2


@query(oracle("product", """WITH n AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 400 AS r, CASE id % 7 WHEN 6 THEN 'quarantined' WHEN 5 THEN 'api_error' WHEN 4 THEN 'verifier_failed' WHEN 3 THEN 'verifier_failed' ELSE 'enriched' END AS status,
  CASE id % 7 WHEN 6 THEN 1 WHEN 5 THEN 3 WHEN 4 THEN 3 WHEN 3 THEN 3 ELSE id % 7 + 1 END AS attempts, CASE WHEN id % 7 >= 5 THEN 0 WHEN id % 7 >= 3 THEN 6 ELSE 2 * (id % 7 + 1) END AS cost FROM product),
s AS (SELECT r, sum(sum(cost)) OVER (ORDER BY r) - sum(cost) AS before FROM n GROUP BY r)
SELECT id, status, CAST(attempts AS INTEGER) AS attempts, CAST(cost AS BIGINT) AS cost FROM n JOIN s USING (r) WHERE before < 4000"""))
def drain_under_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of four hundred products until four thousand are spent, from a client of known behaviour."""
    ledger = Snapshots(spark, shared_folder(spark, "ledger"), LEDGER, ["id"], 8)
    kind = F.col("id") % 7
    prompt = F.when(kind == 6, "r").when(kind == 5, "x").when(kind >= 3, "9").otherwise(kind.cast("string"))
    todo = relation(spark, sf_dir, "product").select("id", prompt.alias("prompt"), F.coalesce("image_url", "source_url").alias("url"))
    drain_within(todo, ledger, numbered, lambda a: a if int(a) > 0 else None, budget=4000, size=400)
    ledger.clean()
    return ledger.read().select("id", "status", "attempts", "cost")
