"""How far each source of a language is from its other sources, and which terms set it apart.

Texts are counted in tasks, and their counts are dealt by a hash of language and term, so that a shard holds all
counts of its terms. In each shard DuckDB, with bounded memory and a folder to spill to, sums the counts and keeps
the language's terms; a second round gets the totals of all groups and sums, per shard, what each pair of sources
differs by, with each group's leading terms. Spark merges the shards' sums and ranks them.

A term's share in a group is p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)), with N the group's count of all V kept
terms; two shares differ by floor((p - q)^2 / (p + q)). Everything is integer arithmetic.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import _text as T
from orrery.llm._spark import Scratch, partitions

SLICE = 8 << 20  # bytes of text counted at a time
ROWS = 1 << 16  # of a batch that leaves a task
COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, term string, sources array<string>, counts array<long>"
PARTS = "lang string, source string, part string, item string, value long"
SHARES_EACH = 8  # shards per partition: even dealing


def term_bounds(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of ASCII letters and bytes above ASCII, and offsets by row; low is in lower case."""
    return T.runs(((low >= 97) & (low <= 122)) | (low >= 128), off)


def term_counts(part: pa.RecordBatch) -> pa.RecordBatch:
    """COUNTS of a batch of lang, source, text: per group and term its occurrences, and the documents that have it."""
    buf, off = T.flat(part.column("text"))
    low = T.lower_ascii(buf)
    starts, ends, first = term_bounds(low, off)
    size = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    data = low[((low >= 97) & (low <= 122)) | (low >= 128)]
    coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(size), pa.py_buffer(data)]).dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = [part.column(k).dictionary_encode() for k in ("lang", "source")]
    lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in names)
    group, wide = lang * max(1, len(names[1].dictionary)) + source, max(1, len(terms))
    row = np.repeat(np.arange(part.num_rows), np.diff(first))
    each, times = np.unique(row * wide + code, return_counts=True)
    key = group[each // wide] * wide + each % wide
    order = np.argsort(key, kind="stable")
    found, at, docs = np.unique(key[order], return_index=True, return_counts=True)
    n = np.add.reduceat(times[order], at) if len(found) else times
    g = found // wide
    take = lambda values, index: values.take(pa.array(index))
    return pa.record_batch({
        "lang": take(names[0].dictionary, g // max(1, len(names[1].dictionary))), "source": take(names[1].dictionary, g % max(1, len(names[1].dictionary))),
        "term": take(terms, found % wide).cast(pa.string()), "n": pa.array(n.astype(np.int64)), "docs": pa.array(docs.astype(np.int64)),
    })


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in T.slices(batches, limit=SLICE):
        out = term_counts(part)
        for at in range(0, out.num_rows, ROWS):
            yield out.slice(at, ROWS)


def in_shard(batches: Iterator[pa.RecordBatch], load: str, *selects: str, memory: str = "300MB") -> Iterator[pa.RecordBatch]:
    """Rows of DuckDB selects over a table made by load from the batches of one task, which spills beyond `memory`."""
    import duckdb

    first = next(batches, None)
    if first is None:
        return

    def rest() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    with tempfile.TemporaryDirectory(prefix="shard-") as folder, duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": folder, "preserve_insertion_order": False}) as con:
        con.register("arrived", pa.RecordBatchReader.from_batches(first.schema, rest()))
        for statement in load.split(";"):
            con.execute(statement)
        for select in selects:
            yield from con.sql(select).to_arrow_reader(ROWS)


def kept_terms(docs: DataFrame, least_docs: int, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """KEPT: per language and term in at least least_docs of its documents, the count in each source that has it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    load = "CREATE TABLE c AS SELECT lang, term, source, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM arrived GROUP BY ALL"
    select = f"SELECT lang, term, list(source) AS sources, list(n) AS counts FROM c GROUP BY lang, term HAVING sum(docs) >= {int(least_docs)}"
    return rows.mapInArrow(_count, COUNTS).repartition(partitions(docs.sparkSession), "lang", "term").mapInArrow(lambda b: in_shard(b, load, select), KEPT)


SHARE = "CAST(1 + 1000000000::HUGEINT * ({} + 2) // greatest(1, {} + 2 * v) AS BIGINT)"  # a language without kept terms has no shares
DIFFER = "(({0} - {1}) * ({0} - {1}) // ({0} + {1}))"
LOAD = f"""
CREATE TABLE a AS SELECT * FROM arrived;
CREATE TABLE g AS SELECT lang, sources[1] AS source, any_value(total) AS total, any_value(whole) AS whole, any_value(kept) AS v, min(shard) AS shard, {SHARE.format(0, "any_value(total)").replace("* v)", "* any_value(kept))")} AS p0 FROM a WHERE term IS NULL GROUP BY ALL;
CREATE TABLE t AS SELECT lang, term, unnest(sources) AS source, unnest(counts) AS n FROM a WHERE term IS NOT NULL;
CREATE TABLE s AS SELECT lang, term, g.source, COALESCE(t.n, 0) AS n, CASE WHEN t.n IS NULL THEN p0 ELSE {SHARE.format("t.n", "total")} END AS p FROM (SELECT lang, term FROM a WHERE term IS NOT NULL) JOIN g USING (lang) LEFT JOIN t USING (lang, term, source)
"""
#: Shares of one term side by side; each pair of sources is computed once and reported from both ends.
PAIRS = f"""
WITH d AS (SELECT x.lang, x.source AS one, y.source AS two, CAST(sum({DIFFER.format("x.p", "y.p")}) AS BIGINT) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source < y.source GROUP BY ALL)
SELECT lang, one AS source, 'pair' AS part, two AS item, value FROM d UNION ALL SELECT lang, two, 'pair', one, value FROM d
UNION ALL SELECT x.lang, x.source, 'pair', y.source, 0::BIGINT FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source WHERE x.shard = 0
"""
TERMS = f"""
WITH w AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY ALL),
q AS (SELECT lang, term, {SHARE.format("n", "whole")} AS q FROM w JOIN (SELECT lang, any_value(whole) AS whole, any_value(v) AS v FROM g GROUP BY lang) USING (lang))
SELECT lang, source, 'term' AS part, term AS item, {DIFFER.format("p", "q")} AS value FROM s JOIN q USING (lang, term) WHERE n > 0 AND p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= $TOP
"""


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: each other source of the language with the sum of differences over all kept terms. Part `term`: the
    `top` terms whose share in the group exceeds that in the language by most. Ranks count from 1 per group and part,
    by value descending, then item ascending in UTF-8. Null text, lang and source count as ''. A group without terms
    has pairs, with counts of 0; a language without kept terms gives pairs of value 0; a language of one source has
    no pairs. Repeated rows count as documents of their own; an empty table gives no rows. Further columns are not read.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "audit")
    terms = tmp.table(kept_terms(docs, least_docs, lang_col, source_col, text_col))
    name: dict[str, Column] = {k: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col))}
    totals = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    number = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = tmp.table(docs.select(name["lang"], name["source"]).distinct().join(totals, ["lang", "source"], "left").join(number, "lang", "left").fillna(0, ["total", "kept"]))
    groups = groups.join(groups.groupBy("lang").agg(F.sum("total").alias("whole")), "lang")
    n = partitions(spark) * SHARES_EACH
    # every shard gets the totals of all groups as rows, so nothing is broadcast
    heads = groups.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), "lang", F.lit(None).cast("string").alias("term"), F.array("source").alias("sources"), F.lit(None).cast("array<long>").alias("counts"), "total", "kept", "whole")
    none = F.lit(None).cast("long")
    body = terms.select(F.pmod(F.xxhash64("lang", "term"), F.lit(n)).cast("int").alias("shard"), "lang", "term", "sources", "counts", none.alias("total"), none.alias("kept"), none.alias("whole"))
    sums = body.unionByName(heads).repartition(partitions(spark), "shard").mapInArrow(lambda b: in_shard(b, LOAD, PAIRS, TERMS.replace("$TOP", str(int(top)))), PARTS)
    found = tmp.table(sums)
    tmp.keep(found)
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # a term is in one shard, so its value is whole; the rank's limit applies before terms travel
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda d: d.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(found.filter("part = 'term'")).filter(F.col("rank") <= top))
