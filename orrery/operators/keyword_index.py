"""An inverted index for keyword search, kept up to date by blocks of documents, with exact BM25 out of few files.

Documents are dealt into blocks by a hash of the id, so that a block's postings are bounded and an upsert rebuilds only
the blocks it touches. Postings are sorted by term inside a block, so a prefix is a range of row groups. A search first
reads the ids of its terms, for their document counts, and the bounds of each block, then whole postings of the blocks
that could hold one of the best k: a block whose bound is below the k-th score found so far is not opened.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import search
from orrery.registry import query
from orrery.session import shared_folder
from orrery.sources.snapshots import Snapshots, latest, replaced

POSTINGS = "block int, term string, n long, words long, most int, shortest int, ids array<long>, tf array<int>, len array<int>"


def postings(docs: DataFrame) -> DataFrame:
    """POSTINGS of (block, id, body): a row per block and term, and one for the empty term with the block's documents and words.

    docs are dealt by block, so that a block's documents pass one task together and its postings are put together there.
    """
    body = F.lower(F.coalesce("body", F.lit("")))
    return docs.select("block", "id", body.alias("body")).sortWithinPartitions("block", "id").mapInArrow(_by_block, POSTINGS)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if held and held[0].column("block")[0].as_py() != int(block[a]):
                yield from _inverted(pa.Table.from_batches(held).combine_chunks())
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from _inverted(pa.Table.from_batches(held).combine_chunks())


def _inverted(docs: pa.Table, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """POSTINGS of one block's documents (block, id, body), which are in order of id."""
    body = docs.column("body").combine_chunks().cast(pa.large_string())
    off = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    buf = np.frombuffer(body.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off, n = off - off[0], docs.num_rows
    inside = ((buf >= 97) & (buf <= 122)) | ((buf >= 48) & (buf <= 57))
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    begins = inside & (edge[:-1] | np.r_[True, ~inside[:-1]][: len(buf)])
    starts = np.flatnonzero(begins)
    length = np.diff(np.r_[np.cumsum(inside)[starts] - 1, inside.sum()]) if len(starts) else np.zeros(0, np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(length)].astype(np.int64)), pa.py_buffer(buf[inside])]).dictionary_encode()
    row = np.searchsorted(off, starts, side="right") - 1
    size = np.bincount(row, minlength=n)
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    each, tf = np.unique(code * n + row, return_counts=True)  # by term, then document
    term, doc = each // max(n, 1), each % max(n, 1)
    cut = np.searchsorted(term, np.arange(len(words.dictionary) + 1))
    ids, block = docs.column("id").combine_chunks().take(pa.array(doc)), docs.column("block")[0].as_py()
    sums = lambda x: np.add.reduceat(x, cut[:-1]) if len(cut) > 1 else np.zeros(0, np.int64)
    most = np.maximum.reduceat(tf, cut[:-1]) if len(cut) > 1 else sums(tf)
    shortest = np.minimum.reduceat(size[doc], cut[:-1]) if len(cut) > 1 else sums(tf)
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = [c.split(" ")[0] for c in POSTINGS.split(", ")]
    yield pa.record_batch([pa.array([v], k) for v, k in zip((block, "", n, int(size.sum()), 0, 0, [], [], []), kinds, strict=True)], names)
    many, total = np.diff(cut), sums(tf)
    for a in range(0, len(many), rows):
        b = min(a + rows, len(many))
        lists = lambda values, a=a, b=b: pa.ListArray.from_arrays(pa.array(cut[a : b + 1] - cut[a], pa.int32()), values[cut[a] : cut[b]])
        columns = [pa.array(np.full(b - a, block), pa.int32()), words.dictionary[a:b].cast(pa.string()), pa.array(many[a:b]), pa.array(total[a:b]), pa.array(most[a:b], pa.int32()), pa.array(shortest[a:b], pa.int32()), lists(ids), lists(pa.array(tf, pa.int32())), lists(pa.array(size[doc], pa.int32()))]
        yield pa.record_batch(columns, names)


class KeywordIndex:
    """An index below a shared folder. Documents (id, body) are kept beside it, since a block is rebuilt whole."""

    def __init__(self, spark: SparkSession, path: str, blocks: int = 64):
        self.spark = spark
        self.opened: list[int] = []  # blocks whose postings the last search read
        self.docs = Snapshots(spark, f"{path}/docs", "id long, body string", ["id"], blocks)
        self.lists = Snapshots(spark, f"{path}/postings", POSTINGS, ["block", "term"], blocks, by=F.col("block"))

    def upsert(self, batch: str, docs: DataFrame) -> bool:
        """Puts documents (id, body) in place of those of the same ids; False if the batch was applied to all before.

        Documents and postings take the batch one after the other, each once, so a run that died in between goes on.
        """
        changes = docs.select(F.col("id").cast("long").alias("id"), "body")
        first = self.docs.apply(batch, changes, latest(["id"]))
        if self.lists.applied(batch):
            return first
        touched = [r[0] for r in changes.select(self.docs.block.alias("b")).distinct().collect()]  # at most `blocks`
        rows = self.docs.read(blocks=touched).withColumn("block", self.docs.block)
        fresh = postings(rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "block"))
        return self.lists.apply(batch, fresh, replaced, order=["term"]) or first

    def matching(self, terms: list[str], blocks: list[int] | None = None) -> DataFrame:
        """Postings of the terms' ranges, with i, the number of the term; of some blocks only, if given."""
        rows = self.lists.read(blocks=blocks)
        inside = lambda t: (F.col("term") >= t) & (F.col("term") < t[:-1] + chr(ord(t[-1]) + 1))
        any_of = F.lit(False)
        for t in terms:
            any_of |= inside(t)
        return rows.filter(any_of).withColumn("i", F.explode(F.array_compact(F.array(*[F.when(inside(t), F.lit(i)) for i, t in enumerate(terms)]))))

    def search(self, text: str, k: int = 20) -> DataFrame:
        """id, score of the k best documents by BM25, words of the text matched as prefixes, ties to the smaller id: exactly what a scan gives."""
        terms = search.prefix_terms(text)
        whole = self.lists.read().filter("term = ''").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        empty = self.spark.createDataFrame([], "id long, score double")
        if not terms or not whole.n:
            return empty
        # a block's row for each term: how many documents have it, and what no document of the block can exceed
        met = self.matching(terms).groupBy("block", "i").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("df"), F.sum("most").alias("most"), F.min("shortest").alias("shortest"))
        bounds = met.collect()  # blocks x terms
        df = [sum(r.df for r in bounds if r.i == i) for i in range(len(terms))]
        mean = whole.words / whole.n
        scored = lambda rows: self._score(rows, terms, df, whole.n, mean)
        limit: dict[int, float] = {}
        for r in bounds:
            limit[r.block] = limit.get(r.block, 0.0) + idf(whole.n, df[r.i]) * gain(r.most, r.shortest, mean)
        order = sorted(limit, key=lambda b: -limit[b])
        first, have = [], 0
        while len(first) < len(order) and have < k:  # the most promising blocks that hold k documents at least
            first.append(order[len(first)])
            have += max(r.df for r in bounds if r.block == first[-1])
        if not first:
            return empty
        best = [r.score for r in scored(self.matching(terms, first)).orderBy(F.desc("score"), "id").limit(k).collect()]  # at most k
        least = best[-1] - 1e-6 if len(best) == k else float("-inf")
        self.opened = [b for b in order if limit[b] >= least]
        return scored(self.matching(terms, self.opened)).orderBy(F.desc("score"), "id").limit(k)

    def _score(self, rows: DataFrame, terms: list[str], df: list[int], n: int, mean: float) -> DataFrame:
        each = rows.select("i", F.explode(F.arrays_zip("ids", "tf", "len")).alias("p")).select("i", F.col("p.ids").alias("id"), F.col("p.tf").alias("tf"), F.col("p.len").alias("len"))
        wide = each.groupBy("id").agg(F.max("len").alias("len"), *[F.coalesce(F.sum(F.when(F.col("i") == i, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i in range(len(terms))])
        score: Column = F.lit(0.0)
        for i in range(len(terms)):
            score += F.lit(idf(n, df[i])) * gain(F.col(f"tf{i}"), F.col("len"), mean)
        return wide.select("id", F.round(score, 6).alias("score"))


def idf(n: int, df: int) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)


def gain(tf, length, mean: float):
    """What tf occurrences in a document of so many words count; grows with tf, falls with the length."""
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / mean))


@query(f"WITH {search.BM25_SQL} SELECT id, score FROM kw")
def keyword_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents, asked what bm25_search asks."""
    docs = search._documents(spark, sf_dir)
    index = KeywordIndex(spark, shared_folder(spark, "keywords"), blocks=int(spark.conf.get("spark.sql.shuffle.partitions")))
    index.upsert("all", docs)
    found = index.search("Wor, gen!").collect()  # k rows
    index.docs.drop()
    index.lists.drop()
    return spark.createDataFrame(found, "id long, score double").coalesce(1)
