"""Exact top-k inner products by norm-sorted search with SVD-rotated partial sums.

Integer vectors are rotated by the singular vectors of the whole corpus (from its d x d second moments, summed by
Spark), so that the first coordinates hold most of the length. Vectors are range-partitioned by descending norm.
A query's k-th best score so far is its threshold; a block of vectors is skipped for a query if norm * norm cannot
reach it, and a single vector if the partial sum over the leading coordinates plus the product of the residual
norms (Cauchy-Schwarz) cannot. Bounds are floating point with a margin; scores are exact integers.

Queries are broadcast in chunks of at most `chunk` vectors and CHUNK_BYTES, so what is broadcast has a fixed bound at any
size; they are compared in tiles of TILE queries with ROWS vectors. A first pass over the `head` longest vectors, again a
fixed number, gives thresholds for all partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm._spark import Scratch, partitions

ROWS = 4096  # of vectors compared at a time
TILE = 512  # of queries compared at a time
CHUNK_BYTES = 16 << 20


def integer_vectors(table: DataFrame, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as long. Null vectors, and vectors that hold null or non-finite components, are left out."""
    x = F.col(vector_col).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return (
        table.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
        .filter(~F.exists("x", bad))
        .select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("v"))
    )


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of lists as an int64 matrix; shorter lists are filled with zeros, which add nothing to a product."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), dim), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products row by row; by Python integers, kept within 64 bits, where 64-bit sums could overflow."""
    if q.size and float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", q, v)
    full = (q.astype(object) * v.astype(object)).sum(axis=1)
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in full], dtype=np.int64)


class Searcher:
    """Keeps the k best (score, then smaller id) of each query over the blocks it is shown."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray, k: int, lead: int, floor: np.ndarray):
        self.ids, self.q, self.rotation, self.k, self.lead = ids, queries, rotation, k, lead
        r = queries @ rotation
        self.rotated, self.norm, self.rest = r, np.linalg.norm(r, axis=1), np.linalg.norm(r[:, lead:], axis=1)
        self.floor = floor.astype(float)  # no result below this
        n = len(ids)
        self.best = np.full((n, k), -np.inf)  # scores as float, for thresholds only
        self.score, self.vec, self.have = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)

    def show(self, ids: np.ndarray, v: np.ndarray) -> None:
        r = v @ self.rotation
        rest, norm = np.linalg.norm(r[:, self.lead :], axis=1), np.linalg.norm(r, axis=1)
        least = np.maximum(self.best[:, -1], self.floor)
        live = np.flatnonzero(self.norm * norm.max(initial=0.0) * (1 + 1e-9) + 1 >= least)
        for i in range(0, len(live) if len(ids) else 0, TILE):
            tile = live[i : i + TILE]
            margin = 1 + 1e-9 * self.norm[tile, None] * norm[None, :]
            bound = self.rotated[tile, : self.lead] @ r[:, : self.lead].T + self.rest[tile, None] * rest[None, :] + margin
            possible = (bound >= least[tile, None]) & (self.ids[tile, None] != ids[None, :])
            if possible.sum() > 4 * self.k * len(tile):  # the bound says little: whole sums, less than the k best of which are out
                score = np.where(possible, self.rotated[tile] @ r.T, -np.inf)
                if len(ids) > self.k:
                    kth = np.partition(score, -self.k, axis=1)[:, -self.k]
                    possible &= score + margin >= np.maximum(least[tile], kth - margin.max(axis=1))[:, None]
            row, col = np.nonzero(possible)
            self._keep(tile[row], col, ids, v)

    def _keep(self, row: np.ndarray, col: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Adds pairs of queries and vectors by their exact scores."""
        if not len(row):
            return
        scores = np.concatenate([_exact(self.q[row[i : i + 100_000]], v[col[i : i + 100_000]]) for i in range(0, len(row), 100_000)])
        touched = np.unique(row)
        held = np.repeat(touched, self.have[touched])
        place = np.arange(len(held)) - np.repeat(np.cumsum(self.have[touched]) - self.have[touched], self.have[touched])
        row, vec, scores = np.concatenate([held, row]), np.concatenate([self.vec[held, place], ids[col]]), np.concatenate([self.score[held, place], scores])
        order = np.lexsort((vec, -scores, row))
        row, vec, scores = row[order], vec[order], scores[order]
        first = np.searchsorted(row, touched)
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        top = rank < self.k
        row, vec, scores, rank = row[top], vec[top], scores[top], rank[top]
        self.score[row, rank], self.vec[row, rank], self.best[row, rank] = scores, vec, scores
        self.have[touched] = np.bincount(np.searchsorted(touched, row), minlength=len(touched))

    def batch(self) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(self.ids)), self.have)
        place = np.arange(len(row)) - np.repeat(np.cumsum(self.have) - self.have, self.have)
        return pa.record_batch({"query_id": pa.array(self.ids[row]), "vec_id": pa.array(self.vec[row, place]), "score": pa.array(self.score[row, place])})


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, chunk: int = 100_000, head: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest scores over all other rows, ties to smaller vec_id.
    An empty vector has score 0 with every other. The driver holds dim * dim sums, `head` vectors and one chunk of queries.

    vectors: (vec_id long, v array<long>); is_query: a condition on vec_id. A row is never compared with rows of
    its own id; a repeated id counts once per row as a candidate and once, with its smallest vector, as a query. Vectors of different lengths
    are compared over the shorter one. Queries without candidates, and empty tables, give no rows.
    """
    spark = vectors.sparkSession
    tmp = Scratch(spark, "topk")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    table = tmp.table(vectors.withColumn("norm", norm).repartitionByRange(partitions(spark), F.col("norm").desc(), "vec_id").sortWithinPartitions(F.col("norm").desc(), "vec_id"))
    dim, n = table.agg(F.max(F.size("v")), F.count("*")).first()
    shape = "query_id long, vec_id long, score long"
    if not n or not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column("v"), dim).astype(float)
            total += m.T @ m
        i, j = np.indices((dim, dim))
        yield pa.record_batch({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "x": pa.array(total.ravel())})

    gram = np.zeros((dim, dim))
    for i, j, x in table.select("v").mapInArrow(moments, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x")).collect():
        gram[i, j] = x
    values, rotation = np.linalg.eigh(gram)
    rotation = rotation[:, ::-1].copy()
    lead = max(1, int(np.searchsorted(np.cumsum(values[::-1]) / max(values.sum(), 1e-300), 0.8)) + 1)

    longest = table.orderBy(F.col("norm").desc(), "vec_id").limit(head).select("vec_id", "v").toArrow().combine_chunks()
    longest_ids, longest_v = longest.column("vec_id").to_numpy(), _matrix(longest.column("v").combine_chunks(), dim)
    chunk = max(1, min(chunk, CHUNK_BYTES // (8 * dim)))
    queries = table.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    chunks = -(-queries.count() // chunk)
    parts = []
    for c in range(chunks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).toArrow().combine_chunks()
        ids, q = rows.column("vec_id").to_numpy(), _matrix(rows.column("v").combine_chunks(), dim)
        first = Searcher(ids, q, rotation, k, lead, np.full(len(ids), -np.inf))
        for i in range(0, len(longest_ids), ROWS):
            first.show(longest_ids[i : i + ROWS], longest_v[i : i + ROWS])
        sent = spark.sparkContext.broadcast((ids, q, first.best[:, -1]))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            s = Searcher(sent.value[0], sent.value[1], rotation, k, lead, sent.value[2])
            for b in batches:
                for i in range(0, b.num_rows, ROWS):
                    part = b.slice(i, ROWS)
                    s.show(part.column("vec_id").to_numpy(), _matrix(part.column("v"), dim))
            yield s.batch()

        parts.append(table.select("vec_id", "v").mapInArrow(search, shape))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
