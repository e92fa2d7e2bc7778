"""Nearest vectors of the same kind for many queries: tiles of matrix products inside tasks, no joined pairs.

Vectors are dealt into blocks and queries into chunks of bounded size; a tile is a block and a chunk. A task holds a
chunk's queries, streams the block's vectors past them in batches, and keeps the best k of each query, so that k rows
per query and block leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 8 << 20  # bytes of a chunk's query vectors
CELLS = 1 << 21  # scores held at a time
TILES_EACH = 4  # blocks per partition: even dealing
PLACES = 10_000  # scores count in ten-thousandths, halves up; ties go to the smaller id
SCORES = "id long, near_id long, score4 long"


class Best:
    """The best k of each query of one kind and dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.query, self.score, self.near = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(len(ids), -(1 << 62))  # a score below its query's can be left out

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        rows = max(1, CELLS // len(self.ids))
        for at in range(0, len(ids), rows):
            own = ids[at : at + rows]
            score = np.floor(vectors[at : at + rows] @ self.vectors.T * PLACES + 0.5).astype(np.int64)
            r, q = np.nonzero((score >= self.least) & (own[:, None] != self.ids))
            self.query, self.score, self.near = (np.concatenate(x) for x in ((self.query, q), (self.score, score[r, q]), (self.near, own[r])))
            order = np.lexsort((self.near, -self.score, self.query))
            first = np.searchsorted(self.query[order], np.arange(len(self.ids) + 1))
            rank = np.arange(len(order)) - first[self.query[order]]
            kept = order[rank < self.k]
            full = np.flatnonzero(np.diff(first) >= self.k)
            self.least[full] = self.score[order[first[full] + self.k - 1]]
            self.query, self.score, self.near = self.query[kept], self.score[kept], self.near[kept]

    def rows(self) -> pa.RecordBatch:
        return pa.record_batch({"id": pa.array(self.ids[self.query]), "near_id": pa.array(self.near), "score4": pa.array(self.score)})


def _by_kind(part: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(label, dimension), ids and unit vectors of a batch."""
    lists = part.column("v")
    size, ids, label = lists.value_lengths().to_numpy(), part.column("id").to_numpy(), part.column("label").to_numpy()
    flat, start = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])
    for kind in np.unique(np.stack([label, size], axis=1), axis=0).tolist():
        rows = np.flatnonzero((label == kind[0]) & (size == kind[1]))
        v = flat[start[rows][:, None] + np.arange(kind[1])]
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        yield tuple(kind), ids[rows], np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, asked, best = None, {}, {}
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("block", "chunk", "side")], axis=1)
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                block, chunk, side = key[a].tolist()
                if (block, chunk) != tile:
                    yield from (x.rows() for x in best.values())
                    tile, asked, best = (block, chunk), {}, {}
                for kind, ids, v in _by_kind(batch.slice(a, b - a)):
                    if side == 0:
                        asked.setdefault(kind, []).append((ids, v))
                        continue
                    if kind in asked:  # all queries of a tile come before its vectors
                        best[kind] = Best(*(np.concatenate(x) for x in zip(*asked.pop(kind), strict=True)), k)
                    if kind in best:
                        best[kind].meet(ids, v)
        yield from (x.rows() for x in best.values())

    return run


def nearest_of_kind(vectors: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """id, near_id, score of the k other rows of the same label nearest by cosine to every query.

    Both tables have vec_id, label, embedding. Scores have four places; equal scores go to the smaller id. Rows with a
    null id, label, vector or component, or a component that is no number, take no part; a zero vector scores 0.
    Vectors are compared with those of their own dimension. Fewer than k rows are all returned.
    """
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    tidy = lambda d: d.filter(sound).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v")).dropna()
    asked = tidy(queries)
    n = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    chunks = max(1, -(-n.n * 8 * (n.dim or 1) // CHUNK))
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions")) * TILES_EACH
    dealt = lambda d, side, block, chunk: d.select(F.lit(side).alias("side"), block.alias("block"), "*").select("side", "block", chunk.alias("chunk"), "id", "label", "v")
    spread = lambda to: F.explode(F.sequence(F.lit(0), F.lit(to - 1)))
    hashed = lambda to: F.pmod(F.xxhash64("id", F.lit("tile")), F.lit(to)).cast("int")
    rows = dealt(asked, 0, spread(blocks), hashed(chunks)).unionByName(dealt(tidy(vectors), 1, hashed(blocks), spread(chunks)))
    scored = rows.repartition(blocks // TILES_EACH, "block", "chunk").sortWithinPartitions("block", "chunk", "side").mapInArrow(_tiles(k), SCORES)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score4"), "near_id"))
    return scored.withColumn("k", rank).filter(F.col("k") <= k).select("id", "near_id", F.round(F.col("score4") / PLACES, 4).alias("score"))
