"""Best-fit-decreasing packing of token pieces into sequences.

Documents are tokenised, documents longer than a sequence are cut into pieces, and the pieces are dealt by hash
into groups of about `bins` sequences. Each group is packed on its own: pieces by descending length, each into the
open sequence with the least room that still holds it, found by a segment tree over remaining capacities in
logarithmic time. A group wastes at most about one sequence, so the loss stays near 1 / bins at any size, and no
task sees more than one group's lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import _text as T
from orrery.llm._spark import Scratch, id_text
from orrery.llm._tokens import encoder, with_end

SLICE = 1 << 20  # bytes of text tokenised at a time


class Rooms:
    """Segment tree over capacities 0..most: counts of open sequences by remaining room."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, need: int) -> int:
        """The smallest room of an open sequence that is at least need, or -1."""
        tree, i = self.tree, need + self.leaves
        if tree[i]:
            return need
        while i > 1:  # up, until some place to the right has an open sequence
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.leaves:  # down, leftmost
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place in it for each length, all between 1 and most."""
    rooms, by_room = Rooms(most), [[] for _ in range(most + 1)]
    sequence, place, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room = rooms.tightest(need)
        if room < 0:
            s, room, n = n, most, n + 1
        else:
            s = by_room[room].pop()
            rooms.add(room, -1)
        sequence[k], place[k] = s, most - room
        if room > need:
            by_room[room - need].append(s)
            rooms.add(room - need, 1)
    return sequence, place


def pieces(docs: DataFrame, tokenizer: str, end: int = 1, most: int = 4096, kind: str = "words") -> DataFrame:
    """doc_id, piece (from 0), start, length, ids_crc32 of each piece of the ids of each text and its end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, limit=SLICE):
            ids, off = with_end(*encoder(tokenizer, kind).encode(*T.flat(part.column("text"))), end)
            count = -(-np.diff(off) // most)
            row = np.repeat(np.arange(len(count)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * most
            length = np.minimum(np.diff(off)[row] - start, most)
            at, data = 4 * (off[row] + start), ids.astype("<u4", copy=False).tobytes()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            yield pa.record_batch({"doc_id": part.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())})

    return id_text(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end: int = 1, most: int = 4096, bins: int = 2048, kind: str = "words") -> DataFrame:
    """The pieces with sequence_id and offset.

    Null text is empty: a piece with the end id alone. Repeated rows are packed as documents of their own. No
    documents give no rows. Sequence ids are unique over all groups; offsets in a sequence are gapless from 0.
    """
    found = Scratch(docs.sparkSession, "pack").table(pieces(docs, tokenizer, end, most, kind))
    total = found.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (most * bins)))

    def one(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sequence, place = best_fit(rows["length"].to_numpy(), most)
        return rows.drop(columns="g").assign(sequence_id=(group[0] << 32) + sequence, offset=place)

    # by its place in the written table, so that rows that are equal in every column are dealt like others
    at = F.xxhash64(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), "_metadata.row_index")
    dealt = found.withColumn("g", F.pmod(at, F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(one, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
