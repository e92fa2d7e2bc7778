"""Quality by ordinal cumulative-link regression on hashed text.

P(grade > t) = sigmoid(w . x - threshold_t): one weight vector for all grades, thresholds in increasing order. x
has a text's distinct words (letters only, lower case, hashed), and steps of the shares of its word shapes. The
expected grade and the tail probability P(grade = highest) rank documents for selection.

The fit uses at most `sample` rated rows, chosen by a hash of the id. Spark counts their features by grade, and only
features that the counts single out go to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import _text as T
from orrery.llm._spark import id_text, written

BITS = 18
STEPS = np.array([0.02, 0.1, 0.3, 0.6])  # of shares of words
SHAPES = ("symbol", "shout", "letterless", "repeated", "unbroken")


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, distinct, by row. Features: hashed words below 2 ** BITS, shape steps above."""
    n = len(off) - 1
    low = T.lower_ascii(buf)
    alpha = ((low >= 97) & (low <= 122)) | (low >= 0x80)
    s, e, wo = T.runs(alpha, off) if len(buf) else T.word_bounds(buf, off)
    row = np.repeat(np.arange(n), np.diff(wo))
    word = (T.word_hashes(low, s, e, 7) >> T.U(64 - BITS)).astype(np.int64)
    width = (1 << BITS) + len(SHAPES) * len(STEPS)
    pairs = [row * width + word]
    ws, we, wo = T.word_bounds(buf, off)
    words, wrow = np.maximum(np.diff(wo), 1), np.repeat(np.arange(n), np.diff(wo))
    if len(ws):
        total = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        up, letters = total((buf >= 65) & (buf <= 90)), total(alpha)
        last, h = buf[we - 1], T.word_hashes(buf, ws, we, 8)
        again = np.zeros(len(ws), bool)
        again[1:] = (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])
        flags = (np.isin(last, list(b"#*$%&|<>")), (up[we] - up[ws] >= 2) & (letters[we] > letters[ws]), letters[we] == letters[ws], again, we - ws > 30)
        for k, f in enumerate(flags):
            share = np.bincount(wrow[f], minlength=n) / words
            r, step = np.nonzero(share[:, None] >= STEPS)
            pairs.append(r * width + (1 << BITS) + k * len(STEPS) + step)
    key = np.unique(np.concatenate(pairs))
    return key // width, key % width


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """P(grade > t) for n rows and every t."""
        z = np.bincount(row, weights=self.weights[feature], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -700, 700)))


def telling(times: np.ndarray, rows: np.ndarray, least: int = 3, z: float = 5.0) -> np.ndarray:
    """Which features are in at least `least` rows with a share above some grade that is `z` standard deviations off
    the share of all rows; this keeps chance words out of a wide model. times: features x grades; rows: by grade."""
    n, number = times.sum(axis=1), max(rows.sum(), 1)
    strong = np.zeros(len(times), bool)
    for t in range(1, len(rows)):
        p = rows[t:].sum() / number
        strong |= np.abs(times[:, t:].sum(axis=1) - n * p) >= z * np.sqrt(n * p * (1 - p) + 1e-9)
    return strong & (n >= least)


def fit_pairs(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, l2: float = 0.5, rounds: int = 300) -> Model:
    """Full-batch fit by Adam of the cumulative-link likelihood.

    Thresholds are a first value and positive gaps, so that they stay ordered; rare grades weigh up to a tenth of all.
    """
    width, n, top = (1 << BITS) + len(SHAPES) * len(STEPS), len(grade), max(int(grade.max(initial=1)), 1)
    used, inverse = np.unique(feature, return_inverse=True)
    w, free = np.zeros(len(used)), np.concatenate([[-1.0], np.zeros(top - 1)])
    share = np.bincount(grade, minlength=top + 1) / max(n, 1)
    weigh = np.maximum(0.1 / np.maximum(share, 1e-9), 1.0)[grade]
    state = [np.zeros(len(used) + top), np.zeros(len(used) + top)]
    for t in range(1, rounds + 1):
        th = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        z = np.bincount(row, weights=w[inverse], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - th, -700, 700)))
        # likelihood of a grade: difference of neighbouring tails
        tail = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        slope = tail * (1 - tail)
        k = np.arange(n)
        own = np.maximum(tail[k, grade] - tail[k, grade + 1], 1e-12)
        dz = weigh * (slope[k, grade] - slope[k, grade + 1]) / own / n
        dth = np.array([(weigh * np.where(grade == j + 1, -slope[:, j + 1], np.where(grade == j, slope[:, j + 1], 0)) / own).sum() / n for j in range(top)])
        gaps = np.exp(free[1:])
        dfree = np.concatenate([[dth.sum()], [dth[j + 1 :].sum() * gaps[j] for j in range(top - 1)]])
        g = np.concatenate([np.bincount(inverse, weights=dz[row], minlength=len(used)) - l2 * w / n, dfree])
        state = [0.9 * state[0] + 0.1 * g, 0.999 * state[1] + 0.001 * g * g]
        step = 0.05 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w, free = w + step[: len(used)], free + step[len(used) :]
    weights = np.zeros(width)
    weights[used] = w
    return Model(weights, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))]))


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, sample: int = 20_000) -> Model:
    """Fits on at most `sample` different pairs of a document and a grade from ratings (doc_id and what grade needs).

    Null grades are left out. Ids may repeat in both tables: equal ratings of an id count once, equal texts under one
    id count once, and the bound holds for what the join gives.
    """
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).dropna().distinct()
    chosen = rated.orderBy(F.xxhash64(F.lit("ordinal"), "doc_id"), "doc_id", "grade").limit(sample)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            row, feature = features(*T.flat(part.column("text")))
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature, pa.int32()))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "grade": part.column("grade"), "features": lists})

    named = id_text(docs).withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` ratings
    pairs_of = named.select("doc_id", "h", "grade").distinct().orderBy(F.xxhash64(F.lit("ordinal"), "doc_id"), "doc_id", "grade", "h").limit(sample)
    again = id_text(docs).withColumn("h", F.xxhash64("text")).join(F.broadcast(pairs_of), ["doc_id", "h"])  # at most `sample` pairs
    texts = again.groupBy("doc_id", "h", "grade").agg(F.min("text").alias("text"))
    rated = written(texts.select("doc_id", "text", "grade").mapInArrow(pairs, "doc_id long, grade int, features array<int>"), "ordinal")
    width = (1 << BITS) + len(SHAPES) * len(STEPS)
    rows = {r.grade: r.n for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return Model(np.zeros(width), np.zeros(1))
    number = np.array([rows.get(g, 0) for g in range(max(max(rows), 1) + 1)], dtype=float)
    seen = rated.select("grade", F.explode("features").alias("feature")).groupBy("feature", "grade").agg(F.count("*").alias("n")).toArrow()  # at most width rows a grade
    times = np.zeros((width, len(number)))
    times[seen.column("feature").to_numpy(), seen.column("grade").to_numpy()] = seen.column("n").to_numpy()
    strong = telling(times, number)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("features")
            flat = lists.flatten().to_numpy()
            keep = strong[flat]
            row = lists.value_parent_indices().to_numpy()[keep]
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "grade": b.column("grade"), "features": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat[keep]))})

    got = rated.mapInArrow(told, rated.schema).orderBy("doc_id", "grade", "features").toArrow().combine_chunks()
    lists = got.column("features").combine_chunks()
    return fit_pairs(lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy().astype(np.int64), got.column("grade").to_numpy().astype(np.int64))


def rate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_top (of the highest grade), kept (p_top >= least) per row.

    Null and empty texts have no features and are judged by the thresholds alone, but are never kept. Repeated
    rows are judged alike; an empty table gives no rows.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            buf, off = T.flat(part.column("text"))
            tail = model.tails(*features(buf, off), part.num_rows)
            kept = (tail[:, -1] >= least) & (np.diff(off) > 0)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "expected_grade": pa.array(tail.sum(axis=1)), "p_top": pa.array(tail[:, -1]), "kept": pa.array(kept)})

    return id_text(docs).mapInArrow(judge, "doc_id long, expected_grade double, p_top double, kept boolean")
