"""Periodic runs against a search of all lags, and the op12 query's planted repeats."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import periodic_runs as P
from orrery.llm.queries import planted

SHAPE = "doc_id long, text string, runs string, row int, n_words string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, least=24, times=3):
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(w[i : i + size - p] == w[i + p : i + size] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def repeating(rng, many):
    out = []
    for _ in range(many):
        k = rng.choice([1, 2, 3, 5, 60])
        unit = [rng.randrange(k) for _ in range(rng.randint(1, 14))]
        out += [rng.randrange(k) for _ in range(rng.randint(0, 30))] if rng.random() < 0.5 else (unit * rng.randint(1, 12))[: rng.randint(1, 110)]
    return out


def test_find_equals_all_lags():
    rng = random.Random(4)
    for _ in range(120):
        rows = [repeating(rng, rng.randint(0, 6)) for _ in range(rng.randint(1, 5))]
        off = np.cumsum([0, *map(len, rows)])
        got = [[] for _ in rows]
        for r, *run in zip(*(x.tolist() for x in P.find(np.array(sum(rows, []), np.int64), off)), strict=True):
            got[r].append(tuple(run))
        assert got == [brute(r) for r in rows]


def test_lag_counts_are_exact_for_heavy_and_light_words():
    rng = np.random.default_rng(3)
    rows = [rng.geometric(0.3, n) for n in (0, 1, 50, 3000)]
    off = np.cumsum([0, *map(len, rows)])
    lags = P.LagCounts(np.concatenate(rows).astype(np.int64), off)
    for k, w in enumerate(rows):
        for q in range(1, len(w) // 3 + 1):
            assert lags.counts[lags.first[k] + q] == (w[:-q] == w[q:]).sum()


def test_long_texts_take_linear_steps_per_lag():
    start = time.perf_counter()
    assert [x.tolist() for x in P.find(np.zeros(300_000, np.int64), np.array([0, 300_000]))] == [[0], [0], [300_000], [1]]
    w = np.arange(200_000) % 40_000
    assert [x.tolist() for x in P.find(w, np.array([0, len(w)]))] == [[0], [0], [200_000], [40_000]]
    assert time.perf_counter() - start < 60


def test_collapse_and_digest(spark):
    rng = random.Random(9)
    text = lambda w: " ".join(f"w{x}" for x in w)
    rows = [(i, text(repeating(rng, 5))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "one"), (104, "a b " * 12 + "a"), (105, "a\tb\n" * 12), (106, "é 日 " * 30), (None, "x " * 24), (None, "x " * 24), (104, "a b " * 12 + "a"), (107, "A a " * 13), (108, "w " * 23), (109, "a " * 30 + "b " * 30)]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SHAPE).repartition(3)
    got = sorted((tuple(r) for r in P.digest(P.collapse(docs)).collect()), key=str)
    want = []
    for i, t in rows:
        w = words(t)
        runs = brute(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        top = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert got == sorted(want, key=str)
    assert P.digest(P.collapse(docs.limit(0))).collect() == []


def test_planted_order(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(200)] + [(None, "a b c"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((tuple(r) for r in P.reordered(docs, planted).collect()), key=str)
    want = []
    for i, t in rows:
        w, h = words(t), zlib.crc32(str(i).encode())
        n = len(w)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a, m = g % n, 3 + g % 8
            w = [w[k] if k < a else w[a + (k - a) % (1 + (n - a) // m)] for k in range(n)]
        want.append((i, " ".join(w)))
    assert got == sorted(want, key=str)
    assert docs.select(F.crc32(F.lit("7").cast("binary"))).first()[0] == zlib.crc32(b"7")
