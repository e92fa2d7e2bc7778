"""Tiled vector search against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from orrery.operators import nearest

SHAPE = "vec_id long, label int, embedding array<float>, id string, side int, v string"


@pytest.mark.parametrize("chunk", [nearest.CHUNK, 200])
def test_equals_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(nearest, "CHUNK", chunk)
    monkeypatch.setattr(nearest, "CELLS", 64)
    rng = np.random.default_rng(2)
    rows = [(k, int(rng.integers(0, 3)) if k % 2 else 0, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(150)]  # many ties
    rows += [(200, 1, [1.0, 2.0]), (201, 1, [2.0, 4.0]), (202, 1, None), (203, None, [1.0] * 4), (None, 0, [1.0] * 4), (204, 0, [1.0, None, 1.0, 1.0]), (205, 0, [float("nan")] * 4), (206, 0, [float("inf"), 0.0, 0.0, 0.0]), (207, 9, [1.0] * 4), (208, 0, [0.0] * 4)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SHAPE).repartition(3)
    got = sorted(tuple(r) for r in nearest.nearest_of_kind(df, df.filter("vec_id % 10 = 0 OR vec_id > 199"), k=4).collect())
    good = [(i, l, np.array(v)) for i, l, v in rows if i is not None and l is not None and v is not None and None not in v and np.isfinite(v).all()]
    unit = lambda v: v / np.sqrt((v * v).sum()) if v.any() else v
    want = []
    for i, l, v in good:
        if i % 10 == 0 or i > 199:
            near = sorted((-np.floor(unit(v) @ unit(w) * 10_000 + 0.5), j) for j, m, w in good if m == l and j != i and len(w) == len(v))[:4]
            want += [(i, j, round(-s / 10_000, 4)) for s, j in near]
    assert [g[:2] for g in got] == sorted(w[:2] for w in want) or got == sorted(want)
    assert got == sorted(want)
    assert nearest.nearest_of_kind(df.limit(0), df.limit(0)).collect() == []
