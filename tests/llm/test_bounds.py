"""Bounds on what fits read where ids repeat or are missing, and op4's rating computed again in plain Python."""

from __future__ import annotations

import collections
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import _text as T
from orrery.llm import language_id, ordinal_quality, packing
from orrery.llm.queries import QUERIES, vocabulary

SF = Path("/root/testdata/sf0.01")
needs = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@needs
def test_language_needs_no_ids(spark):
    """Many more rows than the sample, without an id or under one id, keep what the same texts with ids keep."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    many = docs.select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"), "*").withColumn("text", F.concat("text", F.lit(" "), F.col("k").cast("string"))).drop("k").cache()
    kept = {}
    for name, ids in (("own", F.col("doc_id")), ("null", F.lit(None).cast("long")), ("same", F.lit(7).cast("long"))):
        d = many.withColumn("doc_id", ids)
        kept[name] = corpus_pipeline.identify_language(spark, d, "").select("text").orderBy("text").toPandas()
    assert len(kept["own"]) > 4950 and kept["own"].equals(kept["null"]) and kept["own"].equals(kept["same"])


@needs
def test_language_sample_is_bounded(spark, monkeypatch):
    seen = []
    fit_sparse = language_id.fit_sparse
    monkeypatch.setattr(language_id, "fit_sparse", lambda f, n, languages, **o: seen.append(collections.Counter(languages)) or fit_sparse(f, n, languages, **o))
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.lit(None).cast("long"))
    a = language_id.fit(docs, F.lit(True), per_language=40)
    b = language_id.fit(docs.unionByName(docs).repartition(7), F.lit(True), per_language=40)  # copies count once
    assert set(seen[0].values()) == {40} and seen[0] == seen[1] and np.allclose(a.centroids, b.centroids)
    row = docs.filter("text IS NOT NULL").limit(1)
    one = row.unionByName(row)
    language_id.fit(one.unionByName(one), F.lit(True), per_language=1)
    assert sum(seen[-1].values()) == 1


def test_held_out_is_never_null(spark, tmp_path):
    rows = [(i if i % 5 else None, " ".join(random.Random(i).choices("the of and to in that is was".split(), k=30)), "en", "s", 1) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_language_id"](spark, str(tmp_path)).collect()
    assert len(got) == 60 and all(isinstance(r.held_out, bool) for r in got) and not any(r.held_out for r in got if r.doc_id is None)


def test_ordinal_bound_holds_where_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ordinal_quality, "fit_pairs", lambda row, feature, grade, **_: seen.append(len(grade)))
    docs = spark.createDataFrame([(1, f"text number {i} of many") for i in range(300)] + [(1, "same text here")] * 300, "doc_id long, text string")
    ratings = spark.createDataFrame([(1, i % 3) for i in range(300)], "doc_id long, g int")
    ordinal_quality.fit(docs, ratings, F.col("g"), sample=200)
    ordinal_quality.fit(docs, ratings.unionByName(ratings), F.col("g"), sample=10_000)
    assert seen == [200, 3 * 301]


def test_rating_again_in_plain_python(spark):
    rng = random.Random(8)
    vocab = ["good", "bad", "Fine", "SHOUT", "x#", "12", "w" * 40, "é"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 30)))) for i in range(60)] + [(90, None), (91, ""), (92, "good good good")]
    width = (1 << ordinal_quality.BITS) + len(ordinal_quality.SHAPES) * len(ordinal_quality.STEPS)
    weights = np.random.default_rng(4).normal(0, 0.3, width)
    model = ordinal_quality.Model(weights, np.array([-0.4, 0.9]))

    def slot(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return int(T.word_hashes(data, np.array([0]), np.array([len(data)]), 7)[0]) >> (64 - ordinal_quality.BITS)

    def want(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        some = {slot(w) for w in re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").lower())}
        flags = (
            lambda k, w: w[-1] in "#*$%&|<>",
            lambda k, w: len(re.findall("[A-Z]", w)) >= 2 and re.search(r"[A-Za-z\x80-\U0010ffff]", w),
            lambda k, w: not re.search(r"[A-Za-z\x80-\U0010ffff]", w),
            lambda k, w: k and words[k - 1] == w,
            lambda k, w: len(w.encode()) > 30,
        )
        for j, f in enumerate(flags):
            share = sum(bool(f(k, w)) for k, w in enumerate(words)) / max(len(words), 1)
            some |= {(1 << ordinal_quality.BITS) + j * 4 + s for s, at in enumerate((0.02, 0.1, 0.3, 0.6)) if share >= at}
        z = sum(weights[k] for k in some)
        tails = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        return sum(tails), tails[-1], tails[-1] >= 0.5 and bool(text)

    got = {r.doc_id: tuple(r)[1:] for r in ordinal_quality.rate(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        e, p, kept = want(text)
        assert abs(got[i][0] - e) < 1e-9 and abs(got[i][1] - p) < 1e-9 and got[i][2] == kept


def test_equal_rows_without_an_id_are_dealt_over_all_groups(spark):
    rows = [(None, "the same few words")] * 3000 + [(i, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.pack(docs, vocabulary("word_bpe_49k.json"), most=64, bins=8).toPandas()
    assert len(got) == 3100
    per = got[got.doc_id.isna()].groupby(got.sequence_id // (1 << 32)).size()
    assert len(per) >= 20 and per.max() < 3 * per.mean()
    ends = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all((g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length.to_numpy())[:-1]])).all() and g.length.sum() <= 64 for _, g in ends)
