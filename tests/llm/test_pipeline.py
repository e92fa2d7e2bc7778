"""The pipeline on a small table; each stage's decisions against what it was given."""

from __future__ import annotations

import collections
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from orrery.llm import language_id, mixing
from orrery.llm.queries import vocabulary

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs.count()
        stage(spark, docs, str(SF)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert after.dtypes == docs.dtypes
        if k < 2:
            assert after.join(docs, docs.columns, "left_anti").count() == 0
        if name == "substring_dedup":
            assert after.count() == before
        docs = after
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0


def test_stages_on_awkward_rows(spark):
    rows = [(1, None, None, None, None), (1, "", "en", "a", 0), (2, "some words in a row " * 20, "en", "a", 1), (2, "some words in a row " * 20, "en", "a", 1), (None, "text", None, "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {name: collections.Counter((r.doc_id, getattr(r, "text", None)) for r in stage(spark, docs, "").collect()) for name, stage in P.STAGES}
    text = rows[2][1]
    assert got["language_id"] == {(2, text): 2}  # texts without a letter, and one like nothing that was learned, go
    assert got["near_dedup"] == {(1, None): 1, (1, ""): 1, (2, text): 2, (None, "text"): 1}  # rows of one id are one document
    assert got["substring_dedup"] == {(1, None): 1, (1, ""): 1, (2, ""): 2, (None, "text"): 1}  # both copies are repeated
    assert {k[0] for k in got["mixing"]} <= {1, 2, None} and got["mixing"][(2, text)] in (2, 3, 4)
    assert {k[0]: n for k, n in got["packing"].items()} == {1: 2, 2: 2, None: 1}
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), "").collect() == []


def test_documents_without_an_id_stay(spark):
    text = lambda n, size=60: " ".join(f"w{n}x{j}" for j in range(size))
    rows = [(1, text(1)), (2, text(2)), (None, text(1) + " end"), (None, text(3)), (None, text(3)), (None, text(3).upper()), (None, text(4)), (None, text(5)), (None, text(5) + " end"), (None, ""), (None, None), (None, " "), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    left = P.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [1, 2, 3]
    own = sorted((r.text or "").lower().split()[:1] for r in left if r.doc_id is None)
    assert own == [[], [], [], ["w3x0"], ["w4x0"], ["w5x0"]]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def corpus(spark):
    """The smallest documents, with rows without an id, repeated rows, and nulls in every column."""
    if not SF.exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.filter("doc_id % 10 = 0").withColumn("doc_id", F.lit(None).cast("long"))
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (7001, None, None, "web", None), (7002, "alone " * 60 + "and nothing else", "en", None, 1), (7002, "alone " * 60 + "and nothing else", "en", None, 1)]
    return docs.unionByName(some).unionByName(spark.createDataFrame(odd, docs.schema)).cache()


def test_language_stage_drops_what_the_model_rejects(spark, corpus):
    model = language_id.fit(corpus, F.lit(True))
    left = collections.Counter(tuple(r) for r in P.identify_language(spark, corpus, "").collect())
    texts = corpus.select("text").distinct().withColumn("doc_id", F.monotonically_increasing_id()).cache()
    good = {r.text for r in texts.join(language_id.identify(texts, model).filter("NOT rejected"), "doc_id").select("text").collect()}
    assert left == collections.Counter(tuple(r) for r in corpus.collect() if r.text in good)
    labelled = [r for r in corpus.filter("lang IS NOT NULL AND length(text) > 200").collect()]
    assert sum(r.text in good for r in labelled) >= 0.98 * len(labelled)


def test_near_duplicate_stage_keeps_one_of_each_group(spark, corpus):
    rows = corpus.collect()
    lower = lambda t: words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    keys, sets = {}, {}
    for r in rows:  # rows of one id are one document, and so are rows without an id of one text
        w, key = lower(r.text), r.doc_id if r.doc_id is not None else ("text", r.text or "")
        keys[key] = r
        sets[key] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    both = collections.Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in sets:
        groups[find(k)].append(k)
    left = P.near_duplicates(spark, corpus, "").collect()
    kept = collections.Counter(r.doc_id if r.doc_id is not None else ("text", r.text or "") for r in left)
    for members in groups.values():
        ids = sorted(k for k in members if isinstance(k, int))
        stay = [k for k in members if k in kept]
        assert len(stay) == 1 and (not ids or stay == ids[:1])
    assert all(tuple(r) in {tuple(x) for x in rows} for r in left) and len(groups) < len(sets)


def test_substring_stage_cuts_repeated_windows(spark, corpus):
    rows = corpus.collect()
    seen = collections.Counter()
    for r in rows:
        w = words(r.text)
        seen.update(" ".join(w[j : j + 35]) for j in range(len(w) - 34))
    want = collections.Counter()
    for r in rows:
        w = words(r.text)
        gone = set()
        for j in range(len(w) - 34):
            if seen[" ".join(w[j : j + 35])] > 1:
                gone.update(range(j, j + 35))
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else r.text
        want[(r.doc_id, text, r.lang, r.source, None if text is None else len(text))] += 1
    assert collections.Counter(tuple(r) for r in P.repeated_substrings(spark, corpus, "").collect()) == want


def test_mixing_stage_repeats_rows_as_the_mix_says(spark, corpus):
    tag = F.xxhash64(*corpus.columns)
    copies = collections.Counter()
    for r in mixing.mix(corpus, tag=tag).collect():
        copies[r.tag] += r.copies
    got = collections.Counter(r.tag for r in P.mix_sources(spark, corpus, "").select(tag.alias("tag")).collect())
    assert got == +copies
    size = collections.Counter()
    for r in corpus.collect():
        size[r.source] += len(words(r.text))
    taken = collections.Counter()
    for r in P.mix_sources(spark, corpus, "").collect():
        taken[r.source] += len(words(r.text))
    names = sorted(size, key=lambda x: (x is None, x or ""))
    weight, left, target = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}, 1.5 * sum(size.values()), {}
    while len(target) < len(names):
        rest = [n for n in names if n not in target]
        part = {n: left * weight[n] / sum(weight[x] for x in rest) for n in rest}
        over = [n for n in rest if part[n] > 2 * size[n]]
        if not over:
            target |= part
        for n in over:
            target[n], left = 2 * size[n], left - 2 * size[n]
    longest = max(len(words(r.text)) for r in corpus.collect())
    assert all(abs(taken[n] - target[n]) <= 2 * longest for n in names)


def test_packing_stage_keeps_every_id(spark, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = collections.Counter()
    for r in corpus.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        want.update((r.doc_id, k // 4096, k, min(4096, n - k)) for k in range(0, n, 4096))
    got = P.pack_sequences(spark, corpus, "").toPandas()
    assert collections.Counter((None if x.doc_id != x.doc_id else int(x.doc_id), x.piece, x.start, x.length) for x in got.itertuples()) == want
    filled = got.groupby("sequence_id").length.sum()
    assert filled.max() <= 4096 and len(filled) <= -(-filled.sum() // 4096) * 1.02 + 1
