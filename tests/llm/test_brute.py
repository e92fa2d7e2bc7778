"""Verdicts that SQL cannot express against plain Python, words built against hashes, long texts and many rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import language_id, near_dedup, ordinal_quality, packing, substring_dedup, suffix_dedup, token_files, topk, weak_rules
from orrery.llm.queries import vocabulary

SHAPE = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def pattern(n):
    """The Thue-Morse sequence of a and b and its complement: equal under any polynomial hash modulo 2**64."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def removed(rows, window):
    """n_removed and sha256 of kept words per row, by brute force."""
    seen = collections.Counter()
    for _, t in rows:
        w = words(t)
        seen.update(" ".join(w[j : j + window]) for j in range(len(w) - window + 1))
    out = collections.Counter()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[" ".join(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[(i, sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.fixture(scope="module")
def hostile():
    x, y = ("same8888" + p for p in pattern(2048))
    plain = " ".join(f"w{i}" for i in range(17))
    return [(1, x), (2, y), (3, f"{plain} {x} {plain}x"), (4, f"{plain} {y} {plain}x"), (5, f"{x}\n{y}\nend"), (6, f"{x} a b c d {y} a b c d e f"), (7, f"{x}\n{x}\nend")]


def test_words_built_against_hashes_differ(spark, hostile):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(hostile, SHAPE).coalesce(1)
    path = vocabulary("byte_bpe_50k.json")
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_documents(token_files.write(docs, path, end=2)).collect()}
    assert ids == {i: [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2] for i, t in hostile}
    path = vocabulary("word_bpe_49k.json")
    length = collections.Counter()
    for r in packing.pack(docs, path).collect():
        length[r.doc_id] += r.length
    assert length == {i: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) + 1 for i, t in hostile}
    assert collections.Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in substring_dedup.remove(docs, window=35).collect()) == removed(hostile, 35)
    assert all(r.component_id == r.doc_id for r in near_dedup.group(docs.filter("doc_id <= 2"), 3, 85).collect())
    rules = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in weak_rules.judge(docs).collect()}
    assert rules[5] == (0, 0) and rules[6] == (0, 0) and rules[7] == (1, 0)


def test_weak_verdicts(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(3, 8))) for _ in range(200)]
    rows = []
    for i in range(400):
        w = rng.choices(vocab, k=rng.randint(5, 120))
        if i % 7 == 0:
            w = [x.upper() + "!" for x in w]
        if i % 11 == 0:
            w = [x if k % 3 else "###" for k, x in enumerate(w)]
        text = " ".join(x + ("." if k % 9 == 8 else "") + ("\n" if k % 18 == 17 else "") for k, x in enumerate(w))
        rows.append((i, text + ("\nagain and again.\n" * 9 if i % 13 == 0 else "")))
    got = {r.doc_id: r for r in weak_rules.judge(spark.createDataFrame(rows, SHAPE)).collect()}

    def vote(r):
        if r.n_words < 10:
            return (0,) * 8
        per_word, per_line, per_letter = max(r.n_words, 1), max(r.n_lines, 1), max(r.n_letters, 1)
        length, lines, ends, letters = r.word_chars / per_word, r.n_dup_lines / per_line, r.n_closed_lines / per_line, r.n_letter_words / per_word
        out = [2 if 2.5 < length < 12 else 1 if length < 2 or length > 20 else 0]
        for x, good, bad in ((r.n_symbols / per_word, 0.02, 0.1), (lines, 0.05, 0.3), (r.n_repeat_words / per_word, 0.05, 0.2), (r.n_upper / per_letter, 0.15, 0.4)):
            out.append(2 if x < good else 1 if x > bad else 0)
        out.append(2 if ends > 0.5 else 1 if ends < 0.1 else 0)
        x = r.n_decorated / per_word
        out.append(2 if x < 0.1 else 1 if x > 0.3 else 0)
        return (*out, 2 if letters > 0.9 else 1 if letters < 0.7 else 0)

    votes = {i: vote(r) for i, r in got.items()}
    share, good, bad = 0.8, [0.95] * 8, [0.3] * 8

    def posterior(v):
        yes, no = share, 1 - share
        for j, x in enumerate(v):
            if x:
                yes *= good[j] if x == 2 else 1 - good[j]
                no *= 1 - bad[j] if x == 2 else bad[j]
        return yes / (yes + no)

    for _ in range(200):
        p = {i: posterior(v) for i, v in votes.items()}
        old, share = share, (sum(p.values()) + 8) / (len(p) + 10)
        cast = [[i for i, v in votes.items() if v[j]] for j in range(8)]
        new_good = [(sum(p[i] for i in c if votes[i][j] == 2) + 9.5) / (sum(p[i] for i in c) + 10) for j, c in enumerate(cast)]
        new_bad = [(sum(1 - p[i] for i in c if votes[i][j] == 1) + 3) / (sum(1 - p[i] for i in c) + 10) for j, c in enumerate(cast)]
        good, bad = [min(max(x, 0.9), 0.98) for x in new_good], new_bad
        if abs(share - old) < 1e-9:
            break
    for i, r in got.items():
        assert r.p_good == pytest.approx(posterior(votes[i]), abs=1e-6)
        assert r.kept == (not r.base_failed and posterior(votes[i]) >= 0.5)
    assert {r.kept for r in got.values()} == {True, False}


def test_language_scores(spark):
    rng = random.Random(12)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 50)))
    rows = [(i, make(("abcdeÄé", "vwxyzÖß", "klmnop")[i % 3]).title(), "xyz"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, SHAPE + ", lang string")
    model = language_id.fit(docs, F.col("doc_id") % 4 != 2)
    hashed = lambda a, b, c: ((a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA6B & 0xFFFFFFFF) ^ (c * 0xC2B2AE35 & 0xFFFFFFFF)) >> 20
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for i, t, _ in rows:
        low = "".join(c.lower() if c.isascii() or 0xC0 <= ord(c) <= 0xDE and c != "×" else c for c in t).encode()
        low = bytes(b if 97 <= b <= 122 or b >= 0x80 else 32 for b in low)
        count = collections.Counter(hashed(*low[j : j + 3]) for j in range(len(low) - 2) if low[j + 1] != 32)
        v = {f: math.log1p(n) * float(model.idf[f]) for f, n in count.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1e-12
        cos = [sum(x * float(c[f]) for f, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cos)), key=cos.__getitem__)
        assert got[i].score == pytest.approx(min(max(cos[best], 0), 1), abs=1e-4)
        if sorted(cos)[-1] - max([c for c, m in zip(cos, model.languages, strict=True) if m != model.languages[best]]) > 1e-4:
            assert got[i].lang_pred == model.languages[best]
    held = [i for i, *_ in rows if i % 4 == 2]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97


def test_ordinal_fit_is_a_maximum():
    rng = np.random.default_rng(13)
    n, width = 400, 6
    x = rng.random((n, width)) < 0.4
    grade = np.clip((x @ np.array([2.0, 1.0, 0, -1.0, -2.0, 0.5]) + rng.logistic(size=n) + 1).astype(int), 0, 2)
    row, feature = np.nonzero(x)
    model = ordinal_quality.fit_pairs(row, feature, grade, rounds=3000)
    share = np.bincount(grade, minlength=3) / n
    weigh = np.maximum(0.1 / share, 1)[grade]

    def likelihood(w, th):
        tail = 1 / (1 + np.exp(-((x @ w)[:, None] - th)))
        full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        return (weigh * np.log(full[np.arange(n), grade] - full[np.arange(n), grade + 1])).sum() - 0.25 * (w**2).sum()

    w, th = model.weights[:width], model.thresholds
    best = likelihood(w, th)
    for d in (0.05, -0.05):
        assert all(likelihood(w + d * np.eye(width)[j], th) < best for j in range(width))
        assert all(likelihood(w, th + d * np.eye(2)[j]) < best for j in range(2))
    assert (np.diff(th) > 0).all() and (model.weights[width:] == 0).all()


def test_features_that_tell_grades_apart():
    times, rows = np.array([[50, 0], [25, 25], [1, 0], [30, 40]]), np.array([500, 500])
    assert ordinal_quality.telling(times, rows).tolist() == [True, False, False, False]


def test_many_queries_against_one_block():
    rng = np.random.default_rng(14)
    v = rng.integers(-900, 900, (4096, 16))
    ids, start = np.arange(4096), time.time()
    q = np.concatenate([v] * 5)
    s = topk.Searcher(np.tile(ids, 5), q, np.eye(16), 3, 4, np.full(len(q), -np.inf))
    s.show(ids, v)
    assert time.time() - start < 60
    some = rng.integers(0, len(q), 50)
    for k in some.tolist():
        score = v @ q[k]
        want = sorted((-int(x), i) for i, x in enumerate(score) if i != k % 4096)[:3]
        assert [(-int(a), int(b)) for a, b in zip(s.score[k], s.vec[k], strict=True)] == want


def test_empty_vectors(spark):
    table = spark.createDataFrame([(0, []), (1, [1.0, 2.0]), (2, [-1.0]), (100, [])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(topk.integer_vectors(table), F.col("vec_id") % 100 == 0, k=2).collect())
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0), (100, 1, 0, 0), (100, 2, 1, 0)]


def test_a_text_of_many_pieces(spark):
    rng = random.Random(15)
    vocab = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    big = rng.choices(vocab, k=700_000)
    edge = 1 << 19  # of a piece of words; a piece of bytes ends inside big, too
    rows = [(5, " ".join(big)), (3, " ".join(["start", *big[edge - 60 : edge + 20], "end"])), (9, " ".join(["x", *big[174_700:174_800], "y"])), (7, "")]
    docs = spark.createDataFrame(rows, SHAPE).coalesce(1)
    assert collections.Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in substring_dedup.remove(docs, window=35).collect()) == removed(rows, 35)
    text = dict(rows)
    passage = " ".join(big[edge - 60 : edge + 20])
    got = {r.doc_id: r for r in suffix_dedup.remove(docs).collect()}
    assert got[7].n_bytes == got[3].n_removed == 0 and got[5].n_bytes == len(text[5])
    first = {}
    for i in (3, 5, 9):
        b = text[i].encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for i in (5, 9):
        b = text[i].encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        assert got[i].n_removed == sum(gone) >= len(passage) - 2
        assert got[i].kept_sha256 == hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


def test_ten_thousand_empty_texts(spark):
    docs = spark.range(10_000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN '' END AS text", "'en' AS lang", "'a' AS source", "0L AS n_chars").coalesce(1)
    assert suffix_dedup.remove(docs).filter("n_removed = 0 AND n_bytes = 0").count() == 10_000
    assert near_dedup.group(docs).filter("kept AND n_shingles = 0").count() == 10_000
    model = language_id.fit(docs, F.lit(True))
    assert language_id.identify(docs, model).filter("lang_pred = 'und'").count() == 10_000
