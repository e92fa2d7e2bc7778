"""The operators against brute force on small tables that hold every awkward case."""

from __future__ import annotations

import collections
import hashlib
import inspect
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import _repeats, language_id, mixing, near_dedup, ordinal_quality, packing, substring_dedup, suffix_dedup, token_files, topk, weak_rules
from orrery.llm.queries import vocabulary

# names that the operators use inside
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, key long, spans string, a int, size string, carried int, row string, band long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = make(200), make(60)
    near = base.split()
    near[17] = "changed"
    out = [base, base, " ".join(near), base.upper(), make(120) + " " + passage + " " + make(50), make(80) + "\n" + passage, passage, "", None, "   \n\t", "one", "one two", "die die die " * 40, make(30) + " é日本 \x1c ok", "x" * 300, "x" * 300 + "y", make(6000), "a  b   c", "<|endoftext|> odd # 2", make(10)]
    near[50:60] = ["other"] * 10
    return [*out, " ".join(near), make(40), make(40)]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "c"][i % 4], len(t or "")) for i, t in enumerate(texts())]
    return [*out, out[4], out[7], (None, "no id " * 30, "en", "a", 5), (1000, "no id " * 30, "en", "a", 5)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "3", 4, "y", 5) for r in rows], SHAPE).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_suffix_dedup(docs, rows, empty):
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(docs).collect())
    order = lambda i: 1 << 62 if i is None else i
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            first[b[j : j + 50]] = min(order(i), first.get(b[j : j + 50], 1 << 62))
    want = collections.Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < order(i):
                gone[j : j + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[(i, len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())] += 1
    assert got == want
    assert suffix_dedup.remove(empty).count() == 0


def test_suffix_sort():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 400).astype(np.uint8)
    start = np.sort(rng.integers(0, 380, 120))
    end = np.minimum(start + rng.integers(1, 60, 120), 400)
    groups = np.array([0, 1, 40, 42, 120])
    s = suffix_dedup.Suffixes(buf, start, end)
    order = suffix_dedup.merge_sort(s, groups)
    text = [buf[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    for a, b in zip(groups, groups[1:], strict=False):
        assert sorted(order[a:b]) == list(range(a, b))
        assert [text[k] for k in order[a:b]] == sorted(text[a:b])
    lcp = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    order, common = suffix_dedup.neighbours(s, groups)
    assert common.tolist() == [-1 if k in groups else lcp(text[order[k - 1]], text[order[k]]) for k in range(120)]


def test_hot_anchors_give_the_same_spans(docs):
    want = collections.Counter((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(docs).collect())
    assert collections.Counter((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(docs, most=1).collect()) == want


def test_full_tables_of_sent_anchors_lose_no_window(spark, monkeypatch):
    """Passages of one window, many anchors for each place of a partition's table: no anchor is taken for another."""
    monkeypatch.setattr(_repeats, "SLICE", 1000)
    rng = random.Random(8)
    make = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    passages = [make(50) for _ in range(40)]
    rows = [(i, make(rng.randint(60, 200)) + "#%"[i // 40] + passages[i % 40] + "#%"[i // 40] + make(90)) for i in range(80)]
    for parts, bits in ((1, 10), (3, 4)):
        monkeypatch.setattr(_repeats, "OWN_BITS", bits)
        got = suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert {r.doc_id: r.n_removed for r in got} == {i: 50 if i >= 40 else 0 for i in range(80)}
    passages = [" ".join(make(6).replace(" ", "x") for _ in range(35)) for _ in range(20)]
    rows = [(i, f"{make(200)} {i}a {passages[i % 20]} {i}b {make(90)}") for i in range(40)]
    got = substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), window=35).collect()
    assert {r.n_removed for r in got} == {35} and len(got) == 40


def test_substring_dedup(docs, rows, empty):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove(docs, window=35).collect())
    count = collections.Counter(tuple(w[j : j + 35]) for _, t, *_ in rows for w in [words(t)] for j in range(len(w) - 34))
    want = collections.Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if count[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[(i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert got == want
    assert substring_dedup.remove(empty).count() == 0
    carried = substring_dedup.remove(docs, carry=["doc_id", "text", "carried"]).select("carried.*")
    assert carried.columns == ["doc_id", "text", "carried"] and carried.count() == len(rows)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(docs, rows, empty, size, percent):
    sets, ids = {}, [1 << 62 if r[0] is None else r[0] for r in rows]
    for i, (_, t, *_) in zip(ids, rows, strict=True):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.group(docs, size, percent).collect())
    real = lambda i: None if i == 1 << 62 else i
    assert got == collections.Counter((real(i), len(sets[i]), real(root[i]), root[i] == i) for i in ids)
    assert near_dedup.group(empty).count() == 0


def test_blocks_agree_with_one_block(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(150)] = f"v{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(r.doc_id, r.component_id) for r in near_dedup.group(docs, 3, 85).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    assert {(r.doc_id, r.component_id) for r in near_dedup.group(docs, 3, 85).collect()} == want


def test_estimate_is_near_the_jaccard_index():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 1 << 52, 3000).astype(np.uint64))
    a, b = h[:2000], h[200:2200]
    regs = near_dedup.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 128, 8)
    assert abs((regs[0] == regs[1]).mean() - 1800 / 2200) < 0.06


def test_token_files(docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    files = token_files.write(docs, vocabulary("byte_bpe_50k.json"), end=2, length=64, rows=4, path=f"file://{tmp_path}/t")
    got = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_files.read_documents(files).collect())
    want, start = [], 0
    for i, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.append((start, i, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    sums = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_checksums(files).collect())
    assert sums == [(s, i, n, zlib.crc32(ids)) for s, i, n, ids in want]
    f = token_files.SequenceFile(files.orderBy("start").first().path + ".tokens.arrow")
    ids, mask = f.sequence(0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata
    assert token_files.read_documents(token_files.write(empty, vocabulary("byte_bpe_50k.json"))).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = packing.pack(docs, vocabulary("word_bpe_49k.json"), end=1, most=256).toPandas()
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 256):
            want[(i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes()))] += 1
    key = lambda r: (None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert collections.Counter(key(r) for r in got.itertuples()) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 256 and s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 1
    assert packing.pack(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_best_fit():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 101, 500)
    sequence, place = packing.best_fit(lengths, 100)
    rooms, want = [], []
    for k in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[k]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[k])
        else:
            rooms.append(100 - lengths[k])
    assert sequence.max() + 1 == len(rooms)
    used = np.bincount(sequence, weights=lengths)
    assert used.max() <= 100 and sorted(100 - used) == sorted(rooms)


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    size = lambda t: len(words(t))
    total, per = sum(size(r[1]) for r in rows), collections.Counter()
    for r in rows:
        per[r[3]] += size(r[1])
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    open_, target, left = set(names), {}, 1.5 * total
    while True:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > 2 * per[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * per[s]
            left -= target[s]
            open_.discard(s)
    target |= part
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == per[r.source] and r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
    for s in names:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 2 * max(size(r[1]) for r in rows if r[3] == s)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mix(empty).count() == 0
    sample = mixing.sample(docs)
    assert sample.columns == docs.columns and sample.count() == sum(r.copies for r in got)


def test_top_k(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 5)]) for i in range(300)]
    vectors += [(300, None), (400, [1.0, None] * 4), (500, [float("nan")] * 8), (600, [float("inf")] * 8), (7, vectors[8][1]), (8, vectors[8][1]), (900, [0.0] * 8)]
    table = spark.createDataFrame([(*v, 1, 2.0) for v in vectors], "vec_id long, embedding array<double>, v int, norm double").repartition(3)
    got = collections.defaultdict(list)
    for r in topk.top_k(topk.integer_vectors(table), F.col("vec_id") % 100 == 0, k=5, chunk=2, head=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)[:5]
            assert got.pop(q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert not got
    assert topk.top_k(topk.integer_vectors(table.limit(0)), F.lit(True)).count() == 0
    big = spark.createDataFrame([(0, [1e15] * 4), (1, [1e15] * 4), (2, [1e14] * 4)], "vec_id long, embedding array<double>")
    assert topk.top_k(topk.integer_vectors(big), F.col("vec_id") == 0, k=1).first().score == (1 << 63) - 1


def test_weak_rules(docs, rows, empty):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in weak_rules.judge(docs).collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        wins = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        many, cover = collections.Counter(wins), set()
        for j, x in enumerate(wins):
            if many[x] > 1:
                cover.update(range(j, j + 5))
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))] += 1
    assert got == want
    assert all(not (r.kept and r.base_failed) for r in weak_rules.judge(docs).collect())
    assert weak_rules.judge(empty).count() == 0


def test_em_learns_which_rules_agree():
    rng = np.random.default_rng(7)
    good = rng.random(5000) < 0.8
    votes = np.where(good[:, None], np.where(rng.random((5000, 6)) < 0.97, 2, 1), np.where(rng.random((5000, 6)) < 0.4, 2, 1))
    patterns, number = np.unique(votes, axis=0, return_counts=True)
    share, _, _ = fitted = weak_rules.fit(patterns, number.astype(float))
    assert abs(share - 0.8) < 0.05 and ((weak_rules.posterior(votes, *fitted) >= 0.5) == good).mean() > 0.97


def test_language_id(spark, docs, rows, empty):
    rng = random.Random(8)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    train = [(i, make("abcde"), "x") for i in range(40)] + [(i, make("vwxyz"), "y") for i in range(40, 80)] + [(99, None, "x"), (98, "abc", None)]
    model = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), F.col("doc_id") % 2 == 0)
    assert set(model.languages) == {"x", "y"}
    held = spark.createDataFrame([*train, (200, "123 --", "x"), (201, "日本", "y")], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.identify(held, model).collect()}
    assert all(out[i].lang_pred == lang and 0 < out[i].score <= 1 and not out[i].rejected for i, t, lang in train[:80])
    assert (out[99].lang_pred, out[99].score, out[99].rejected) == ("und", 0.0, True) and out[200].lang_pred == "und" and out[201].lang_pred in ("x", "y")
    assert language_id.identify(docs, model).count() == len(rows) and language_id.identify(empty, model).count() == 0
    nothing = language_id.fit(empty, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.keep_identified(docs, model).columns == docs.columns


def test_language_fit_is_sparse_and_of_a_thousand_texts():
    assert inspect.signature(language_id.fit).parameters["per_language"].default >= 1000
    rng = np.random.default_rng(4)
    counts = (rng.poisson(0.02, (60, language_id.DIM)) * rng.integers(1, 70_000, (60, 1))).astype(np.float32)
    names = ["x", "y", "y"] * 20
    some = [np.flatnonzero(c) for c in counts]
    a = language_id.fit_counts(counts, names)
    b = language_id.fit_sparse(pa.array([k.astype("<u2").tobytes() for k in some]), pa.array([c[k].astype("<u4").tobytes() for c, k in zip(counts, some, strict=True)]), names)
    assert a.languages == b.languages and (a.centroids == b.centroids).all() and (a.limits == b.limits).all() and (a.idf == b.idf).all()


def test_ordinal_quality(spark, docs, rows, empty):
    rng = random.Random(9)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    made = []
    for i in range(600):
        w, grade = rng.choices(vocab, k=60), i % 3
        if grade == 0:
            w[5] = "vile"
        elif grade == 1:
            w = [x + "###" for x in w]
        made.append((i, " ".join(w), grade))
    table = spark.createDataFrame(made, "doc_id long, text string, grade int")
    model = ordinal_quality.fit(table.select("doc_id", "text"), table.filter("doc_id < 300").select("doc_id", "grade"), F.col("grade"))
    assert (np.diff(model.thresholds) > 0).all()
    out = {r.doc_id: r for r in ordinal_quality.rate(table, model).collect()}
    assert np.mean([out[i].kept == (g == 2) for i, _, g in made if i >= 300]) > 0.95
    mean = [np.mean([out[i].expected_grade for i, _, g in made if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert ordinal_quality.rate(docs, model).count() == len(rows) and ordinal_quality.rate(empty, model).count() == 0
    assert not any(r.kept for r in ordinal_quality.rate(docs.filter("text IS NULL OR text = ''"), model).collect())
