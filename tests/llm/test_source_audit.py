"""The source audit against plain Python on rows that hold every awkward case."""

from __future__ import annotations

import collections
import random
import re

from orrery.llm import source_audit

SHAPE = "doc_id long, text string, lang string, source string, term string, n int, total long"


def brute(rows, least, top):
    count, having, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        count.update((lang, source, t) for t in terms)
        having.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (k, t), n in having.items() if k == lang and n >= least]
        sources = [s for k, s in groups if k == lang]
        total = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        share = lambda n, whole, v=len(kept): 1 + 10**9 * (n + 2) // (whole + 2 * v)
        p = {s: {t: share(count[lang, s, t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s, t] for s in sources), sum(total.values())) for t in kept}
        differ = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(differ(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-differ(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s, t] and p[s][t] > q[t])
            for part, items in (("pair", pairs), ("term", terms[:top])):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(items, 1)]
    return sorted(out)


def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["É", "日本", "x\x00y", "don't"]
    out = []
    for k in range(300):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "B", "é", None, "zz"])
        out.append((rng.choice([" ", "-", "\n"]).join(rng.choice(vocab[: 20 + k % 44]).upper() if rng.random() < 0.3 else rng.choice(vocab) for _ in range(rng.randint(0, 40))), lang, source))
    out += [(None, "en", "a"), ("", "fr", "only"), ("12 !? 34", "it", "x"), (None, "it", "y"), ("rare", "it", "x"), ("hot " * 30_000, "de", "a"), *[("same text", "en", "b")] * 12]
    return out


def test_audit_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(k, *r, "clash", 1, 2) for k, r in enumerate(data)], SHAPE).repartition(5)
    for least, top in ((10, 10), (1, 3), (10_000, 10)):
        got = sorted(tuple(r) for r in source_audit.audit(df, least, top).collect())
        assert got == brute(data, least, top)
    assert source_audit.audit(df.limit(0)).collect() == []


def test_counts_beyond_64_bits(spark):
    """Shares are exact where 10^9 times a count leaves 64 bits."""
    import duckdb

    got = duckdb.sql(f"SELECT {source_audit.SHARE.format('n', 'total')} FROM (SELECT 9000000000000000 AS n, 9100000000000000 AS total, 7 AS v)").fetchall()[0][0]
    assert got == 1 + 10**9 * (9 * 10**15 + 2) // (91 * 10**14 + 14)
