"""Weak supervision of quality: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at counts of one text and votes good, bad or abstains. Two accuracies per rule (votes on good and
on bad documents) and the share of good documents are estimated by EM from how the votes agree over all documents,
without labels; the posterior that a document is good replaces "all rules must pass". EM needs only the number of
documents per vote pattern, at most 3 ** rules rows however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import _text as T
from orrery.llm._spark import Scratch, id_text

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_closed_lines", "n_letter_words", "n_decorated")

MOST = (0.9, 0.98)


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def counts(buf: np.ndarray, off: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """COUNTS of each row of a flat buffer."""
    starts, ends, word_off = T.word_bounds(buf, off)
    n = len(off) - 1
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    lead = (buf & 0xC0) != 0x80
    upper = (buf >= 65) & (buf <= 90)
    letter = upper | ((buf >= 97) & (buf <= 122)) | (buf >= 0xC3)
    out = {"n_words": np.diff(word_off), "word_chars": _per_row(lead & ~T.SPACE[buf], off), "n_symbols": _per_row(table[buf], off), "n_upper": _per_row(upper, off), "n_letters": _per_row(letter, off)}
    letters = np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])
    out["n_letter_words"] = _per_row(letters[ends] > letters[starts], word_off)
    marks = table.copy()
    marks[33] = True
    out["n_decorated"] = _per_row(marks[buf[ends - 1]] if len(ends) else np.zeros(0, bool), word_off)
    # lines: cut at \n and at row ends; only lines with a word count
    edge = np.flatnonzero(buf == 10)
    line_start, line_end = np.concatenate([off[:-1], edge + 1]), np.concatenate([off[1:], edge])
    line_start, line_end = np.sort(line_start), np.sort(line_end)
    first, last = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    full = last > first
    line_start, line_end, last = line_start[full], line_end[full], last[full]
    row = np.searchsorted(off, line_start, side="right") - 1
    h = T.span_hashes(buf, line_start, line_end, 5)
    out["n_lines"] = np.bincount(row, minlength=n)
    key = T.combine(h, row.astype(T.U))
    _, distinct = np.unique(key, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[distinct], minlength=n)
    tail = buf[ends[last - 1] - 1] if len(last) else np.zeros(0, np.uint8)
    out["n_closed_lines"] = np.bincount(row[np.isin(tail, list(b'.!?"'))], minlength=n)
    # words in windows that a row holds twice or more
    at, row = T.windows(word_off, window)
    wh = T.gram_hashes(T.word_hashes(buf, starts, ends), window)[at]
    _, inverse, times = np.unique(T.combine(wh, row.astype(T.U)), return_inverse=True, return_counts=True)
    out["n_repeat_words"] = _per_row(T.covered(len(starts), at[times[inverse] > 1], window), word_off)
    return out


def votes(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rows x rules: 2 good, 1 bad, 0 abstain. The thresholds are the rules' definition."""
    words, lines, letters = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["n_letters"], 1)
    few = c["n_words"] < 10
    ratio = (
        (c["word_chars"] / words, lambda x: (x > 2.5) & (x < 12), lambda x: (x < 2) | (x > 20)),  # word length
        (c["n_symbols"] / words, lambda x: x < 0.02, lambda x: x > 0.1),  # symbols
        (c["n_dup_lines"] / lines, lambda x: x < 0.05, lambda x: x > 0.3),  # repeated lines
        (c["n_repeat_words"] / words, lambda x: x < 0.05, lambda x: x > 0.2),  # repeated windows
        (c["n_upper"] / letters, lambda x: x < 0.15, lambda x: x > 0.4),  # capitals
        (c["n_closed_lines"] / lines, lambda x: x > 0.5, lambda x: x < 0.1),  # lines that end a sentence
        (c["n_decorated"] / words, lambda x: x < 0.1, lambda x: x > 0.3),  # words that end in a symbol or "!"
        (c["n_letter_words"] / words, lambda x: x > 0.9, lambda x: x < 0.7),  # words with a letter
    )
    out = np.stack([np.where(good(x), 2, np.where(bad(x), 1, 0)) for x, good, bad in ratio], axis=1)
    return np.where(few[:, None], 0, out)


def fit(patterns: np.ndarray, number: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents and each rule's accuracy on good and on bad ones, by EM over vote patterns.

    Starts from accuracies of 0.95 and 0.3, because a rule sees one kind of fault; the same values weigh as ten
    pseudo-votes. Accuracy on good documents stays within MOST, so that no single rule decides against all others.
    """
    rules = patterns.shape[1]
    share, on_good, on_bad = 0.8, np.full(rules, 0.95), np.full(rules, 0.3)
    good, bad = patterns == 2, patterns == 1
    for _ in range(rounds):
        p = posterior(patterns, share, on_good, on_bad)
        w, v = number * p, number * (1 - p)
        new = (w.sum() + 8) / (number.sum() + 10)
        g = (w @ good + 9.5) / (w @ (good | bad) + 10)
        b = (v @ bad + 3) / (v @ (good | bad) + 10)
        done = abs(new - share) < 1e-9
        share, on_good, on_bad = new, np.clip(g, *MOST), np.clip(b, 1e-6, 1 - 1e-6)
        if done:
            break
    return share, on_good, on_bad


def posterior(patterns: np.ndarray, share: float, on_good: np.ndarray, on_bad: np.ndarray) -> np.ndarray:
    """Probability that a document with these votes is good; abstentions say nothing."""
    good, bad = patterns == 2, patterns == 1
    logit = np.log(share / (1 - share)) + good @ np.log(on_good / (1 - on_bad)) + bad @ np.log((1 - on_good) / on_bad)
    return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, base_failed, p_good, kept per row.

    base_failed: fewer than 10 words, or more than 20% of words in repeated 5-word windows. Null and empty texts
    have counts of 0 and fail. kept: not base_failed and p_good >= least. Repeated rows are judged alike; an empty
    table gives no rows.
    """
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            c = counts(*T.flat(part.column("text")))
            v = votes(c)
            pattern = v @ (3 ** np.arange(v.shape[1]))
            yield pa.record_batch({"doc_id": part.column("doc_id")} | {k: pa.array(c[k].astype(np.int64)) for k in COUNTS} | {"pattern": pa.array(pattern.astype(np.int32))})

    counted = Scratch(spark, "rules").table(id_text(docs).mapInArrow(count, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", pattern int"))
    seen = counted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    rules = len(votes({k: np.zeros(1) for k in COUNTS})[0])
    patterns = np.array([[r.pattern // 3**j % 3 for j in range(rules)] for r in seen], dtype=np.int64).reshape(-1, rules)
    p = posterior(patterns, *fit(patterns, np.array([r.n for r in seen], dtype=float))) if seen else []
    table = spark.createDataFrame([(r.pattern, float(x)) for r, x in zip(seen, p, strict=True)], "pattern int, p_good double")
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    judged = counted.join(F.broadcast(table), "pattern").withColumn("base_failed", failed)  # at most 3 ** rules rows
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least)).drop("pattern")
