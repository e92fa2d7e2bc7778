"""Language identification by nearest centroid of TF-IDF n-gram vectors.

A text is a normalised vector of hashed byte trigrams of its letters (lower case, other characters as one kind of
gap), weighed by inverse document frequency. Each language has several centroids, found by spherical k-means among
its training texts; a text gets the language of the centroid with the largest cosine. A text whose cosine is below
its language's limit, a part of the lowest training cosines, is rejected.

The fit uses at most `per_language` different labelled texts of each language: those of the least hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import _text as T
from orrery.llm._spark import id_text

DIM = 1 << 12
ROWS = 1024  # of texts whose dense counts are held at a time
UNKNOWN = "und"


def _folded(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case (ASCII and Latin-1), all other ASCII bytes as spaces; and which bytes are letters or above ASCII."""
    out = T.lower_ascii(buf)
    second = np.zeros(len(buf), bool)
    second[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    out[second] += 0x20
    text = ((out >= 97) & (out <= 122)) | (out >= 0x80)
    out[~text] = 32
    return out, text


def vectors(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x DIM counts of hashed trigrams that hold a letter."""
    n = len(off) - 1
    out = np.zeros((n, DIM), np.float32)
    if len(buf) < 3:
        return out
    x, text = _folded(buf)
    y = x.astype(np.uint32)
    gram = ((y[:-2] * np.uint32(0x9E3779B1)) ^ (y[1:-1] * np.uint32(0x85EBCA6B)) ^ (y[2:] * np.uint32(0xC2B2AE35))) >> np.uint32(20)
    row = np.repeat(np.arange(n), np.diff(off))
    keep = (row[:-2] == row[2:]) & text[1:-1]
    out.ravel()[:] = np.bincount(row[:-2][keep] * DIM + gram[keep], minlength=n * DIM)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]  # by centroid
    centroids: np.ndarray
    limits: np.ndarray
    idf: np.ndarray

    def score(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best centroid and its cosine."""
        cos = _unit(np.log1p(counts) * self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        return best, np.clip(cos[np.arange(len(best)), best], 0.0, 1.0)


def fit_counts(counts: np.ndarray, languages: list[str], per: int = 3, rounds: int = 20, strict: float = 0.5) -> Model:
    """The model of rows of trigram counts and their languages."""
    names = np.array(languages)
    return _fit_parts(len(counts), (counts > 0).sum(axis=0), ((name, counts[names == name]) for name in sorted(set(languages))), per, rounds, strict)


def fit_sparse(features: pa.Array, numbers: pa.Array, languages: list[str], **options) -> Model:
    """fit_counts of rows of features and their numbers, both as bytes; one language at a time is made dense."""
    names, rows = np.array(languages), [(np.frombuffer(f.as_py(), "<u2"), np.frombuffer(n.as_py(), "<u4")) for f, n in zip(features, numbers, strict=True)]

    def dense(name: str) -> np.ndarray:
        own = np.flatnonzero(names == name)
        out = np.zeros((len(own), DIM), np.float32)
        for i, k in enumerate(own):
            out[i, rows[k][0]] = rows[k][1]
        return out

    having = np.bincount(np.concatenate([np.zeros(0, "<u2"), *[f for f, _ in rows]]), minlength=DIM)
    return _fit_parts(len(rows), having, ((name, dense(name)) for name in sorted(set(languages))), **options)


def _fit_parts(n: int, having: np.ndarray, parts_of: Iterable[tuple[str, np.ndarray]], per: int = 3, rounds: int = 20, strict: float = 0.5) -> Model:
    """The model of n rows, having[j] of them with feature j, given as counts by language."""
    idf = (np.log((1 + n) / (1 + having)) + 1).astype(np.float32)
    centroids, limits, of = [], [], []
    for name, counts in parts_of:
        own = _unit(np.log1p(counts) * idf)
        # starts: means of equal parts along the direction of most variance, found by power iteration
        apart = own - own.mean(axis=0)
        along = apart[int((apart**2).sum(axis=1).argmax())]
        for _ in range(rounds):
            along = apart.T @ (apart @ along)
            along /= max(np.linalg.norm(along), 1e-12)
        parts = np.array_split(np.argsort(apart @ along, kind="stable"), min(per, len(own)))
        c = _unit(np.stack([own[p].mean(axis=0) for p in parts]))
        for _ in range(rounds):
            at = (own @ c.T).argmax(axis=1)
            c = _unit(np.stack([own[at == j].sum(axis=0) if (at == j).any() else c[j] for j in range(len(c))]))
        members = np.bincount((own @ c.T).argmax(axis=1), minlength=len(c))
        c = c[members >= min(0.01 * len(own), members.max())]  # a few odd texts make no centroid
        limit = strict * float(np.quantile((own @ c.T).max(axis=1), 0.01))
        centroids.extend(c)
        limits += [limit] * len(c)
        of += [name] * len(c)
    return Model(of, np.array(centroids, np.float32).reshape(-1, len(idf)), np.array(limits), idf)


def fit(docs: DataFrame, may_learn: Column, per_language: int = 1000, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on rows that may_learn allows and that have a language and a text, at most per_language different texts of each language.

    Ids are not looked at, so rows without one, or under one id, count like others; equal texts of a language count once.
    """
    rows = docs.filter(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("h", F.xxhash64(F.lit("language"), "text"))
    number = {r.lang: max(1, r.n) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # one row per language
    if not number:
        return Model([], np.zeros((0, DIM), np.float32), np.zeros(0), np.ones(DIM, np.float32))
    # about twice as many as needed by a share of the hashes, then the least ones exactly
    rate = F.create_map(*[F.lit(x) for k, n in sorted(number.items()) for x in (k, min(1.0, 2 * per_language / n))])
    some = rows.filter(F.pmod("h", F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * F.lit(float(1 << 30)))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    chosen = some.groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, rows=ROWS):
            c = vectors(*T.flat(part.column("text")))
            some = [np.flatnonzero(x) for x in c]
            f = [k.astype("<u2").tobytes() for k in some]
            n = [x[k].astype("<u4").tobytes() for x, k in zip(c, some, strict=True)]
            yield pa.record_batch({"lang": part.column("lang"), "f": pa.array(f, pa.binary()), "n": pa.array(n, pa.binary())})

    got = chosen.select("text", "lang").mapInArrow(counted, "lang string, f binary, n binary").orderBy("lang", "f", "n").toArrow()
    return fit_sparse(got.column("f"), got.column("n"), got.column("lang").to_pylist())


SHAPE = "struct<lang_pred: string, score: double, rejected: boolean>"


def predict(text: pa.Array, model: Model) -> pa.StructArray:
    """SHAPE of each text; see identify."""
    names, parts = np.array([*model.languages, UNKNOWN], dtype=object), []
    for part in T.slices(iter([pa.record_batch({"text": text})]), rows=ROWS):
        buf, off = T.flat(part.column("text"))
        n, low = part.num_rows, T.lower_ascii(buf)
        letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
        some = letters[off[1:]] > letters[off[:-1]]
        for k in np.flatnonzero(~some).tolist():  # few: texts without an ASCII letter
            some[k] = any(map(str.isalpha, buf[off[k] : off[k + 1]].tobytes().decode()))
        best, cos = np.full(n, len(model.languages)), np.zeros(n)
        if len(model.languages):
            best, cos = model.score(vectors(buf, off))
            best, cos = np.where(some, best, len(model.languages)), np.where(some, cos, 0.0)
        limit = np.append(model.limits, 2.0)[best]
        parts.append(pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(cos.astype(float)), pa.array(cos < limit)], ["lang_pred", "score", "rejected"]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))


def predictor(model: Model) -> Callable[[Column], Column]:
    """A column function: SHAPE of a text column, in Arrow batches."""

    def one(text: pa.Array) -> pa.Array:
        return predict(text, model)

    return F.arrow_udf(one, SHAPE)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected per row.

    A text without any letter, null or empty, gives 'und' with score 0, rejected; so does every text if the model
    has no language. Rejected texts keep their nearest language in lang_pred. Repeated rows are judged alike; an
    empty table gives no rows.
    """
    return id_text(docs).select("doc_id", predictor(model)("text").alias("x")).select("doc_id", "x.*")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not rejected."""
    return docs.filter(~predictor(model)(F.coalesce(F.col(text_col), F.lit("")))["rejected"])
