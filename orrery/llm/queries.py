"""The registered opN_ queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import html_extract, language_id, mixing, near_dedup, ordinal_quality, packing, periodic_runs, source_audit, substring_dedup, suffix_dedup, token_files, topk, weak_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file; every operator takes such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of whole texts in 50-byte strings that a smaller id has too; null texts are empty."""
    return suffix_dedup.remove(_table(spark, sf_dir, "documents"), length=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, null ones empty, written as files and read back."""
    files = token_files.write(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=2)
    return token_files.read_checksums(files)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole texts in 35-word windows that occur twice; null texts have no words."""
    return substring_dedup.remove(_table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document, from the graded labels."""
    docs = _table(spark, sf_dir, "documents")
    grade = F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality"))  # toxic, poor, good
    return ordinal_quality.rate(docs, ordinal_quality.fit(docs, _table(spark, sf_dir, "labels"), grade))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document so that sources come to their shares of 150% of all words."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector with all others."""
    vectors = topk.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of whole texts, null ones empty, and their places in sequences of 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=1, most=4096)


def op8_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents: 3-word shingles, similarity of 0.85 and more."""
    return near_dedup.group(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op9_weak_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of whole texts and the verdict of the weighted votes."""
    judged = weak_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))  # no id: not held out
    model = language_id.fit(docs, ~held_out)
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by a field fitted on dressed-up pages from at most 200 of the table's."""
    pages = _table(spark, sf_dir, "pages")
    model = html_extract.fit_pages(html_extract.dressed_pages(html_extract.sample_pages(pages, most=200), number=1200))
    return html_extract.extract(pages, model)


def planted(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Word order of the op12 query: a text whose id's crc32 ends in 0 repeats itself from some word on; null ids (-1) and others stay."""
    out = periodic_runs.ragged(np.zeros(len(sizes), np.int64), sizes)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k, (i, n) in enumerate(zip(ids.tolist(), sizes.tolist(), strict=True)):
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and n and i != -1:
            g = h // 10
            a = g % n
            out[at[k] + a : at[k + 1]] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return out


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of whole texts, a tenth of which are made to repeat themselves."""
    docs = periodic_runs.reordered(_table(spark, sf_dir, "documents"), planted)
    return periodic_runs.digest(periodic_runs.collapse(docs, words=24, times=3))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of sources and leading terms by language; nulls count as empty text."""
    return source_audit.audit(_table(spark, sf_dir, "documents"), least_docs=10, top=10)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_token_files, op3_substring_dedup, op4_ordinal_quality, op5_mix_sources, op6_exact_top_k, op7_best_fit_packing, op8_hyperminhash_dedup, op9_weak_quality_rules, op10_language_id, op11_html_extraction, op12_periodic_runs, op13_source_audit)}
