"""A corpus pipeline of five training-data operators, each stage over all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import language_id, mixing, near_dedup, packing, substring_dedup
from orrery.llm._spark import Scratch
from orrery.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on a bounded sample of the labelled documents; rejected documents go."""
    model = language_id.fit(docs, F.lit(True))
    return language_id.keep_identified(docs, model).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8; the document with the least id of each group stays, or one without an id if all are."""
    return near_dedup.keep_first(docs, size=5, percent=80).select(*COLUMNS)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that occur anywhere else go; texts without such windows stay as they are."""
    cut = substring_dedup.remove(docs, window=35, carry=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("carried.text"))
    return cut.select("carried.doc_id", text.alias("text"), "carried.lang", "carried.source", F.char_length(text).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.sample(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end=1, most=4096)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_substrings),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fitted models and token ids are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tmp.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
