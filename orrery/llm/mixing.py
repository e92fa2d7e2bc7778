"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / source_size copies. The prefix sum of expected copies, shifted
by one random offset of the source, crosses integers; a document is emitted once per integer crossed in its
step. Documents are taken in order of size, so that the words taken stay within about one long document of the
target at any number of documents.

Only built-in functions are used. The prefix sum has two levels, blocks of a range partitioning and places inside
a block, so that no source has to fit into one task; only a table of one row per source is ranked in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm._spark import Scratch, partitions

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of sources, from (source, source_size), one row each.

    Sources by code point, null last, weigh weights, repeating. They share `share` times all sizes; a target stops
    at cap times its source's size and the excess goes to the others by weight, until none is above. Filling in
    order of cap / weight gives that result in one pass: a source is at its cap exactly if its cap is not above
    its part of what the sources before it left.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    weighted = sizes.withColumn("weight", F.element_at(pick, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    limit = F.col("source_size") * F.lit(float(cap))
    fill = W.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    ranked = weighted.select(
        "source",
        "source_size",
        "weight",
        limit.alias("limit"),
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(limit).over(earlier), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))).alias("weight_left"),
        F.row_number().over(fill).alias("place"),
    )
    full = F.col("limit") <= F.col("left") * F.col("weight") / F.col("weight_left")
    # the first source that is not at its cap fixes the level of all later ones
    level = F.min_by(F.when(~full, F.col("left") / F.col("weight_left")), F.when(~full, F.col("place"))).over(everything)
    return ranked.select("source", "source_size", F.when(level.isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * level)).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tag: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken (= copies * size).

    Null text has size 0 and takes no words; a source without words has target 0; a null source is a source of
    its own. Repeated rows are documents of their own. Equal sizes are ordered by doc_id. An empty table gives no
    rows. The same rows and seed give the same result, however they are partitioned. tag: a long of each row to return as well.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "mix")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), (F.lit(0) if tag is None else tag).cast("long").alias("tag"))
    n = partitions(spark)
    ranged = tmp.table(sized.repartitionByRange(n, F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")).withColumn("block", F.spark_partition_id()))
    blocks = ranged.groupBy("source", "block").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    targets = source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("source", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    at = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.block", "earlier", "source_size", "target")
    place = F.row_number().over(W.partitionBy("d.source", "d.block").orderBy("size", "doc_id"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # 0 <= offset < 1, one per source, from the seed
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).cast("binary")), 1, 10)
    offset = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 40))
    placed = (
        ranged.alias("d")
        .join(at.alias("a"), F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col("d.block") == F.col("a.block")))
        .select("doc_id", "tag", F.col("d.source").alias("source"), "size", "source_size", "target", F.col("d.block").alias("block"), (F.col("earlier") + place).alias("rank"), rate.alias("rate"))
    )
    crossed = F.floor(offset + F.col("rate") * F.col("rank")) - F.floor(offset + F.col("rate") * (F.col("rank") - 1))
    copies = F.least(crossed, F.ceil(F.col("rate"))).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *([] if tag is None else ["tag"]))


def sample(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: every row of docs, all columns, as often as mix() says.

    Rows are named by id and a hash of all their columns, so rows without an id are spread too. The copies of rows
    that share both, which are equal, are dealt evenly over them.
    """
    tag = F.xxhash64(*docs.columns)
    number = mix(docs, id_col=id_col, tag=tag, **options).groupBy("doc_id", "tag").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    row = F.struct(*[F.col(c) for c in docs.columns])
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), tag.alias("tag"), row.alias("row"))
    joined = held.alias("d").join(number.alias("n"), (F.col("d.tag") == F.col("n.tag")) & F.col("d.doc_id").eqNullSafe(F.col("n.doc_id"))).select("d.doc_id", "d.tag", "row", "copies", "rows")
    nth = F.row_number().over(W.partitionBy("doc_id", "tag").orderBy("doc_id"))
    own = F.floor(F.col("copies") / F.col("rows")) + F.when(nth <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    dealt = joined.withColumn("own", F.when(F.col("rows") == 1, F.col("copies")).otherwise(own).cast("int")).filter("own > 0")
    return dealt.select("row", F.explode(F.sequence(F.lit(1), F.col("own")))).select("row.*")
