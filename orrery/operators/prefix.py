"""Running sums in two levels, so that no group has to fit into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.session import shared_folder


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value over all rows of equal keys up to this one, in order; order has to be unique within keys.

    Rows are dealt by range and written once, because places in the partitioning have to stay the same for both levels.
    """
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "running")
    rows.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    blocks = dealt.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = blocks.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_block") == F.col("_at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = F.sum(value).over(W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn("_inside", inside).join(before, same).select(*rows.columns, (F.col("_inside") + F.col("_before")).alias(name))
