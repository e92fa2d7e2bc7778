"""Shared helpers: the cluster's shared folder, tables written there, input normalisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local master gets a fresh one; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one operator call in the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, new_path(spark, name), 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}  # by the table's identity, which the reference keeps

    def table(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        """df written once and read again."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # shuffle files of the write go with it, not when the driver collects garbage
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *tables: DataFrame) -> None:
        """Deletes every table but these."""
        held = {id(t) for t in tables}
        self.drop(*[t for t, _ in self.paths.values() if id(t) not in held])


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage, survives lost executors, is computed once."""
    return Scratch(df.sparkSession, name).table(df, compression)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text (null: empty) under fixed names, so that extra or clashing columns of the input never matter."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
