"""Session construction with the settings every query of the package assumes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTC makes day buckets and ages independent of the host; AQE splits skewed joins and sizes shuffle reads.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "orrery", **conf: str) -> SparkSession:
    """A session with DEFAULTS, local unless the launcher named a master; conf overrides single settings."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    if "SPARK_MASTER" not in os.environ and "spark.master" not in conf:
        builder = builder.master("local[*]")
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One input table; Catalyst prunes columns and pushes filters into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly, three tasks to a core: small rows that each become much work, of which one file split holds many."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def made_here(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by a generator of one row, so they are worked out once and here: filters on plain columns are carried back to the scan, before rows are dealt."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def shared_folder(spark: SparkSession, name: str) -> str:
    """An unused folder that driver and executors share, below spark.checkpoint.dir; only a local master may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="orrery-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
