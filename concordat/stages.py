"""Stages: intermediate results as Parquet tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a table of narrow rows that is still broadcast, some 16 MB.
SMALL = 300_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset: on one machine, as in tests, a folder of our own; on a cluster an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/concordat/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once: what is built on it is neither computed twice nor lost with an executor."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(rows: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for a broadcast if it has few enough; beyond that its joins are shuffled."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows
