"""The decision log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from concordat.operators.review import COMMIT_SCHEMA


def decision_stream(spark: SparkSession, path: str) -> DataFrame:
    """Decisions as they are committed to a store's folder."""
    commits = spark.readStream.schema(COMMIT_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{path.rstrip('/')}/commits")
    return commits.select("decision.*")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of every item and role so far; the state holds one row for each."""
    last = F.max(F.struct("id", "decision", "actor", "severity", "created_at")).alias("last")
    return decisions.groupBy("track", "item_id", "role").agg(last).select("track", "item_id", "role", "last.*")


def start_latest(decisions: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest decisions as a Parquet folder per batch; a batch that runs again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return latest_decisions(decisions).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).start()
