"""The state of every item as a stream over the decision log.

An item's state follows from its last decision by id of either role and its last one of all. Those are maxima, so decisions
may come late, repeated and in any order of batches: after every batch the state equals ``review.states`` of all that
has come. The state store holds one narrow row an item, and all of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from concordat.operators.review import status_of

ITEM = ["track", "item_id"]


def item_states(decisions: DataFrame) -> DataFrame:
    """The columns of ``review.states``, the severity being that of the item's last decision; for streams and tables alike."""
    last = lambda role: F.max(F.when(F.col("role") == role, F.struct("id", "decision"))).alias(f"_{role}")
    by_item = decisions.groupBy(*ITEM).agg(last("controller"), last("expert"), F.max(F.struct("id", "actor", "created_at", "severity")).alias("_last"))
    said = lambda role, what: F.coalesce(F.col(f"_{role}.decision") == what, F.lit(False))
    accepted = F.array_compact(F.array(*(F.when(said(r, "accepted"), F.lit(r)) for r in ("controller", "expert"))))
    status, label = status_of(accepted, said("controller", "rejected") | said("expert", "rejected"), F.coalesce(F.col("_last.severity") == "critical", F.lit(False)))
    return by_item.select(*ITEM, status.alias("status"), label.alias("label"), F.col("_last.id").alias("version"), accepted.alias("accepted_roles"), F.col("_last.actor").alias("last_actor"), F.col("_last.created_at").alias("last_updated_at"))


def start_states(decisions: DataFrame, target: str, checkpoint: str, available: bool = False) -> StreamingQuery:
    """Writes the items that a batch changes as its Parquet folder; a batch that runs again replaces its own. ``available``: stops after what is there now."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    writer = item_states(decisions).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available else writer).start()


def current_states(spark: SparkSession, target: str) -> DataFrame:
    """What the last batch that changed an item wrote of it."""
    rows = spark.read.parquet(target)
    held = [c for c in rows.columns if c not in (*ITEM, "batch")]
    return rows.groupBy(*ITEM).agg(F.max_by(F.struct(*held), "batch").alias("s")).select(*ITEM, "s.*")
