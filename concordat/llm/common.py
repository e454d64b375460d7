"""What the training-data operators share: the shared scratch folder, written stages and byte chunks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a table of ids that is still broadcast, about 16 MB.
SMALL = 300_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset: on one machine, as in tests, one of our own; on a cluster an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/concordat/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing will read any more. Results that are still to be computed keep theirs."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(ids: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for a broadcast if it has few enough; beyond that both sides of its join are shuffled."""
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text only, null texts as empty ones: whatever else the table holds, by whatever name, cannot clash."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def release() -> None:
    """Gives what a task no longer needs back to the system: Python workers live on for later tasks, and memory that they only keep would add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every platform's library has it
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most ``max_bytes`` of the column, or of one row: bounds what numpy expands at once."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            n = n or 0
            if i > start and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start)
    release()


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each group of a partition that is sorted by a whole-number key, as slices of the batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(key).to_numpy()
        if not len(k):
            continue
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield held
            held = []
        start = 0
        for cut in (np.flatnonzero(k[1:] != k[:-1]) + 1).tolist():
            yield [*held, batch.slice(start, cut - start)]
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield held
    release()
