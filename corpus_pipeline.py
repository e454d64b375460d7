"""From raw documents to packed training sequences, in stages that each read what the stage before has written.

Every stage but the last returns the columns of ``documents`` with its decisions applied: toxic documents are gone,
recurring lines are cut out, one document of each near-duplicate group stays, repeated passages are cut out. A document
that loses all its text stays as an empty one; only toxicity and near-duplicate removal drop documents.

Null texts count as empty (they come out of the cutting stages as empty ones), null values in other columns stay. Very long
texts are read whole in every stage. Repeated rows: toxicity scores each, line and repeat removal see them as places of
their own, near-duplicate removal keeps all rows of the doc_id that stays; rows without a doc_id see there. Ties go to
the smaller doc_id. Columns besides the five of ``documents`` are dropped at the first stage. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.llm import lines, neardup, packing, suffix_dedup, toxicity
from concordat.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows that are not held out, drops documents with a score of the threshold or more."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), toxicity.trained(spark, sf_dir))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_recurring(docs.select(*COLUMNS), whole=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, a similarity of 0.8 or more; the smallest doc_id of each group stays.

    Rows without a doc_id are documents of their own: of equal ones one stays, and only if its group has no doc_id at all.
    """
    kept = neardup.near_duplicates(docs, words=5).where("kept").select(F.col("doc_id").alias("kept_id"))
    docs = docs.withColumn("own_id", neardup.numbered())
    copied = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[^\t\n\x0B\f\r ]"), F.lit(False))  # documents without words are linked with nothing
    docs = docs.where(~copied).unionByName(docs.where(copied).dropDuplicates(["own_id"]))
    return docs.join(kept, F.col("own_id") == F.col("kept_id"), "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of more than 50 words, and those of op8's length in bytes that hold fewer words."""
    return suffix_dedup.remove_repeats(docs.select(*COLUMNS), words=51).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-duplicate removal", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
