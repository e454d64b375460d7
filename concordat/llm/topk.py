"""Exact top-k inner-product search by norm buckets.

Vectors are grouped by length into buckets, and buckets into blocks of bounded size. The blocks of the longest vectors
are searched first and give every query a score that its k-th best can't fall below. For every other block that score
becomes a local cosine threshold, ``bound / (|query| * longest |vector| of the block)``, which chooses how the block is
pruned for that query: above 1 it is skipped (for all queries of a block that is decided before any vector moves), from ``COORDINATE_FROM`` on its vectors must lie in the range that the
threshold leaves to the query's heaviest coordinate, below that they must be long enough for the bound. Products of all
vectors that remain are computed; pruning never changes the result.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id, which the result
could not name. Only vectors of one dimension are compared.
Ties go to the smaller id; a repeated id is a row of its own, and a query is never matched with its own id. Queries
meet candidates block by block, so neither side is ever held whole, and many equal vectors only make more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from concordat.llm.common import table, written

COORDINATE_FROM = 0.6
PACKED = "dim int, bucket int, ids binary, data binary, norms binary, longest double, n int"
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", factor: float = 64.0) -> DataFrame:
    """Ids with floor(factor * component) of every usable vector."""
    v = F.col(vector).cast("array<double>")
    sound = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = df.where(sound).select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(factor * x)).alias("v"))
    return out.where(F.size("v") > 0).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """One row per block of about ``rows`` vectors of a bucket: (dim, bucket) groups are dealt by a hash of the id."""
    sizes = df.groupBy("dim", "bucket").count()
    dealt = df.join(F.broadcast(sizes), ["dim", "bucket"])  # one row per bucket and dimension
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.greatest(F.ceil(F.col("count") / rows), F.lit(1))))

    def block(group: pa.Table) -> pa.Table:
        norms = group.column("norm").to_numpy()
        order = np.lexsort((group.column("vec_id").to_numpy(), -norms))
        data = np.concatenate([c.flatten().to_numpy() for c in group.column("v").chunks]).reshape(len(order), -1)[order]
        return pa.table({"dim": pa.array([data.shape[1]], pa.int32()), "bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), "ids": [group.column("vec_id").to_numpy()[order].tobytes()], "data": [data.tobytes()], "norms": [norms[order].tobytes()], "longest": [float(norms.max())], "n": pa.array([len(order)], pa.int32())})

    return dealt.groupBy("dim", "bucket", "block").applyInArrow(block, PACKED)


def _best(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while no sum can reach 2^53, else in Python integers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Query blocks (q_*) against candidate blocks: at most k rows for a query and block."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, norms = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["norms"])
                data = np.frombuffer(row["data"], np.int64).reshape(len(ids), -1)
                qids, qnorms = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_norms"])
                bounds = np.full(len(qids), -np.inf) if row["q_bounds"] is None else np.frombuffer(row["q_bounds"])
                queries = np.frombuffer(row["q_data"], np.int64).reshape(len(qids), -1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    local = np.where(bounds > 0, bounds / (qnorms * row["longest"]) * (1 - 1e-12), -1.0)
                found: list[list[np.ndarray]] = [[], [], []]

                def keep(q: int, at: np.ndarray, scores: np.ndarray) -> None:
                    ok = (scores >= bounds[q]) & (ids[at] != qids[q])
                    at, scores = at[ok], scores[ok]
                    if len(at) > k:
                        cut = np.partition(scores, len(at) - k)[len(at) - k]
                        at, scores = at[scores >= cut], scores[scores >= cut]
                    best = np.lexsort((ids[at], -scores))[:k]
                    for column, values in zip(found, (np.full(len(best), qids[q]), ids[at[best]], scores[best]), strict=True):
                        column.append(values)

                unit = data / np.maximum(norms, 1e-300)[:, None]
                for q in np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1)):
                    t, f = local[q], int(np.abs(queries[q]).argmax())
                    x = queries[q][f] / qnorms[q]
                    slack = np.sqrt(max(0.0, (1 - x * x) * (1 - t * t))) + 1e-9
                    at = np.flatnonzero(((unit[:, f] >= x * t - slack) | (x < -t)) & ((unit[:, f] <= x * t + slack) | (x > t)))  # the query's own direction is inside the range beyond -t or t, so that side has no limit
                    if len(at):
                        keep(q, at, _products(queries[q : q + 1], data[at])[0])
                plain = np.flatnonzero(local < COORDINATE_FROM)
                for some in np.array_split(plain, max(1, len(plain) // 256)):
                    if len(some):
                        with np.errstate(divide="ignore", invalid="ignore"):
                            least = np.where(bounds[some] > 0, bounds[some] / qnorms[some] * (1 - 1e-12), -1.0)
                        prefix = np.searchsorted(-norms, -least, side="right")
                        scores = _products(queries[some], data[: prefix.max()])
                        for j, q in enumerate(some):
                            keep(q, np.arange(prefix[j]), scores[j, : prefix[j]])
                out = [np.concatenate(c) if c else np.empty(0, np.int64) for c in found]
                yield pa.record_batch([pa.array(c.astype(np.int64)) for c in out], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(kernel, FOUND)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, block: int = 4096, query_block: int = 1024, buckets: int = 8) -> DataFrame:
    """Each query's k best of ``vectors``; both as from :func:`integer_vectors`. ``buckets`` norm quantiles are the groups."""
    edges = vectors.agg(F.percentile_approx("norm", [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []
    bucket = sum((F.when(F.col("norm") < e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    packed = written(_packed(vectors.withColumn("dim", F.size("v")).withColumn("bucket", bucket), block), "norm-buckets").withColumn("c_block", F.xxhash64("dim", "bucket", "ids"))
    asked = written(_packed(queries.withColumn("dim", F.size("v")).withColumn("bucket", F.lit(0)), query_block), "queries")
    asked = asked.select("dim", F.xxhash64("ids").alias("q_block"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "data", "norms", "n")))
    first = packed.groupBy("dim").agg(F.max_by("c_block", F.struct("longest", "c_block")).alias("c_block")).select("c_block")
    first = written(first, "first-blocks")  # one row a dimension
    seeds = packed.join(F.broadcast(first), "c_block", "left_semi")
    start = written(_best(_search(seeds.join(asked.withColumn("q_bounds", F.lit(None).cast("binary")), "dim"), k), k), "seeds")
    bounds = start.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))

    spread = asked.select("q_block", "q_ids").mapInArrow(_ids, "query_id long, q_block long, nth int")
    known = spread.join(bounds, "query_id", "left").groupBy("q_block").agg(F.sort_array(F.collect_list(F.struct("nth", "bound"))).alias("b"))  # one block of queries a group
    known = written(known.join(asked.select("q_block", "dim", "q_norms"), "q_block").mapInArrow(_bounds, "q_block long, dim int, q_bounds binary, reach double"), "bounds")
    rest = packed.join(F.broadcast(first), "c_block", "left_anti")
    meeting = rest.select("dim", "c_block", "longest").join(known.select("dim", "q_block", "reach"), "dim").where(F.col("longest") >= F.col("reach"))  # of blocks, a row of numbers each; vectors move for what remains
    meeting = written(meeting.select("c_block", "q_block"), "meeting-blocks")
    more = _search(meeting.join(asked.join(known.select("q_block", "q_bounds"), "q_block").drop("dim"), "q_block").join(rest, "c_block"), k)
    return _best(start.drop("rank").unionByName(more), k).select("query_id", "rank", "vec_id", "score")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, packed in zip(batch.column("q_block").to_pylist(), batch.column("q_ids").to_pylist(), strict=True):
            ids = np.frombuffer(packed, np.int64)
            yield pa.record_batch([pa.array(ids), pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids), dtype=np.int32))], names=["query_id", "q_block", "nth"])


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bounds of a block's queries, and the length below which no vector matters to any of them."""
    for batch in batches:
        out = [np.array([-np.inf if x["bound"] is None else x["bound"] for x in b], np.float64) for b in batch.column("b").to_pylist()]
        norms = [np.frombuffer(n) for n in batch.column("q_norms").to_pylist()]
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = [float(np.where(b > 0, b / n, 0.0).min(initial=np.inf)) * (1 - 1e-9) for b, n in zip(out, norms, strict=True)]
        yield pa.record_batch([batch.column("q_block"), batch.column("dim"), pa.array([b.tobytes() for b in out], pa.binary()), pa.array(reach, pa.float64())], names=["q_block", "dim", "q_bounds", "reach"])


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
