"""Approximate nearest neighbours by cosine over balanced posting lists.

The index: centroids are learnt on a bounded sample (``SAMPLE`` vectors, documented parameter) by splitting the largest
cluster in two until there are about as many clusters as the table needs lists; that keeps lists balanced. Every vector
of the table goes to the list of its nearest centroid, and vectors near a boundary to the further lists whose centroid
is at most ``closure`` times as far. Centroids (``MAX_LISTS`` at most, so their size is bounded) are searched through an
in-memory neighbour graph, beam-wise and for many vectors at a time. A query reads all lists whose centroid is at most
``ratio`` times as far as the nearest (the beam widens until it ends beyond that), and more only if those hold fewer than
``least`` vectors, a few times ``k``; candidates are scored by exact cosine in
double precision. Lists and the queries of a list are dealt in blocks, so a list that holds a third of all vectors is
split over tasks.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id, which the
result could not name. Rows that share an id count as one, with the nearest of their vectors. Only vectors of the commonest dimension
of the sample are indexed together (others form a list of their own by dimension). Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from concordat.llm.common import table, written

SAMPLE = 16384
MAX_LISTS = 2048
ASSIGNED = "vec_id long, v array<double>, list int, nth int"
FOUND = "query_id long, vec_id long, score double"


def usable_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = F.col(vector).cast("array<double>")
    sound = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(sound).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of clusters made by halving the largest one again and again along its main direction of spread."""
    rng = np.random.default_rng(seed)
    leaves = [(-len(sample), 0, np.arange(len(sample)))]
    done: list[np.ndarray] = []
    tie = 1
    while leaves and len(leaves) + len(done) < lists:
        _, _, at = heapq.heappop(leaves)
        part = sample[at] - sample[at].mean(axis=0)
        axis = rng.normal(size=part.shape[1])
        for _ in range(8):
            axis = part.T @ (part @ axis)
            axis /= np.linalg.norm(axis) or 1.0
        along = part @ axis
        high = along > np.median(along)
        if len(at) < 4 or not high.any() or high.all():
            done.append(at)  # equal vectors: nothing to split
            continue
        for half in (at[high], at[~high]):
            heapq.heappush(leaves, (-len(half), tie, half))
            tie += 1
    groups = done + [leaf[2] for leaf in leaves]
    centres = np.stack([sample[at].mean(axis=0) for at in groups])
    for _ in range(3):  # settle, keeping the number of lists
        near = (sample @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


class CentroidGraph:
    """Neighbour graph over the centroids and a beam search through it, for a block of vectors at once."""

    def __init__(self, centres: np.ndarray, degree: int = 24, seed: int = 5) -> None:
        self.centres, self.square = centres, (centres * centres).sum(axis=1)
        n = len(centres)
        apart = self.square[:, None] + self.square - 2 * centres @ centres.T
        near = np.argsort(apart, axis=1, kind="stable")[:, : min(degree, n)]  # each is its own first neighbour
        far = np.random.default_rng(seed).integers(0, n, (n, min(8, n)))  # long edges keep the graph in one piece
        self.edges = np.hstack([near, far])
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(int))

    def search(self, x: np.ndarray, beam: int, hops: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found and their distances, nearest first; at most ``beam`` a vector."""
        beam = min(beam, len(self.centres))
        if 8 * beam >= len(self.centres):  # the walk would meet nearly all of them
            distance = (x * x).sum(axis=1)[:, None] + self.square - 2 * x @ self.centres.T
            order = np.argsort(distance, axis=1, kind="stable")[:, :beam]
            return order, np.sqrt(np.maximum(np.take_along_axis(distance, order, axis=1), 0))
        own = (x * x).sum(axis=1)[:, None]
        got = np.full((len(x), len(self.centres)), np.inf)  # distances of the centroids that were reached
        at = np.broadcast_to(self.entry, (len(x), len(self.entry)))
        rows = np.arange(len(x))[:, None]
        best = None
        for _ in range(hops):
            got[rows, at] = own + self.square[at] - 2 * np.einsum("ijk,ik->ij", self.centres[at], x)
            top = np.argpartition(got, beam - 1, axis=1)[:, :beam]
            if best is not None and (np.sort(top, axis=1) == best).all():
                break
            best = np.sort(top, axis=1)
            at = self.edges[top[:, : max(8, beam // 4)]].reshape(len(x), -1)
        distance = np.take_along_axis(got, top, axis=1)
        order = np.argsort(distance, axis=1, kind="stable")
        return np.take_along_axis(top, order, axis=1), np.sqrt(np.maximum(np.take_along_axis(distance, order, axis=1), 0))


def _lists_of(df: DataFrame, centres: np.ndarray | None, dim: int, ratio: float, most: int | None = None, counts: dict[int, int] | None = None, least: int = 0) -> DataFrame:
    """A row for every vector and list it belongs to (``most`` at most) or, with ``counts``, has to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = CentroidGraph(centres) if centres is not None else None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, vectors = (batch.slice(start, 256).column(c) for c in ("vec_id", "v"))
                sizes = pa.compute.list_value_length(vectors).to_numpy()
                rows: list[tuple[int, int, int]] = [(i, -1 - int(n), 0) for i, n in enumerate(sizes) if n != dim]
                same = np.flatnonzero(sizes == dim)
                if len(same):
                    x = _unit(vectors.take(pa.array(same)).flatten().to_numpy().reshape(len(same), -1))
                    beam = most or 32
                    while True:
                        lists, distance = graph.search(x, beam)
                        take = distance <= np.maximum(ratio * distance[:, :1], 1e-9)
                        if counts is not None:
                            held = np.cumsum(np.vectorize(lambda c: counts.get(c, 0))(lists), axis=1)
                            take |= np.hstack([np.zeros((len(x), 1)), held[:, :-1]]) < least
                        if most or beam >= len(centres) or not take[:, -1].any():
                            break
                        beam *= 2
                    take[:, 0] = True
                    rows += [(int(same[i]), int(lists[i, j]), int(j)) for i, j in zip(*np.nonzero(take), strict=True)]
                at = pa.array([r[0] for r in rows])
                yield pa.record_batch([ids.take(at), vectors.take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=["vec_id", "v", "list", "nth"])

    return df.select("vec_id", "v").mapInArrow(run, ASSIGNED)


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, list_size: int = 128, closure: float = 1.08, replicas: int = 3, ratio: float = 1.18, least: int = 32, block: int = 4096) -> DataFrame:
    spark = vectors.sparkSession
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()  # SAMPLE vectors at most
    sizes = [len(r["v"]) for r in sample]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    of_dim = [r["v"] for r in sample if len(r["v"]) == dim]
    centres = balanced_centroids(_unit(np.array(of_dim)), max(1, min(MAX_LISTS, n // list_size, len(of_dim) // 4))) if of_dim else None

    postings = written(_lists_of(vectors, centres, dim, closure, replicas), "postings")
    counts = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}  # one row a list
    asked = written(_lists_of(queries, centres, dim, ratio, counts=counts, least=least), "probes")
    asking = asked.groupBy("list").agg(F.count("*").alias("q"))
    deal = postings.groupBy("list").agg(F.count("*").alias("c")).join(asking, "list")
    deal = F.broadcast(deal.select("list", F.ceil(F.col("c") / block).alias("cb"), F.ceil(F.col("q") / 1024).alias("qb")))  # one row a list
    left = postings.join(deal, "list").withColumn("c", F.pmod(F.xxhash64("vec_id"), "cb")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)))
    right = asked.join(deal, "list").withColumn("q", F.pmod(F.xxhash64("vec_id"), "qb")).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cb") - 1)))

    def score(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if candidates.num_rows and asked.num_rows:
            c, q = (np.concatenate([x.flatten().to_numpy() for x in t.column("v").chunks]).reshape(t.num_rows, -1) for t in (candidates, asked))
            cids, qids = candidates.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
            c, q = _unit(c), _unit(q)
            for start in range(0, len(q), 256):
                scores = q[start : start + 256] @ c.T
                scores[qids[start : start + 256, None] == cids] = -np.inf
                for i, row in enumerate(scores):
                    at = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - 1e-12)
                    at = at[np.isfinite(row[at])]
                    exact = (c[at] * q[start + i]).sum(axis=1)  # the same sum for the same pair, whatever the block
                    best = np.lexsort((cids[at], -exact))[:k]
                    out[0] += [qids[start + i]] * len(best)
                    out[1] += cids[at[best]].tolist()
                    out[2] += exact[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["list", "c", "q"]
    found = left.select("vec_id", "v", *keys).groupBy(*keys).cogroup(right.select("vec_id", "v", *keys).groupBy(*keys)).applyInArrow(score, FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a replicated vector is found in several lists
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable_vectors(table(spark, sf_dir, "embeddings"))
    return search(vectors.where(F.col("vec_id") % 50 == 0), vectors)
