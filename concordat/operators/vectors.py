"""All pairs of dense vectors with a cosine of at least t: an exact threshold join over distances to pivots.

Of unit vectors, a cosine of t is a distance of r = sqrt(2 - 2t). Equal vectors are one class first, so copies are
compared once. Classes are laid in a row by their nearest pivot and their distance from it, and cut into blocks of equal
size: of ``BLOCK`` rows, but ``MOST`` blocks at most, so that a row is sent to as many tasks at most however many rows
there are. By the triangle inequality, distances of a pair to any pivot differ by r at most: two blocks meet only if their
ranges of distances allow it, and so do, inside a task, tiles of ``TILE`` rows and then single rows against a tile. What is
left of two tiles (:func:`products` counts it) is one matrix product; pairs near the threshold are computed once more, row
by row. A task holds one block, and a batch of the other.

The pivots are far from each other, from a bounded sample (``SAMPLE``); they decide the cost, never the result. The more
the vectors lie in groups, and the higher t, the less is compared: vectors without any structure are all about as far
from every pivot, and then nothing is pruned. The products grow with the square of the rows in that case, what is shuffled
does not.

Vectors that are null, zero, or hold null or non-finite entries, and rows without an id, pair with nothing. Vectors of
different length don't pair. Repeated ids with different vectors are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concordat.stages import written

SAMPLE, PIVOTS, BLOCK, MOST, TILE, SLACK = 2048, 32, 1024, 32, 512, 1e-7
PLACED = "cell long, id long, unit binary, far array<double>"
RINGS = 64  # to a distance of 1; the finest that rows are laid by


def classes(vectors: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """(id, v, class, copies): usable rows with the smallest id that has the same vector."""
    v = F.col(vector).cast("array<double>")
    sound = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(sound).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))  # one zero, not two
    named = rows.groupBy("v").agg(F.min("id").alias("class"), F.count("*").alias("copies"))
    return rows.select("id", "v").join(named, "v")


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Farthest first, from the vector farthest from the mean."""
    chosen = [int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    nearest = np.full(len(sample), np.inf)
    while len(chosen) < min(k, len(sample)):
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if nearest.max() < 1e-12:
            break
        chosen.append(int(nearest.argmax()))
    return sample[chosen]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _placed(reps: DataFrame, pivots: np.ndarray) -> DataFrame:
    """A row for every class: where it is laid, its unit vector, and its distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)) if batch.num_rows else np.empty((0, pivots.shape[1]))
            far = np.sqrt(np.maximum(2 - 2 * unit @ pivots.T, 0))
            home = far.argmin(axis=1)
            cell = home * (4 * RINGS) + np.floor(far.min(axis=1) * RINGS).astype(np.int64)
            yield pa.record_batch([pa.array(cell), batch.column("id"), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(list(far), pa.list_(pa.float64()))], names=[c.split()[0] for c in PLACED.split(", ")])

    return reps.select("id", "v").mapInArrow(run, PLACED)


def _blocks(placed: DataFrame) -> DataFrame:
    """``placed`` with the block of each row: cells in their order, cut where a block is full."""
    sizes = sorted((r["cell"], r["count"]) for r in placed.groupBy("cell").count().collect())  # a row a pivot and ring
    n = sum(c for _, c in sizes)
    k = min(MOST, -(-n // BLOCK))
    begins = list(accumulate((c for _, c in sizes), initial=0))
    cells = placed.sparkSession.createDataFrame([(cell, c, first) for (cell, c), first in zip(sizes, begins)], "cell long, size long, first long")
    at = F.col("first") + F.pmod(F.xxhash64("id"), F.col("size"))
    return placed.join(F.broadcast(cells), "cell").withColumn("block", F.floor(at * k / n)).drop("size", "first")


def _meeting_blocks(blocked: DataFrame, radius: float) -> list[tuple[int, int, int]]:
    """(g, i, j) of blocks i <= j whose ranges of distances to all pivots are within ``radius``."""
    ends = blocked.select("block", F.posexplode("far").alias("p", "d")).groupBy("block", "p").agg(F.min("d").alias("a"), F.max("d").alias("b")).orderBy("block", "p").collect()  # a row a block and pivot
    names = sorted({r["block"] for r in ends})
    low, high = (np.array([r[c] for r in ends]).reshape(len(names), -1) for c in "ab")
    meet = [(i, j) for i in range(len(names)) for j in range(i, len(names)) if (np.maximum(low[i] - high[j], low[j] - high[i]) <= radius).all()]
    return [(g, names[i], names[j]) for g, (i, j) in enumerate(meet)]


class _Rows:
    """Rows of a block, laid in their order."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by([("cell", "ascending"), ("id", "ascending")])
        self.id = table.column("id").to_numpy()
        self.unit = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(table.num_rows, -1)
        self.far = table.column("far").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)

    def tiles(self) -> Iterator[np.ndarray]:
        for start in range(0, len(self.id), TILE):
            yield np.arange(start, min(start + TILE, len(self.id)))


def _near(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Which rows of ``x`` are within the radius of the ranges of ``y``."""
    return ((x <= y.max(axis=0) + radius) & (x >= y.min(axis=0) - radius)).all(axis=1)


def _met(left: _Rows, right: _Rows, same: bool, least: float, radius: float, count_only: bool) -> pa.RecordBatch:
    """The pairs of a block and (a batch of) another; of a block and itself each pair once, by its ids."""
    n, found = 0, []
    for own in left.tiles():
        for other in right.tiles():
            if same and left.id[own].min() >= right.id[other].max():
                continue
            a = own[_near(left.far[own], right.far[other], radius)]
            b = other[_near(right.far[other], left.far[a], radius)] if len(a) else a
            n += len(a) * len(b)
            if count_only or not len(b):
                continue
            i, j = np.nonzero(left.unit[a] @ right.unit[b].T >= least - 1e-9)
            i, j = a[i], b[j]
            keep = left.id[i] < right.id[j] if same else left.id[i] != right.id[j]
            i, j = i[keep], j[keep]
            exact = (right.unit[j] * left.unit[i]).sum(axis=1)
            ok = np.round(exact, 12) >= least
            found.append((np.minimum(left.id[i], right.id[j])[ok], np.maximum(left.id[i], right.id[j])[ok], exact[ok]))
    if count_only:
        return pa.record_batch([pa.array([n], pa.int64())], names=["n"])
    parts = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return pa.record_batch([pa.array(c) for c in parts], names=["l", "r", "cosine"])


def _meeting(blocked: DataFrame, meet: list[tuple[int, int, int]], least: float, radius: float, count_only: bool) -> DataFrame:
    pairs = blocked.sparkSession.createDataFrame([(g, k, first) for g, i, j in meet for k, first in ((i, True), (j, False))], "g int, block long, first boolean")
    own = {g: i == j for g, i, j in meet}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held, left = None, [], None
        for batch in batches:
            while batch.num_rows:
                key = batch.column("g")[0].as_py(), batch.column("first")[0].as_py()
                n = int(np.argmin(np.append((batch.column("g").to_numpy() == key[0]) & (batch.column("first").to_numpy(zero_copy_only=False) == key[1]), False)))
                part, batch = batch.slice(0, n), batch.slice(n)
                if key[0] != g:
                    g, held, left = key[0], [], None
                if key[1]:
                    held.append(part)
                else:
                    left = left or _Rows(pa.Table.from_batches(held))
                    held = []
                    yield _met(left, _Rows(pa.Table.from_batches([part])), own[g], least, radius, count_only)

    dealt = blocked.join(F.broadcast(pairs), "block").select("g", "first", "cell", "id", "unit", "far")
    dealt = dealt.repartition(max(1, len(meet)), "g").sortWithinPartitions("g", F.desc("first"), "cell")
    return dealt.mapInArrow(run, "n long" if count_only else "l long, r long, cosine double")


def _joined(named: DataFrame, least: float, count_only: bool) -> DataFrame | None:
    """``named``: a written table as from :func:`classes`."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    reps = named.where("id = class").dropDuplicates(["v"]).select("id", "v")
    out = None
    for size in sorted(r[0] for r in reps.select(F.size("v")).distinct().collect()):  # lengths of vectors, one as a rule
        own = reps.where(F.size("v") == size)
        sample = [r["v"] for r in own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
        blocked = _blocks(written(_placed(own, _pivots(_unit(np.array(sample)), PIVOTS)), "pivot-distances"))
        part = _meeting(blocked, _meeting_blocks(blocked, radius), least, radius, count_only)
        out = part if out is None else out.union(part)
    return out


def similar_pairs(named: DataFrame, least: float) -> DataFrame:
    """Pairs (l, r, cosine) of different classes, l < r by the classes' ids; ``named`` is a written table as from :func:`classes`. Members are its rows."""
    if not 0 < least <= 1:
        raise ValueError("a cosine threshold is above 0 and at most 1")
    out = _joined(named, least, False)
    return named.sparkSession.createDataFrame([], "l long, r long, cosine double") if out is None else out


def products(named: DataFrame, least: float) -> int:
    """How many products :func:`similar_pairs` computes."""
    out = _joined(named, least, True)
    return 0 if out is None else int(out.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
