"""Whitening of embeddings along the leading eigenvectors of their covariance, found by slicing the spectrum.

Entries become whole numbers, x = floor(1024 * c) + 100000, so that sums, squares and the covariance are exact whatever the
order in which tasks finish: tasks add up x, then products of x less the rounded mean, and what is left of the mean is
taken out in integers at the end. What travels to the driver is those sums: d numbers, then d * (d + 1) / 2, for
vectors of d entries and any number of rows. There the spectrum is sliced: the pivots of an LDL^T factorisation of V - s * I
(:func:`above`) count the eigenvalues above s, bisection on those counts isolates each of the leading ones, Rayleigh
quotient iteration converges cubically within its interval, and two more counts certify its number. Rows are then
projected where they are. The covariance of the whitened values is added up once more from the rows themselves;
``identity_error`` is its largest distance from the identity.

Null vectors and vectors with null or non-finite entries take no part; neither do empty ones, which have no component,
and entries of 2^40 or more in size, whose x can't be squared and summed in 38 digits. Vectors of each dimension are a
fit list of their own (n, S and V are theirs). Rows with a null or repeated id are rows like any other. Equal eigenvalues
get orthogonal vectors of their common space. Where V has fewer than ``components`` eigenvalues above rounding (few, equal
or dependent rows), the remaining components have ``whitened`` null and ``explained`` 0; ``identity_error`` is over the others
(null without any). ``deviation`` is a decimal of 38 digits here; the query's long is null beyond 2^63. Other columns
don't matter: only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.llm.common import table

SCALE, OFFSET, LIMIT, COMPONENTS = 1024.0, 100_000, 2.0**40, 8
CELLS = 1 << 20  # numbers of a batch that are worked on at once
PARTS = "dim int, i int, j int, n long, total decimal(38,0)"
WHITENED = "vec_id long, dim int, component int, n long, deviation decimal(38,0), whitened double, explained double"
ALPHA = (1 + 17**0.5) / 8  # Bunch and Kaufman's bound on the growth of pivots


# --- the spectrum, of one symmetric matrix ---


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` are above ``shift``: positive pivots of LDL^T with 1 x 1 and 2 x 2 blocks (Sylvester's inertia)."""
    a = v - shift * np.eye(len(v))
    positive = 0
    while len(a):
        below = np.abs(a[1:, 0])
        r = 1 + int(below.argmax()) if len(below) else 0
        most, width = (below[r - 1], 1) if len(below) else (0.0, 1)
        if abs(a[0, 0]) < ALPHA * most:
            row = np.abs(a[r])
            row[r] = 0
            widest = row.max()
            if abs(a[0, 0]) * widest < ALPHA * most * most:
                to = 0 if abs(a[r, r]) >= ALPHA * widest else 1
                order = np.arange(len(a))
                order[[to, r]] = order[[r, to]]
                a, width = a[np.ix_(order, order)], 1 + to
        pivot, rest = a[:width, :width], a[width:, :width]
        if width == 1:
            positive += bool(pivot[0, 0] > 0)
            a = a[1:, 1:] - (rest * (rest.T / pivot[0, 0]) if pivot[0, 0] else 0.0)
        else:
            det = pivot[0, 0] * pivot[1, 1] - pivot[0, 1] ** 2
            positive += 1 if det < 0 else 2 * bool(pivot[0, 0] > 0)
            a = a[2:, 2:] - rest @ np.linalg.solve(pivot, rest.T)
    return positive


def _solved(v: np.ndarray, shift: float, x: np.ndarray, step: float) -> np.ndarray:
    """A unit vector along (v - shift)^-1 x; a shift that is an eigenvalue to the last bit is moved by a step."""
    for k in range(8):
        try:
            y = np.linalg.solve(v - (shift + k * step) * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        size = np.linalg.norm(y)
        if np.isfinite(size) and size > 0:
            return y / size
    return x


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` leading eigenvalues above rounding, falling, and their unit eigenvectors as rows."""
    d = len(v)
    size = min(float(np.trace(v)), float(np.abs(v).sum(axis=1).max(initial=0)))
    tol = 16 * d * np.finfo(float).eps * size
    counts = {size + 2 * tol: 0, 2 * tol: above(v, 2 * tol) if size > 0 else 0}
    values: list[float] = []
    found = np.zeros((0, d))
    rng = np.random.default_rng(11)

    def count(s: float) -> int:
        if s not in counts:
            counts[s] = above(v, s)
        return counts[s]

    def around(i: int) -> tuple[float, float]:
        """Shifts next to the i-th eigenvalue, from the counts made so far."""
        return max(s for s, c in counts.items() if c >= i), min(s for s, c in counts.items() if c < i)

    def free(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - found.T @ (found @ x)
        return x / np.linalg.norm(x)

    for i in range(1, min(k, counts[2 * tol]) + 1):
        while True:
            low, high = around(i)
            narrow = high - low <= 4 * tol
            if not narrow and not (count(high) == i - 1 and count(low) == i):
                count((low + high) / 2)
                continue
            x = free(rng.normal(size=d))
            for _ in range(3):
                x = free(_solved(v, (low + high) / 2, x, tol / 64))
            for _ in range(12):
                e = float(x @ v @ x)
                if not low - 2 * tol <= e <= high + 2 * tol or np.linalg.norm(v @ x - e * x) <= tol / d:
                    break
                x = free(_solved(v, e, x, tol / 64))
            e = float(x @ v @ x)
            if low - 2 * tol <= e <= high + 2 * tol and np.linalg.norm(v @ x - e * x) <= tol and above(v, e - 2 * tol) >= i > above(v, e + 2 * tol):
                break
            if narrow:
                raise ArithmeticError(f"eigenvalue {i} could not be certified")
            count((low + high) / 2)
        values.append(e)
        found = np.vstack([found, x])
    order = np.argsort(-np.array(values), kind="stable")  # members of a cluster may come in either order
    return np.array(values)[order], found[order]


# --- sums over rows ---


@dataclass
class Fit:
    """What the rows of one dimension are whitened by."""

    n: int
    shift: np.ndarray  # the mean as whole numbers
    left: list[int]  # S - n * shift
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    count: int  # components to return, with and without variance


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and x of the usable rows (vec_id, v: list of doubles), by dimension, ``CELLS`` numbers at most or one row."""
    for batch in batches:
        ids, lists = batch.column("vec_id"), batch.column("v")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        for dim in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == dim)
            for some in np.array_split(at, -(-len(at) * dim // CELLS)):
                c = pc.list_flatten(lists.take(pa.array(some))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                sound = (np.abs(c) < LIMIT).all(axis=1)  # neither of nulls (NaN here) nor of non-finite numbers
                if sound.any():
                    yield ids.take(pa.array(some[sound])), np.floor(SCALE * c[sound]).astype(np.int64) + OFFSET


def _add(held: dict, dim: int, n: int, total: np.ndarray) -> None:
    before = held.get(dim)
    held[dim] = (n, total.astype(object)) if before is None else (before[0] + n, before[1] + total)


def _summed(vectors: DataFrame, of: Callable[[np.ndarray], np.ndarray | None]) -> dict[int, tuple[int, dict]]:
    """By dimension the number of rows, and by place the exact sum over all rows of what ``of`` makes of a matrix: the upper triangle if that is square."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for _, x in matrices(batches):
            _add(held, x.shape[1], len(x), of(x))
        for dim, (n, total) in held.items():
            i, j = np.triu_indices(dim) if total.ndim == 2 else (np.arange(dim), np.zeros(dim, int))
            flat = total[i, j] if total.ndim == 2 else total
            columns = [np.full(len(i), dim, np.int32), i.astype(np.int32), j.astype(np.int32), np.full(len(i), n)]
            yield pa.record_batch([*map(pa.array, columns), pa.array([int(t) for t in flat], pa.decimal128(38, 0))], names=["dim", "i", "j", "n", "total"])

    parts = vectors.mapInArrow(kernel, PARTS).groupBy("dim", "i", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out: dict = {}
    for r in parts.collect():  # as many rows as a covariance has numbers
        out.setdefault(r["dim"], (r["n"], {}))[1][r["i"], r["j"]] = int(r["total"])
    return out


def _gram(y: np.ndarray) -> np.ndarray:
    """Exact y^T y: in doubles while no sum reaches 2^53, else in Python's integers."""
    if float(np.abs(y).max(initial=0)) ** 2 * len(y) < 2**53:
        y = y.astype(np.float64)
        return (y.T @ y).astype(np.int64)
    y = y.astype(object)
    return y.T @ y


def fits(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for every dimension of ``vectors`` (vec_id, v)."""
    sums = _summed(vectors, lambda x: x.sum(axis=0) if float(np.abs(x).max()) * len(x) < 2**62 else x.astype(object).sum(axis=0))
    shift = {dim: np.array([(2 * s[i, 0] + n) // (2 * n) for i in range(dim)], np.int64) for dim, (n, s) in sums.items()}
    out = {}
    for dim, (n, products) in (_summed(vectors, lambda x: _gram(x - shift[x.shape[1]])) if sums else {}).items():
        left = [sums[dim][1][i, 0] - n * int(shift[dim][i]) for i in range(dim)]
        v = np.zeros((dim, dim))
        for (i, j), p in products.items():
            v[i, j] = v[j, i] = (n * p - left[i] * left[j]) / (n * n)  # whole numbers up to the division
        values, found = leading(v, min(components, dim))
        out[dim] = Fit(n, shift[dim], left, values, found, float(np.trace(v)), min(components, dim))
    return out


def _projected(x: np.ndarray, fit: Fit) -> np.ndarray:
    centred = (x - fit.shift) - np.array([s / fit.n for s in fit.left])
    return centred @ fit.vectors.T / np.sqrt(fit.values)


def _deviations(x: np.ndarray, fit: Fit) -> pa.Array:
    """The sum of (n * x - S)^2 over a row, exact."""
    y, left = x - fit.shift, np.array(fit.left, object)
    largest = float(np.abs(y).max(initial=0))
    if largest * max(largest, fit.n) * y.shape[1] < 2**62:  # what is left of the mean is n / 2 at most
        squares, along = (y * y).sum(axis=1).astype(object), (y @ left.astype(np.int64)).astype(object)
    else:
        y = y.astype(object)
        squares, along = (y * y).sum(axis=1), y @ left
    rest = sum(s * s for s in fit.left)
    return pa.array([fit.n * fit.n * a - 2 * fit.n * b + rest for a, b in zip(squares, along, strict=True)], pa.decimal128(38, 0))


def identity_errors(vectors: DataFrame, by_dim: dict[int, Fit]) -> dict[int, float]:
    """By dimension the largest entry, in size, of the whitened rows' covariance less the identity. Sums of doubles, a few a task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for _, x in matrices(batches):
            w = _projected(x, by_dim[x.shape[1]])
            w = np.hstack([w, np.ones((len(w), 1))])
            held[x.shape[1]] = held.get(x.shape[1], 0) + w.T @ w
        for dim, total in held.items():
            i, j = (at.ravel().astype(np.int32) for at in np.indices(total.shape))
            yield pa.record_batch([pa.array(np.full(len(i), dim, np.int32)), pa.array(i), pa.array(j), pa.array(total.ravel())], names=["dim", "i", "j", "total"])

    parts = vectors.mapInArrow(kernel, "dim int, i int, j int, total double").groupBy("dim", "i", "j").agg(F.sum("total").alias("total"))
    out = {}
    for dim, rows in _by_dim(parts.collect()).items():  # (components + 1)^2 rows a dimension
        k = len(by_dim[dim].values)
        total = np.zeros((k + 1, k + 1))
        for r in rows:
            total[r["i"], r["j"]] = r["total"]
        mean = total[:k, k] / total[k, k]
        if k:
            out[dim] = float(np.abs(total[:k, :k] / total[k, k] - np.outer(mean, mean) - np.eye(k)).max())
    return out


def _by_dim(rows: list) -> dict[int, list]:
    out: dict = {}
    for r in rows:
        out.setdefault(r["dim"], []).append(r)
    return out


def whiten(vectors: DataFrame, by_dim: dict[int, Fit]) -> DataFrame:
    """A row for every usable vector and component: vec_id, dim, component, n, deviation, whitened, explained."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(batches):
            fit = by_dim[x.shape[1]]
            k, n = len(fit.values), fit.count
            values = np.full((len(x), n), np.nan)
            values[:, :k] = _projected(x, fit)
            explained = np.zeros(n)
            explained[:k] = fit.values / fit.trace
            at = pa.array(np.repeat(np.arange(len(x)), n))
            absent = np.tile(np.arange(n) >= k, len(x))
            yield pa.record_batch([ids.take(at), pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), fit.n)), _deviations(x, fit).take(at), pa.array(values.ravel(), mask=absent), pa.array(np.tile(explained, len(x)))], names=[c.split()[0] for c in WHITENED.split(", ")])

    return vectors.mapInArrow(kernel, WHITENED)


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fits ``df`` and whitens it: :func:`whiten` with ``identity_error``."""
    vectors = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    by_dim = fits(vectors, components)
    errors = identity_errors(vectors, by_dim) if by_dim else {}
    error = F.lit(None).cast("double")
    for dim, e in errors.items():  # one value for the usual single dimension
        error = F.when(F.col("dim") == dim, F.lit(e)).otherwise(error)
    return whiten(vectors, by_dim).withColumn("identity_error", error)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained", "identity_error")
