from __future__ import annotations

import math
import random

import numpy as np
import pytest

from concordat.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, dim int, component int, n int"


def run(spark, rows, **options):
    return whitening.whitened(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA), **options).collect()


def usable(rows, dim):
    return [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) and abs(c) < 2**40 for c in v)]


def check(got, rows, dim, k=8):
    xs = usable(rows, dim)
    n, total = len(xs), [sum(x[j] for _, x in xs) for j in range(dim)]
    m = np.array([x for _, x in xs], float) - np.array([t / n for t in total])
    e, q = np.linalg.eigh(m.T @ m / n)
    e, q = e[::-1][:k], q.T[::-1][:k]
    got = [r for r in got if r["dim"] == dim]
    assert sorted((repr(r["vec_id"]), r["component"]) for r in got) == sorted((repr(i), c) for i, _ in xs for c in range(1, min(k, dim) + 1))
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    mine = np.array([[by_row[i, sum((n * a - t) ** 2 for a, t in zip(x, total, strict=True))][c]["whitened"] for c in range(1, min(k, dim) + 1)] for i, x in xs])
    theirs = m @ q.T / np.sqrt(e)
    for c in range(min(k, dim)):
        assert min(np.abs(mine[:, c] - theirs[:, c]).max(), np.abs(mine[:, c] + theirs[:, c]).max()) < 1e-8
    assert all(abs(r["explained"] - e[r["component"] - 1] / (m * m).sum() * n) < 1e-12 for r in got)
    assert {r["n"] for r in got} == {n}
    (error,) = {r["identity_error"] for r in got}
    assert error < 1e-9
    return mine


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(12, 12))
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(400, 12)) @ mix).astype(np.float32).tolist())]
    rows += [(900, None), (901, [None] + [1.0] * 11), (902, [math.nan] * 12), (903, [math.inf] * 12), (904, []), (905, [1e30] + [0.0] * 11), (None, [0.25] * 12), (None, [0.5] * 12)]
    rows += [(i, v) for i, v in enumerate(rng.normal(size=(60, 3)).astype(np.float32).tolist())]
    got = run(spark, rows)
    check(got, rows, 12)
    check(got, rows, 3)
    assert {r["dim"] for r in got} == {3, 12}


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(50, 4)) * 1e9).astype(np.float32).tolist())]
    check(run(spark, rows), rows, 4)


def test_few_equal_and_dependent_rows(spark):
    assert run(spark, []) == []
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in run(spark, [(1, [1.0, 2.0])])] == [(1, None, 0.0, None, 0), (2, None, 0.0, None, 0)]
    assert {(r["whitened"], r["explained"]) for r in run(spark, [(1, [1.0, 2.0])] * 5)} == {(None, 0.0)}
    line = run(spark, [(i, [float(i), 2.0 * i, -1.0 * i]) for i in range(20)])
    assert {r["component"] for r in line if r["whitened"] is None} == {2, 3}
    assert abs(next(r["explained"] for r in line if r["component"] == 1) - 1) < 1e-12 and line[0]["identity_error"] < 1e-9


def test_equal_eigenvalues_get_orthogonal_vectors(spark):
    rows = [(2 * i + s, [float(sign) if j == i else 0.0 for j in range(6)]) for i in range(6) for s, sign in enumerate((-1, 1))]
    got = run(spark, rows)
    assert max(r["identity_error"] for r in got) < 1e-9 and {r["component"] for r in got} == set(range(1, 7))
    assert all(abs(r["explained"] - 1 / 6) < 1e-12 for r in got)


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_counts_and_pairs_of_matrices(d):
    rng = np.random.default_rng(d)
    random.seed(d)
    for kind in range(6):
        b = rng.normal(size=(d, d))
        v = b @ b.T
        if kind == 1:
            v = np.diag(rng.integers(0, 3, d).astype(float))
        if kind == 2:
            v = b[:, : d // 2] @ b[:, : d // 2].T  # half of the rank
        if kind == 3:
            v = np.eye(d) + 1e-9 * (b + b.T)  # a cluster
        if kind == 4:
            v = 1e12 * v
        if kind == 5:
            q = np.linalg.qr(b)[0]
            v = q @ np.diag(np.where(np.arange(d) < 3, 5.0, 1.0)) @ q.T  # the same three times, to rounding
            v = (v + v.T) / 2
        e = np.linalg.eigvalsh(v)[::-1]
        for s in [*rng.uniform(-1, e[0] + 1, 5), 0.37]:
            if np.abs(e - s).min() > 1e-9 * max(1, e[0]):
                assert whitening.above(v, s) == (e > s).sum()
        values, vectors = whitening.leading(v, 8)
        real = e[:8][e[:8] > 1e-10 * max(e[0], 1e-30)]
        assert len(values) == len(real) and np.allclose(values, real, rtol=1e-12, atol=1e-12 * max(e[0], 1e-30))
        assert np.abs(v @ vectors.T - vectors.T * values).max(initial=0) < 1e-12 * max(e[0], 1e-30)
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max(initial=0) < 1e-12
