from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.llm import ann

SCHEMA = "vec_id long, embedding array<double>, list int, q string"


def brute(rows, every, k):
    vs = {i: np.array(v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in vs:
        if q % every == 0:
            cos = sorted((-float(vs[q] @ v / np.sqrt((vs[q] @ vs[q]) * (v @ v))), i) for i, v in vs.items() if i != q and len(v) == len(vs[q]))
            out[q] = [(i, -c) for c, i in cos[:k]]
    return out


def search(spark, rows, **options):
    vectors = ann.usable_vectors(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
    found = {}
    for r in sorted(ann.search(vectors.where(F.col("vec_id") % 5 == 0), vectors, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(found.setdefault(r["query_id"], [])) + 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    return found


def test_a_wide_ratio_reads_all_lists(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-4, 5, 6).astype(float).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]
    rows += [(300, None), (305, [0.0] * 6), (310, [math.nan] * 6), (315, [None] * 6), (320, [1.0] * 3), (321, [1.0, 1.0, 0.0]), (325, [])]
    found, expected = search(spark, rows, list_size=16, ratio=100.0, block=16), brute(rows, 5, 5)
    assert set(found) == {q for q, best in expected.items() if best}
    for q, best in found.items():
        assert [round(s, 9) for _, s in best] == [round(s, 9) for _, s in expected[q]]


def test_recall(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 32)))]
    found, expected = search(spark, rows, list_size=32, ratio=1.25), brute(rows, 5, 5)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 5 * len(expected)


def test_empty_and_alone(spark):
    assert search(spark, []) == {}
    assert search(spark, [(5, [1.0, 2.0])]) == {}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    """With production parameters, against all products."""
    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(path).collect()]
    expected = brute(rows, 50, 5)
    found = {}
    for r in ann.op3_ann(spark, f"/root/testdata/{sf}").collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert set(found) == set(expected) and all(len(best) == 5 for best in found.values())
    right = {q: dict(best) for q, best in expected.items()}
    assert sum(i in right[q] for q, best in found.items() for i in best) >= 0.9 * 5 * len(expected)
    assert all(abs(s - right[q][i]) < 1e-9 for q, best in found.items() for i, s in best.items() if i in right[q])


def test_rows_without_an_id_take_no_part_and_equal_ids_are_one(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-4, 5, 6).astype(float).tolist()) for i in range(60)]
    rows = [r for r in rows if any(r[1])]
    expected = brute(rows, 5, 5)
    found = search(spark, [*rows, (None, [1.0] * 6), (None, rows[5][1]), rows[7], rows[10]], list_size=16, ratio=100.0, block=16)
    assert found.keys() == expected.keys()
    assert all([i for i, _ in found[q]] == [i for i, _ in best] for q, best in expected.items())
