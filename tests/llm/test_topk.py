from __future__ import annotations

import math
import random

import duckdb
from pyspark.sql import functions as F

from concordat.llm import topk

SCHEMA = "vec_id long, embedding array<float>, bucket int, rank int"


def brute(rows, every, k):
    vs = {i: [math.floor(64.0 * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in vs:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(vs[q], v, strict=True)), i) for i, v in vs.items() if i != q and len(v) == len(vs[q]))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def search(spark, rows, **options):
    vectors = topk.integer_vectors(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA))
    return {tuple(r) for r in topk.top_k(vectors.where(F.col("vec_id") % 5 == 0), vectors, **options).collect()}


def test_matches_brute_force(spark):
    random.seed(1)
    f = lambda x: float(duckdb.sql(f"select {x}::float::double").fetchall()[0][0])
    rows = []
    for i in range(150):
        scale = f(random.choice([0.2, 1, 1, 4]))
        rows.append((i, [round(random.gauss(0, 1) * 8) / 8 * scale for _ in range(4)]))
    rows = [(i, [float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]  # ties
    rows += [(300, None), (305, [None, 1.0, 1.0, 1.0]), (310, [math.nan] * 4), (315, [math.inf] * 4), (320, [0.0] * 4), (325, [1.0] * 3), (326, [2.0] * 3), (330, [])]
    assert search(spark, rows, k=7, block=32, query_block=16, buckets=4) == brute(rows, 5, 7)


def test_empty_and_few(spark):
    assert search(spark, []) == set()
    assert search(spark, [(5, [1.0, 2.0])]) == set()
    assert search(spark, [(5, [1.0, 2.0]), (6, [1.0, 0.0])]) == {(5, 1, 6, 64 * 64)}


def test_one_large_negative_coordinate(spark):
    random.seed(2)
    rows = []
    for i in range(200):
        turn = random.uniform(-1, 1)
        sign = random.choice([-1, -1, -1, 1])
        rows.append((i, [sign * 8 * math.cos(turn), 8 * math.sin(turn), 0.0]))
    rows += [(200 + i, [-8.0, 0.0, 0.0]) for i in range(20)]
    rows = [(i, [round(x * 64) / 64 for x in v]) for i, v in rows]
    for buckets in (1, 4):
        assert search(spark, rows, k=7, block=16, query_block=16, buckets=buckets) == brute(rows, 5, 7)


def test_rows_without_an_id_take_no_part(spark):
    random.seed(4)
    rows = [(i, [random.randint(-8, 8) / 8 for _ in range(3)]) for i in range(60)]
    assert search(spark, [*rows, (None, [9.0, 9.0, 9.0]), (None, None)], k=5, block=16, query_block=16) == brute(rows, 5, 5)
