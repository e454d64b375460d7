from __future__ import annotations

import math

import numpy as np
import pytest

from concordat.operators import backends, vectors
from concordat.stages import written


def run(spark, rows, least):
    named = written(vectors.classes(spark.createDataFrame(rows, "id long, vector array<double>")), "t")
    pairs = {(r["l"], r["r"]): r["cosine"] for r in vectors.similar_pairs(named, least).collect()}
    return pairs, {(r["id"], r["class"], r["copies"]) for r in named.collect()}, vectors.products(named, least)


def brute(rows, least):
    first: dict = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            key = tuple(x + 0.0 for x in v)
            first[key] = min(first.get(key, i), i)
    out = {}
    for a, i in first.items():
        for b, j in first.items():
            if i < j and len(a) == len(b):
                x, y = (np.array(v) / np.abs(v).max() for v in (a, b))
                c = float(x @ y / np.sqrt((x @ x) * (y @ y)))
                if round(c, 12) >= least:
                    out[i, j] = c
    return out


@pytest.mark.parametrize("least", [0.3, 0.75, 0.95, 1.0])
def test_equals_all_pairs_and_compares_few_of_grouped_vectors(spark, monkeypatch, least):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.3).round(3).tolist()) for i in range(240)]
    rows += [(300 + i, rows[0][1]) for i in range(60)] + [(400, [2 * x for x in rows[5][1]]), (401, [-x for x in rows[5][1]])]
    rows += [(500, None), (501, [0.0] * 8), (502, [math.nan] * 8), (503, [None] * 8), (None, rows[1][1]), (504, []), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, [1e300] * 8), (508, [1e-300] * 8), (509, [0.0, 1.0] * 4), (510, [-0.0, 1.0] * 4)]
    got, members, n = run(spark, rows, least)
    expected = brute(rows, least)
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    assert {(i, 0, 61) for i in (0, 300, 359)} <= members and (510, 509, 2) in members
    if least >= 0.95:
        assert n < 0.2 * 245 * 244 / 2


def test_empty_and_bad_thresholds(spark):
    assert run(spark, [], 0.5) == ({}, set(), 0)
    assert run(spark, [(1, [1.0])], 0.5)[0] == {}
    with pytest.raises(ValueError):
        run(spark, [], 0.0)


def test_modes(spark):
    texts = spark.createDataFrame([(1, "a b")], "id long, norm string")
    encoded = spark.createDataFrame([(1, [1.0])], "id long, vector array<double>")
    assert isinstance(backends.chosen("AUTO", texts, encoded, "m"), backends.VectorBackend)
    assert isinstance(backends.chosen("auto", texts, None, "m"), backends.TfidfBackend)
    assert isinstance(backends.chosen("tfidf", texts, encoded, "m"), backends.TfidfBackend)
    with pytest.raises(RuntimeError, match="m"):
        backends.chosen("sentence-transformers", texts, None, "m")
    with pytest.raises(ValueError, match="use auto"):
        backends.chosen("other", texts, encoded, "m")
