from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pytest

from concordat.llm import toxicity

DOCS = "doc_id long, text string, score double, toxic int"


def make(n=400, seed=2):
    rng = random.Random(seed)
    syllables = ["the", "an", "er", "on", "re", "in", "st", "ly", "ou", "ha", "ti", "es"]
    bad = ["stupid", "worthless", "clown", "pathetic", "moron"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(40, 200))]
        if toxic:
            for _ in range(rng.randrange(3, 8)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = make()
    docs = spark.createDataFrame([(*r, 0.0, 9) for r in [*rows, (900, None), (901, ""), (902, "x" * 200_000), (903, " " * 5000), (5, rows[5][1])]], DOCS)
    seen = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    marks = spark.createDataFrame([*seen, (900, None), (0, labels[0][1])], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    out = toxicity.scored(docs, model).collect()
    score = {r["doc_id"]: r["score"] for r in out}
    assert len(out) == len(rows) + 5 and all(0 <= s <= 1 for s in score.values())
    test = [(score[i] >= 0.7, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    hit = sum(p and y for p, y in test)
    assert hit >= 0.75 * sum(y for _, y in test) and sum(p and not y for p, y in test) <= 0.05 * len(test)
    assert score[900] < 0.7 and score[901] == score[900]


def test_held_out_matches_crc32(spark):
    ids = [0, 1, 2, 3, 10, 123456]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(toxicity.held_out("doc_id")).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]


def test_one_class_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", 0.0, 1)], DOCS)
    assert toxicity.scored(docs, toxicity.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).first()["score"] == 1.0
    none = spark.createDataFrame([], DOCS)
    assert toxicity.scored(none, toxicity.learn(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_windows_cover_the_text():
    raw = b"ab  cd " * 100 + b"x" * 300
    assert b"".join(toxicity.windows(raw)) == raw and toxicity.windows(b"") == []
    assert np.isfinite(toxicity.features([raw], toxicity.dictionaries([raw, raw], np.array([0, 1])))).all()


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_query_on_given_documents(spark, sf):
    """The contract's columns, one row a document, and held-out accuracy."""
    path = f"/root/testdata/{sf}"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    rows = toxicity.op4_toxicity(spark, path).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id").collect())
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{path}/labels.parquet").where("toxic IS NOT NULL").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    hit = [toxic[r["doc_id"]] for r in held if r["predicted"]]
    assert sum(hit) >= 0.85 * len(hit) and sum(hit) >= 0.35 * sum(toxic[r["doc_id"]] for r in held)
