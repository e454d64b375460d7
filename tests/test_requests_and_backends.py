from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from concordat.operators import backends, review
from concordat.schemas import POSITION_COLUMNS
from concordat.sources import requests


def test_requests_and_responses(spark):
    row = lambda n, **more: {c: f"{c}{n}" for c in POSITION_COLUMNS} | more
    lacking = {c: "x" for c in POSITION_COLUMNS[:-1]}
    bodies = {1: json.dumps({"rows": [row(1), row(2, quantity=7.5, extra="e", unit=None)]}), 2: json.dumps({"rows": [row(1)]}), 3: json.dumps({"rows": [row(1), lacking]}), 4: "no json", 5: None, 6: json.dumps({"rows": [row(i) for i in range(501)]}), 7: json.dumps({"rows": [row(1), row(2)], "pad": "x" * requests.MOST_BYTES})}
    rows, refused = requests.read_requests(spark.createDataFrame(list(bodies.items()), "request long, body string"), "estimate")
    got = {(r["request"], r["row_idx"]): r for r in rows.collect()}
    assert set(got) == {(1, 0), (1, 1)} and got[1, 1]["quantity"] == "7.5" and got[1, 1]["unit"] == "" and got[1, 0]["norm_ref"] == "norm_ref1"
    assert {r["request"]: r["problem"] for r in refused.collect()} == {2: "row_count", 3: "missing_fields", 4: "row_count", 5: "row_count", 6: "row_count", 7: "too_long"}
    results = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", "x"), (2, 5, "é", "y")], "request long, id long, title string, note string")
    out = {r["request"]: json.loads(r["response"]) for r in requests.as_responses(results, "request", "id", ["title", "note"]).collect()}
    assert out == {1: {"cases": [{"title": "a", "note": "x"}, {"title": "b", "note": None}]}, 2: {"cases": [{"title": "é", "note": "y"}]}}


def test_vector_backend(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None)], "id long, vector array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (1, 9), (1, 1)], "l long, r long")
    backend = backends.VectorBackend(vectors, "m")
    rows = {r["r"]: r for r in backends.described(backend.scores(pairs), backend).collect()}
    assert {k: round(r["cosine"], 6) for k, r in rows.items()} == {2: 0.707107, 3: 0.0, 4: 0.0, 5: 0.0, 9: 0.0, 1: 1.0}
    assert rows[2]["model_name"] == "m" and rows[2]["backend"] == "vectors"


def test_web_log(spark, tmp_path):
    sent = [(1, " c1 ", "estimate", "accepted", "expert", " me ", "high", "x" * 1200), (2, "c1", "estimate", "rejected", "controller", "you", "critical", None), (3, "", "estimate", "accepted", "expert", "me", "high", ""), (4, "c", "other", "accepted", "expert", "me", "high", ""), (5, "c", "estimate", "accepted", None, "me", "high", ""), (6, "c", "estimate", "accepted", "expert", " ", "high", ""), (7, "c", "estimate", "accepted", "expert", "me", "none", "")]
    asked = spark.createDataFrame(sent, "id long, caseId string, caseType string, action string, role string, reviewer string, severity string, comment string")
    rows = review.web_decisions(asked).withColumn("created_at", F.lit(datetime(2024, 1, 1)))
    log = review.WebDecisionLog(spark, str(tmp_path / "log"))
    log.append(rows)
    kept = {r["id"]: r for r in log.decisions().collect()}
    assert set(kept) == {1, 2} and kept[1]["case_id"] == "c1" and kept[1]["reviewer"] == "me" and len(kept[1]["comment"]) == 1000 and kept[2]["comment"] == ""
    assert {json.loads(r["payload"])["caseId"] for r in log.audit_events().collect()} == {"c1"}
    assert review.web_states(log.decisions()).first()["status"] == "rejected"
    counted = review.history_counts(spark.createDataFrame([("estimate", "a", 1), ("estimate", "a", 4), ("requisite", "a", 2)], "track string, item_id string, id long"))
    assert {(r["track"], r["decisions"], r["first_id"], r["last_id"]) for r in counted.collect()} == {("estimate", 2, 1, 4), ("requisite", 1, 2, 2)}
