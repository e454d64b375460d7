from __future__ import annotations

import itertools
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from concordat.operators import review
from concordat.streaming import requests, states

LOG = "id long, track string, item_id string, decision string, role string, actor string, severity string, created_at timestamp"
START = datetime(2024, 1, 1)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("track", "item_id", "status", "label", "version", "accepted_roles", "last_actor").collect()), key=repr)


def test_states_of_any_batches(spark, tmp_path):
    draw = random.Random(5)
    log = [(i, draw.choice(review.TRACKS), f"i{draw.randrange(12)}", draw.choice(review.DECISIONS), draw.choice(review.ROLES), f"a{i % 3}", draw.choice(["critical", "high", None]), START + timedelta(seconds=i)) for i in range(1, 90)]
    rows = spark.createDataFrame(log, LOG)
    assert as_rows(states.item_states(rows)) == as_rows(review.states(rows, F.col("severity")))
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    late = draw.sample(log, len(log))
    come = []
    for part in (late[:20], late[20:50] + late[:7], late[50:]):  # late ones, and some again
        come += part
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
        states.start_states(spark.readStream.schema(LOG).parquet(source), target, str(tmp_path / "cp"), available=True).awaitTermination(120)
        assert as_rows(states.current_states(spark, target)) == as_rows(review.states(spark.createDataFrame(come, LOG).distinct(), F.col("severity")))


@pytest.fixture
def rocksdb(spark):
    settings = {"spark.sql.streaming.stateStore.providerClass": requests.STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Sent:
    """Batches of requests, each run to its end."""

    def __init__(self, spark, folder, patience=3600.0):
        self.spark, self.source, self.target, self.checkpoint, self.patience = spark, f"{folder}/in", f"{folder}/out", f"{folder}/cp", patience

    def __call__(self, batch):
        self.spark.createDataFrame(batch, requests.REQUESTS).coalesce(1).write.mode("append").parquet(self.source)
        out = requests.decided(self.spark.readStream.schema(requests.REQUESTS).parquet(self.source), self.patience)
        query = out.writeStream.format("parquet").option("path", self.target).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return self.outcomes()

    def outcomes(self):
        return self.spark.read.parquet(self.target)


def request(name, expected, decision="accepted", role="expert", item="i", at=0, severity="critical", actor=" A "):
    return (name, "estimate", item, expected, decision, role, actor, severity, START + timedelta(seconds=at))


def pairs(df):
    return sorted((r["request_id"] or "", r["outcome"], r["version"]) for r in df.collect())


def test_versions_approval_and_repeats(rocksdb, tmp_path):
    sent = Sent(rocksdb, tmp_path)
    first = sent([request("b", 0, at=2), request("a", 0, at=1), request("d", 2, "rejected", "controller", at=4), request("bad", 0, role="x"), request("", 0), request("n", None)])
    assert pairs(first) == [("", "refused", None), ("a", "accepted", 1), ("b", "conflict", 1), ("bad", "refused", None), ("n", "refused", None)]
    assert first.where("request_id = 'a'").select("status", "label", "actor").first()[:] == ("second_approval", "Ожидает подтверждения контролёра", "A")
    assert {r["request_id"]: r["problem"] for r in first.where("outcome = 'refused'").collect()} == {"bad": "role", "": "request_id", "n": "expected_version"}
    after = sent([request("c", 1, role="controller", at=3), request("a", 0, at=1), request("d", 2, "rejected", "controller", at=4)])
    new = [p for p in pairs(after) if p[0] in "acd" and p[0]]
    assert new == [("a", "accepted", 1), ("a", "repeated", 1), ("c", "accepted", 2), ("d", "accepted", 3), ("d", "repeated", None)]
    assert {r["version"]: r["status"] for r in after.where("status IS NOT NULL").collect()} == {1: "second_approval", 2: "accepted", 3: "rejected"}


def test_chains_in_any_order(rocksdb, tmp_path):
    chain = [request(f"{item}{v}", v, "accepted" if (v + len(item)) % 3 else "rejected", review.ROLES[v % 2], item, v) for item in ("p", "qq") for v in range(4)]
    want = None
    for k, order in enumerate(itertools.islice(itertools.permutations(chain), 0, 40320, 25000)):
        sent = Sent(rocksdb, tmp_path / str(k))
        for part in (order[:3], order[3:6], order[6:]):
            out = sent(list(part))
        assert out.where("outcome = 'accepted'").count() == len(chain)
        got = as_rows(review.states(requests.accepted_log(out), F.col("severity")))
        want = want or got
        assert got == want and [r[4] for r in got] == [4, 4]
        last = out.groupBy("item_id").agg(F.max_by("status", "version")).collect()
        assert {r[0]: r[1] for r in last} == {r[1]: r[2] for r in got}


def test_what_waits_expires(rocksdb, tmp_path):
    sent = Sent(rocksdb, tmp_path, patience=0.5)
    assert pairs(sent([request("late", 5), request("x", 0, item="j")]))[-1] == ("x", "accepted", 1)
    time.sleep(1)
    assert ("late", "expired", None) in pairs(sent([request("y", 1, item="j")]))
    assert ("again", "accepted", 1) in pairs(sent([request("again", 0)]))


def test_store_is_named(spark, tmp_path):
    stream = spark.readStream.schema(requests.REQUESTS).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="RocksDB"):
        requests.decided(stream)
