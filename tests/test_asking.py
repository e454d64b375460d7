from __future__ import annotations

import json
from collections import Counter

import pytest

from concordat.operators import asking
from concordat.operators.registry import RegistryUnavailable


def record(key):
    return json.dumps({"bin": key, "entity_name": f"n{key}", "legal_address": "a", "bik": None, "more": 1}).encode()


def test_rate_by_a_clock_of_its_own():
    now, passed = [0.0], []
    bucket = asking.Bucket(20, 60.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for k in range(130):
        bucket.wait()
        passed.append(now[0])
        now[0] += 0.1 * (k % 3)
    assert all(passed[k + 20] - passed[k] >= 60 - 1e-6 for k in range(len(passed) - 20)) and now[0] < 7 * 60


def test_answers_are_judged():
    judged = lambda status, body: asking.judged("1", status, body)[0]
    assert judged(404, b"") == "missing" and judged(500, b"") == "unavailable" and judged(403, b"") == "unavailable"
    assert judged(200, b"no json") == judged(200, b"[]") == judged(200, b'{"bin":"1"}') == "bad_schema"
    assert judged(200, record("1") + b" " * asking.MOST_BYTES) == "too_large"
    assert asking.judged("1", 200, record("1")) == ("found", {"entity_name": "n1", "legal_address": "a", "bank_name": None, "bik": None, "account_number": None})


def test_failures_that_may_pass_are_asked_again():
    answers = iter([TimeoutError(), (503, b""), (200, record("1"))])

    def client(_):
        got = next(answers)
        if isinstance(got, Exception):
            raise got
        return got

    bucket = asking.Bucket(100, 1.0)
    assert asking.asked("1", client, bucket, 2)[0] == "found" and len(bucket.passed) == 3
    assert asking.asked("1", lambda _: (429, b""), bucket, 2)[0] == "unavailable"


def test_no_key_is_asked_twice_and_the_cache_answers_next_time(spark, tmp_path):
    log = str(tmp_path / "log")

    def client(key):
        with open(log, "a") as f:
            f.write(f"{key}\n")
        body = json.dumps({"bin": key, "entity_name": f"n{key}", "legal_address": "a"}).encode()
        return (404, b"") if int(key) % 5 == 0 else (500, b"") if int(key) == 7 else (200, body)

    def counts():
        with open(log) as f:
            return Counter(f.read().split())

    def rate(*_):
        return None

    keys = spark.createDataFrame([(str(i % 30),) for i in range(300)] + [(None,)], "bin string")
    registry = asking.AskedRegistry(spark, client, str(tmp_path / "cache"), rate=1000, window=0.0, retries=1, sleep=rate)
    rows = registry.lookup(keys).collect()
    assert len(rows) == 301 and {r["bin"]: r["found"] for r in rows} == {None: False} | {str(i): i % 5 != 0 and i != 7 for i in range(30)}
    assert {r["entity_name"] for r in rows if r["bin"] == "8"} == {"n8"}
    assert counts() == Counter({str(i): 2 if i == 7 else 1 for i in range(30)})
    again = asking.AskedRegistry(spark, client, str(tmp_path / "cache"), rate=1000, window=0.0, retries=0, sleep=rate)
    assert again.answers(keys).count() == 30
    assert sum(counts().values()) == 32  # the failed one only


def test_unknown_answers_are_an_error(spark, tmp_path):
    registry = asking.AskedRegistry(spark, lambda key: (200, b"{}"), str(tmp_path / "cache"), rate=100, window=0.0)
    with pytest.raises(RegistryUnavailable, match="неизвестной схемы"):
        registry.lookup(spark.createDataFrame([("1",)], "bin string"))
    with pytest.raises(ValueError):
        asking.AskedRegistry(spark, lambda key: (200, b"{}"), str(tmp_path / "cache"), rate=2, lanes=3)
