"""Asking an outside registry within bounds: few questions a minute, none twice, nothing too long, nothing of unknown form.

Keys are made distinct, those that the cache has are left out, and the rest is dealt to a few lanes, a task each. A lane
may ask its share of the rate and no more, so the rate holds over the cluster without lanes knowing of each other; a lane
that is run again, after a lost executor, first waits a window, as it can't know what its predecessor asked. The client
is the caller's: it turns a key into (status, body) and may raise; time-outs are its own. Answers and "not found" are
appended to the cache, a Parquet folder; failures are not, so they are asked again next time. Within a call a key is
asked once, or again only after a failure that may pass (time-out, 429, 5xx), ``retries`` times at most.
"""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.operators.registry import FIELDS, RegistryUnavailable
from concordat.stages import written

# How often may be asked, how long an answer may be, what it must have, and what is said of one that lacks it.
RATE, WINDOW, MOST_BYTES = 20, 60.0, 256_000
REQUIRED = ("bin", "entity_name", "legal_address")
UNKNOWN_SCHEMA = "Шлюз вернул ответ неизвестной схемы."
ANSWER = "bin string, outcome string, " + ", ".join(f"{f} string" for f in FIELDS)


class Bucket:
    """At most ``rate`` passes in any ``window`` seconds."""

    def __init__(self, rate: int, window: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.window, self.clock, self.sleep = rate, window, clock, sleep
        self.passed: deque[float] = deque()

    def wait(self) -> None:
        while len(self.passed) >= self.rate:
            left = self.passed[0] + self.window - self.clock()
            if left <= 0:
                self.passed.popleft()
            else:
                self.sleep(left)
        self.passed.append(self.clock())


def judged(key: str, status: int, body: bytes) -> tuple[str, dict]:
    """What an answer is: found, missing, too_large, bad_schema, or unavailable; and its fields."""
    if status == 404:
        return "missing", {}
    if status != 200:
        return "unavailable", {}
    if len(body) > MOST_BYTES:
        return "too_large", {}
    try:
        answer = json.loads(body)
    except ValueError:
        return "bad_schema", {}
    if not isinstance(answer, dict) or any(f not in answer for f in REQUIRED):
        return "bad_schema", {}
    return "found", {f: None if answer.get(f) is None else str(answer[f]) for f in FIELDS}


def asked(key: str, client: Callable[[str], tuple[int, bytes]], bucket: Bucket, retries: int) -> tuple[str, dict]:
    for _ in range(retries + 1):
        bucket.wait()
        try:
            status, body = client(key)
        except (OSError, TimeoutError):
            continue
        if status != 429 and status < 500:
            return judged(key, status, body)
    return "unavailable", {}


class AskedRegistry:
    """A registry behind a client; ``cache`` is a folder that outlives the session."""

    name = "Корпоративный шлюз реестров"

    def __init__(self, spark: SparkSession, client: Callable[[str], tuple[int, bytes]], cache: str, rate: int = RATE, window: float = WINDOW, lanes: int = 4, retries: int = 2, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        if not 1 <= lanes <= rate:
            raise ValueError("every lane needs a share of the rate")
        self.spark, self.client, self.cache = spark, client, cache.rstrip("/")
        self.rate, self.window, self.lanes, self.retries, self.clock, self.sleep = rate, window, lanes, retries, clock, sleep
        spark.createDataFrame([], ANSWER).write.mode("append").parquet(self.cache)

    def cached(self) -> DataFrame:
        return self.spark.read.schema(ANSWER).parquet(self.cache)

    def answers(self, keys: DataFrame) -> DataFrame:
        """(bin, outcome, the fields) of every different key of ``keys`` (bin), from the cache or newly asked; null keys are not asked."""
        wanted = written(keys.where("bin IS NOT NULL").select(F.col("bin").cast("string").alias("bin")).distinct(), "asked-keys")
        known = written(self.cached().join(wanted, "bin", "left_semi").dropDuplicates(["bin"]), "known-answers")
        client, share, window, retries, clock, sleep = self.client, self.rate // self.lanes, self.window, self.retries, self.clock, self.sleep

        def lane(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bucket = Bucket(share, window, clock, sleep)
            again = (TaskContext.get() or TaskContext()).attemptNumber() or 0
            for frame in frames:
                if again and len(frame):
                    sleep(window)
                    again = 0
                for key in frame["bin"]:
                    outcome, fields = asked(key, client, bucket, retries)
                    yield pd.DataFrame([{"bin": key, "outcome": outcome} | {f: fields.get(f) for f in FIELDS}])

        rest = wanted.join(known.select("bin"), "bin", "left_anti").repartition(self.lanes, "bin")
        new = written(rest.mapInPandas(lane, ANSWER), "new-answers")  # asked in this job, and nowhere else
        new.where(F.col("outcome").isin("found", "missing")).write.mode("append").parquet(self.cache)
        return known.unionByName(new)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Each key row with the fields, whether it was found, and the source; answers of an unknown form are an error."""
        got = self.answers(keys)
        if not got.where("outcome = 'bad_schema'").isEmpty():
            raise RegistryUnavailable(UNKNOWN_SCHEMA)
        out = keys.join(got.withColumnRenamed("bin", "_bin"), F.col("bin").cast("string") == F.col("_bin"), "left")
        found = F.coalesce(F.col("outcome") == "found", F.lit(False))
        return out.withColumn("found", found).withColumn("source", F.when(found, F.lit(self.name))).drop("_bin")
