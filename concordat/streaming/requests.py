"""Decision requests as a stream: each is accepted, or not, by the version of the item that it follows.

An item's version is the number of its accepted requests. Per item, requests are taken by expected version, then time,
then id:

- ``accepted``: it names the current version, which goes up by one;
- ``conflict``: the version is past; of several that name one version in a batch, the first is accepted;
- ``repeated``: the id was accepted before (``version`` says as which) or waits;
- ``refused``: a field fails its check, ``problem`` names it;
- one that names a later version waits for those before it, and has no outcome until they come or, after ``patience``,
  it is ``expired``.

So requests that form a chain end in the same state whatever batches they come in. Rows without a track or item are refused under
a null key. State is kept by item: the version, both roles' last decisions, ids accepted, requests that wait. The rows of one
item in one batch are sorted in a task's memory; the source's limits on a batch bound them. Needs the RocksDB state store. A stream
with timers never runs out of batches: one that shall end (``availableNow``) needs ``noDataMicroBatches`` off, and its timers
fire in batches with data.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from concordat.functions.text import strip
from concordat.operators.review import DECISIONS, ROLES, TRACKS, status_of

REQUESTS = "request_id string, track string, item_id string, expected_version long, decision string, role string, actor string, severity string, sent_at timestamp"
FIELDS = ("request_id", "expected_version", "decision", "role", "actor", "severity", "sent")
OUTCOMES = "track string, item_id string, request_id string, outcome string, problem string, version long, decision string, role string, actor string, severity string, sent long, accepted_roles array<string>, rejected boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def problem() -> Column:
    """The first field of a request that fails its check, or null."""
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    of = lambda c, allowed: F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    checks = {"request_id": given("request_id"), "track": of("track", TRACKS), "item_id": given("item_id"), "expected_version": F.coalesce(F.col("expected_version") >= 0, F.lit(False)), "decision": of("decision", DECISIONS), "role": of("role", ROLES), "actor": given("actor")}
    return F.coalesce(*(F.when(~sound, F.lit(c)) for c, sound in checks.items()))


class Desk(StatefulProcessor):
    """One item's requests against its state."""

    def __init__(self, patience: float) -> None:
        self.patience = int(patience * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "version long, controller string, expert string")
        self.taken = handle.getMapState("taken", "request_id string", "version long")
        self.waiting = handle.getMapState("waiting", "request_id string", "expected_version long, decision string, role string, actor string, severity string, sent long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        version, controller, expert = self.item.get() if self.item.exists() else (0, None, None)
        last = {"controller": controller, "expert": expert}
        held = {k[0]: (*v[:6], v[6]) for k, v in self.waiting.iterator()}
        fresh: dict[str, tuple] = {}
        for r in rows:
            asked = tuple(r[f] for f in FIELDS[1:])
            if r["problem"]:
                yield self._outcome(key, r["request_id"], asked, "refused", problem=r["problem"])
            elif self.taken.containsKey((r["request_id"],)):
                yield self._outcome(key, r["request_id"], asked, "repeated", version=self.taken.getValue((r["request_id"],))[0])
            elif r["request_id"] in held or r["request_id"] in fresh:
                yield self._outcome(key, r["request_id"], asked, "repeated")
            else:
                fresh[r["request_id"]] = (*asked, None)
        for name, (*asked, until) in sorted((held | fresh).items(), key=lambda kv: (kv[1][0], kv[1][5] or 0, kv[0])):
            if asked[0] > version:
                if until is None:
                    self.waiting.updateValue((name,), (*asked, now + self.patience))
                    self.handle.registerTimer(now + self.patience)
                continue
            if until is not None:
                self.waiting.removeKey((name,))
            if asked[0] < version:
                yield self._outcome(key, name, asked, "conflict", version=version)
                continue
            version, last[asked[2]] = version + 1, asked[1]
            self.taken.updateValue((name,), (version,))
            accepted = [role for role, said in last.items() if said == "accepted"]
            yield self._outcome(key, name, asked, "accepted", version=version, roles=accepted, rejected="rejected" in last.values())
        self.item.update((version, last["controller"], last["expert"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        for (name,), (*asked, until) in [(tuple(k), tuple(v)) for k, v in self.waiting.iterator()]:
            if until <= at:
                self.waiting.removeKey((name,))
                yield self._outcome(key, name, asked, "expired")

    def close(self) -> None:
        pass

    def _outcome(self, key, name, asked, outcome, problem=None, version=None, roles=None, rejected=None) -> Row:  # noqa: ANN001
        _, decision, role, actor, severity, sent = asked
        return Row(track=key[0], item_id=key[1], request_id=name, outcome=outcome, problem=problem, version=version, decision=decision, role=role, actor=actor, severity=severity, sent=sent, accepted_roles=roles, rejected=rejected)


def decided(requests: DataFrame, patience: float = 3600.0) -> DataFrame:
    """Outcomes of a stream of :data:`REQUESTS`; accepted ones with the item's status and label after them. ``patience`` in seconds."""
    spark: SparkSession = requests.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    rows = requests.withColumns({"actor": strip(F.col("actor")), "sent": F.unix_micros("sent_at")}).withColumn("problem", problem()).select("track", "item_id", *FIELDS, "problem")
    out = rows.groupBy("track", "item_id").transformWithState(statefulProcessor=Desk(patience), outputStructType=OUTCOMES, outputMode="Append", timeMode="ProcessingTime")
    status, label = status_of(F.col("accepted_roles"), F.col("rejected"), F.coalesce(F.col("severity") == "critical", F.lit(False)))
    done = F.col("outcome") == "accepted"
    return out.select("track", "item_id", "request_id", "outcome", "problem", "version", "decision", "role", "actor", "severity", F.timestamp_micros("sent").alias("sent_at"), "accepted_roles", F.when(done, status).alias("status"), F.when(done, label).alias("label"))


def accepted_log(outcomes: DataFrame) -> DataFrame:
    """Accepted requests as rows of a decision log whose ids are the item's versions."""
    return outcomes.where("outcome = 'accepted'").select(F.col("version").alias("id"), "track", "item_id", "decision", "role", "actor", "severity", F.col("sent_at").alias("created_at"))
