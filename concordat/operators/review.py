"""Review decisions: an append-only log, its versions, and the state of every item under both profiles."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from concordat.functions.text import strip
from concordat.operators.commits import Folder

# What a decision may say.
TRACKS, ROLES, DECISIONS = ("estimate", "requisite"), ("expert", "controller"), ("accepted", "rejected")
DECISION_SCHEMA = "id long, track string, item_id string, decision string, role string, actor string, comment string, severity string, evidence_json string, model_metadata_json string, created_at timestamp"
AUDIT_SCHEMA = "id long, event_type string, track string, item_id string, actor string, role string, payload_json string, created_at timestamp"
COMMIT_SCHEMA = f"decision struct<{DECISION_SCHEMA.replace(' ', ': ').replace(',:', ',')}>, event struct<{AUDIT_SCHEMA.replace(' ', ': ').replace(',:', ',')}>"
# Fixed value: what a writer is told who saw an older version.
CONFLICT = "Результат уже изменён другим пользователем. Обновите страницу."
LABELS = {"pending": "На проверке", "rejected": "Отклонено экспертом", "accepted": "Подтверждено"}


class DecisionConflict(RuntimeError):
    """Someone decided on the item since the version that the caller saw."""


def latest_per_role(log: DataFrame, item: list[str], role: str = "role", version: str = "id") -> DataFrame:
    """Each item's last row of every role."""
    w = Window.partitionBy(*item, role).orderBy(F.desc(version))
    return log.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def states(log: DataFrame, severity: Column | None = None) -> DataFrame:
    """Classic state of every (track, item_id) in the log; ``severity`` is the item's own, of the log's columns, or none."""
    last = latest_per_role(log, ["track", "item_id"])
    accepted = F.sort_array(F.collect_set(F.when(F.col("decision") == "accepted", F.col("role"))))
    by_item = last.withColumn("_severity", severity if severity is not None else F.lit(None).cast("string")).groupBy("track", "item_id").agg(
        accepted.alias("accepted_roles"), F.bool_or(F.col("decision") == "rejected").alias("_rejected"), F.max("id").alias("version"),
        F.max_by("actor", "id").alias("last_actor"), F.max_by("created_at", "id").alias("last_updated_at"), F.max_by("_severity", "id").alias("_severity"))
    status, label = status_of(F.col("accepted_roles"), F.col("_rejected"), F.coalesce(F.col("_severity") == "critical", F.lit(False)))
    return by_item.select("track", "item_id", status.alias("status"), label.alias("label"), "version", "accepted_roles", "last_actor", "last_updated_at")


def status_of(accepted: Column, rejected: Column, critical: Column) -> tuple[Column, Column]:
    waiting = critical & ~(F.array_contains(accepted, "expert") & F.array_contains(accepted, "controller"))
    status = F.when(rejected, "rejected").when(waiting, "second_approval").when(F.size(accepted) > 0, "accepted").otherwise("pending")
    # The labels of states, here and in LABELS.
    missing = F.when(F.array_contains(accepted, "expert"), "контролёра").otherwise("эксперта")
    label = F.when(status == "second_approval", F.concat(F.lit("Ожидает подтверждения "), missing))
    for name, shown in LABELS.items():
        label = label.when(status == name, shown)
    return status, label


def web_states(log: DataFrame) -> DataFrame:
    """Web state by case_id (id, case_id, action, role, severity): criticality is the latest row's; roles newest first."""
    last = latest_per_role(log, ["case_id"])
    newest = F.array_sort(F.collect_list(F.when(F.col("action") == "accepted", F.struct((-F.col("id")).alias("o"), "role"))))
    by_case = last.groupBy("case_id").agg(newest.alias("_roles"), F.bool_or(F.col("action") == "rejected").alias("_rejected"), F.max("id").alias("version"), F.max_by("severity", "id").alias("_severity"))
    roles = F.transform("_roles", lambda r: r["role"])
    both = F.array_contains(roles, "expert") & F.array_contains(roles, "controller")
    status = F.when(F.col("_rejected"), "rejected").when((F.size(roles) > 0) & F.coalesce(F.col("_severity") == "critical", F.lit(False)) & ~both, "pending_second").when(F.size(roles) > 0, "accepted").otherwise("pending")
    return by_case.select("case_id", status.alias("status"), roles.alias("accepted_roles"), "version")


def with_state(items: DataFrame, log: DataFrame, track: str, item: str) -> DataFrame:
    """Items with their state; without decisions, pending at version 0. One join for all of them."""
    severity = items.select(F.col(item).alias("item_id"), F.col("severity").alias("item_severity")).distinct() if "severity" in items.columns else None
    own = log.where(F.col("track") == track)
    state = states(own.join(severity, "item_id", "left"), F.col("item_severity")) if severity is not None else states(own)
    out = items.join(state.drop("track"), items[item] == state["item_id"], "left").drop(state["item_id"])
    return out.withColumns({"status_label": F.coalesce("label", F.lit(LABELS["pending"])), "review_status": F.coalesce("status", F.lit("pending")) if "status" not in items.columns else F.coalesce(state["status"], F.lit("pending")), "version": F.coalesce("version", F.lit(0).cast("long"))})


def history(log: DataFrame, track: str, item_id: str) -> DataFrame:
    own = log.where((F.col("track") == track) & (F.col("item_id") == item_id))
    return own.select("id", "decision", "role", "actor", "comment", "severity", "created_at").orderBy(F.desc("id"))


def history_counts(log: DataFrame) -> DataFrame:
    """How many decisions every item has seen, and the ids of the first and the last."""
    return log.groupBy("track", "item_id").agg(F.count("*").alias("decisions"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def checked_web_decisions(requests: DataFrame) -> DataFrame:
    """Requests (caseId, caseType, action, role, reviewer, severity, comment), trimmed and cut, with ``problem``: the first field that fails its check, or null."""
    # How long a field may be, and the severities there are.
    most = {"caseId": 64, "reviewer": 80, "severity": 16, "comment": 1000}
    severities = ("critical", "high", "medium", "info")
    rows = requests.withColumns({c: F.substring(strip(F.coalesce(F.col(c).cast("string"), F.lit(""))), 1, n) for c, n in most.items()})
    of = lambda c, allowed: F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    checks = {"caseId": F.col("caseId") != "", "caseType": of("caseType", TRACKS), "action": of("action", DECISIONS), "role": of("role", ROLES), "reviewer": F.col("reviewer") != "", "severity": of("severity", severities)}
    return rows.withColumn("problem", F.coalesce(*(F.when(~sound, F.lit(c)) for c, sound in checks.items())))


def web_decisions(requests: DataFrame) -> DataFrame:
    """Sound requests as rows of the web log; the others are :func:`refused_web_decisions`.

    That log has no version check: a decision is appended whatever came before it.
    """
    names = {"caseId": "case_id", "caseType": "case_type"}
    sent = ("caseId", "caseType", "severity", "action", "reviewer", "role", "comment")
    kept = [c for c in requests.columns if c not in sent]
    return checked_web_decisions(requests).where("problem IS NULL").select(*kept, *(F.col(c).alias(names.get(c, c)) for c in sent))


def refused_web_decisions(requests: DataFrame) -> DataFrame:
    """Requests that fail a check, as they were sent, with the field that fails first."""
    kept = [c for c in requests.columns if c not in ("caseId", "caseType", "severity", "action", "reviewer", "role", "comment")]
    return checked_web_decisions(requests).where("problem IS NOT NULL").select(*kept, "caseId", "problem")


def _encoded(values: Mapping | None) -> str:
    return json.dumps(dict(values or {}), ensure_ascii=False, sort_keys=True)


class DecisionStore:
    """Decisions and audit events as one document a commit, in a folder that all writers share.

    A commit holds a decision and its audit event, so neither is ever there without the other. It is put, or not at all,
    under the item and the version that it follows: of several writers who saw one version exactly one succeeds, and the
    others get a :class:`DecisionConflict`. Ids are claimed one by one, so they are unique over all items and grow with
    every item's versions; a claim that ends in a conflict leaves a gap. Reading is one Spark job over small documents.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = Folder(spark, self.path)
        self._folder.put("commits/.made", b"")

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema(COMMIT_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{self.path}/{folder}")

    def decisions(self) -> DataFrame:
        return self._read("commits").select("decision.*")

    def audit_events(self) -> DataFrame:
        return self._read("commits").select("event.*")

    def _item(self, track: str, item_id: str) -> str:
        return f"commits/{track}/{hashlib.sha256(item_id.encode()).hexdigest()}"

    def _own(self, track: str, item_id: str) -> DataFrame:
        """The item's decisions, from its own documents alone."""
        folder = self._item(track, item_id)
        if not self._folder.exists(folder):
            return self.spark.createDataFrame([], DECISION_SCHEMA)
        return self._read(folder).select("decision.*")

    def version(self, track: str, item_id: str) -> int:
        return self._own(track, item_id).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    def record(self, *, track: str, item_id: str, decision: str, role: str, actor: str, expected_version: int, severity: str | None = None, comment: str = "", evidence: Mapping | None = None, model_metadata: Mapping | None = None) -> int:
        for value, allowed, what in ((track, TRACKS, "track"), (role, ROLES, "role"), (decision, DECISIONS, "decision")):
            if value not in allowed:
                raise ValueError(f"Unknown {what}: {value}")
        if not (actor := actor.strip()):
            raise ValueError("Reviewer name must not be empty")
        if self.version(track, item_id) != expected_version:
            raise DecisionConflict(CONFLICT)
        new, now = self._folder.claim("ids"), datetime.now(timezone.utc).isoformat()
        payload = {"decision": decision, "severity": severity, "comment": comment, "expected_version": expected_version, "decision_id": new}
        row = {"id": new, "track": track, "item_id": item_id, "decision": decision, "role": role, "actor": actor, "comment": comment.strip(), "severity": severity, "evidence_json": _encoded(evidence), "model_metadata_json": _encoded(model_metadata), "created_at": now}
        event = {"id": new, "event_type": "review_decision", "track": track, "item_id": item_id, "actor": actor, "role": role, "payload_json": _encoded(payload), "created_at": now}
        if not self._folder.put(f"{self._item(track, item_id)}/{expected_version}.json", json.dumps({"decision": row, "event": event}, ensure_ascii=False).encode()):
            raise DecisionConflict(CONFLICT)  # someone who saw the same version was first
        return new

    def history(self, track: str, item_id: str) -> DataFrame:
        return history(self._own(track, item_id), track, item_id)

    def state(self, track: str, item_id: str, severity: str | None = None) -> dict:
        row = states(self._own(track, item_id), F.lit(severity)).first()
        return row.asDict() if row else {"track": track, "item_id": item_id, "status": "pending", "label": LABELS["pending"], "version": 0, "accepted_roles": [], "last_actor": None, "last_updated_at": None}


class WebDecisionLog:
    """The web profile's store: decisions of :func:`web_decisions` and an audit event for each, as Parquet folders."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, decisions: DataFrame) -> None:
        """``decisions`` with an ``id`` (growing, the caller's) and ``created_at``. The events go first and name the decisions they announce."""
        payload = F.to_json(F.struct(F.col("id").alias("decisionId"), F.col("case_id").alias("caseId"), F.col("case_type").alias("caseType"), "severity", "action", "role"))
        events = decisions.select("id", F.lit("decision.created").alias("event_type"), F.col("reviewer").alias("actor"), payload.alias("payload"), "created_at")
        events.write.mode("append").parquet(f"{self.path}/audit_events")
        decisions.write.mode("append").parquet(f"{self.path}/decisions")

    def decisions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/decisions")

    def audit_events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/audit_events")
