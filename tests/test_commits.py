from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from concordat.operators import review
from concordat.operators.commits import Folder


def test_a_name_is_given_once_and_numbers_are_claimed_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "f"))
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda k: folder.put("a/b", str(k).encode()), range(8))) == 1
        assert sorted(pool.map(lambda _: folder.claim("ids"), range(12))) == list(range(1, 13))
    assert (tmp_path / "f/a/b").read_bytes() in {str(k).encode() for k in range(8)} and not list((tmp_path / "f/aside").iterdir())
    assert folder.claim("ids") == 13


def test_rename_without_overwriting(spark, tmp_path, monkeypatch):
    folder = Folder(spark, f"file://{tmp_path}/f")
    monkeypatch.setattr(folder, "_local", False)
    assert folder.put("x", b"1") and not folder.put("x", b"2") and (tmp_path / "f/x").read_bytes() == b"1"


def test_of_writers_who_saw_one_version_one_succeeds(spark, tmp_path):
    path = str(tmp_path / "store")
    stores = [review.DecisionStore(spark, path) for _ in range(4)]

    def put(k, version=0, item="ДОК ↔ B/../x"):
        try:
            return stores[k].record(track="estimate", item_id=item, decision="accepted", role="expert", actor=f"a{k}", expected_version=version)
        except review.DecisionConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        first = [x for x in pool.map(put, range(4)) if x]
        assert len(first) == 1
        second = [x for x in pool.map(lambda k: put(k, first[0]), range(4)) if x]
    assert len(second) == 1 and second[0] > first[0]
    assert put(0) is None and put(0, 999) is None  # an old version, and one that never was
    assert put(1, 0, "another item") > 0
    log = stores[0].decisions()
    assert {(r["item_id"], r["id"]) for r in log.collect()} == {(r["item_id"], r["id"]) for r in stores[0].audit_events().collect()} and log.count() == 3
    assert stores[2].version("estimate", "ДОК ↔ B/../x") == second[0]
    states = {(r["item_id"], r["status"]) for r in review.states(log).collect()}
    assert states == {("ДОК ↔ B/../x", "accepted"), ("another item", "accepted")}


def test_a_failed_commit_leaves_neither_decision_nor_event(spark, tmp_path, monkeypatch):
    store = review.DecisionStore(spark, str(tmp_path / "store"))
    monkeypatch.setattr(store._folder, "_linked", lambda *_: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        store.record(track="estimate", item_id="i", decision="accepted", role="expert", actor="a", expected_version=0)
    assert store.decisions().count() == store.audit_events().count() == 0
