from __future__ import annotations

import hashlib
import random

from concordat.llm import suffix_dedup

SCHEMA = "doc_id long, text string, body string, spans int"


def brute(rows, least):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, raw in texts:
        for j in range(len(raw) - least + 1):
            seen[raw[j : j + least]] = seen.get(raw[j : j + least], 0) + 1
    out = []
    for i, raw in texts:
        gone = bytearray(len(raw))
        for j in range(len(raw) - least + 1):
            if seen[raw[j : j + least]] > 1:
                gone[j : j + least] = b"\1" * least
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        n_spans = sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1]))
        out.append((i, len(raw), sum(gone), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return sorted(out)


def make(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(12), text(25), text(9)]
    rows = [(i, " ".join(rng.choice([text(8), *passages]) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [(200, None), (201, ""), (202, "a" * 300), (203, "ab" * 150), (204, "x"), (205, "x"), (100, rows[3][1]), (100, rows[4][1])]
    rows += [(300 + i, passages[1][:70] + text(3)) for i in range(30)]
    return rows


def run(spark, rows, least, gram):
    docs = spark.createDataFrame([(*r, "b", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in suffix_dedup.digests(docs, least, gram).collect())


def test_equals_brute_force(spark):
    rows = make(1)
    assert run(spark, rows, 40, 16) == brute(rows, 40)


def test_hot_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "STEP", 8)
    rows = make(2)
    assert run(spark, rows, 40, 12) == brute(rows, 40)


def test_periodic_texts(spark):
    rows = [(1, "a" * 3000), (2, "ab" * 900), (3, "abcdefghi" * 150 + "x"), (4, "x" + "a" * 45 + "y"), (5, "ab" * 30 + "z" * 200 + "ab" * 30), (6, "é" * 300)]
    assert run(spark, rows, 40, 16) == brute(rows, 40)
    assert all(len(suffix_dedup.contexts([t.encode()], 40, 16)[0]) < 200 for _, t in rows)
    texts = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(spark.createDataFrame([(1, "so la " * 100 + "end", "b", 1), (2, "la la " * 4 + "so", "b", 1)], SCHEMA), 4000, 192, words=9).collect()}
    assert texts[1].split() == ["end"] and texts[2].split() == "la la la la la la la la so".split()


def test_contract_lengths(spark):
    base = "".join(random.Random(5).choice("abcdefgh ") for _ in range(1200))
    rows = [(1, base), (2, "y" + base[100:499] + "z"), (3, "y" + base[300:700] + "z"), (4, base[800:] + "é")]
    assert run(spark, rows, 400, 192) == brute(rows, 400)


def test_empty(spark):
    assert run(spark, [], 400, 192) == []


def test_words_equal_brute_force(spark):
    rows = [r for r in make(3) if r[0] < 200 or r[0] >= 300]
    places = {}
    for row, (_, t) in enumerate(rows):
        words = t.split()
        for j in range(len(words) - 8):
            places.setdefault(tuple(words[j : j + 9]), []).append((row, j))
    gone = {(row, j + d) for p in places.values() if len(p) > 1 for row, j in p for d in range(9)}
    expected = sorted((i, " ".join(w for j, w in enumerate(t.split()) if (row, j) not in gone)) for row, (i, t) in enumerate(rows))
    docs = spark.createDataFrame([(*r, "b", 1) for r in rows], SCHEMA)
    out = suffix_dedup.remove_repeats(docs, 4000, 192, words=9).collect()
    assert sorted((r["doc_id"], " ".join(r["text"].split())) for r in out) == expected and any(t for _, t in expected) and gone


def test_rows_without_doc_id(spark):
    rows = [(None if i % 3 == 0 else i, t) for i, t in make(4)]
    out = run_unsorted(spark, rows)
    assert out == sorted(brute_unsorted(rows), key=str)


def run_unsorted(spark, rows):
    docs = spark.createDataFrame([(*r, "b", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in suffix_dedup.digests(docs, 40, 16).collect()), key=str)


def brute_unsorted(rows):
    numbers = [(n, t) for n, (_, t) in enumerate(rows)]
    return [(rows[n][0], *rest) for n, *rest in brute(numbers, 40)]
