from __future__ import annotations

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from concordat.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, the world!", None, "", "x <|endoftext|> y", "ΟΔΟΣ İstanbul é", "don't 12 3\tstop\x1c\x85now", "word " * 5000, "word " * 5000, "naïve ÆØ — “q” …", "ﬁ ² ½ ­ a"]
SCHEMA = "doc_id long, text string, bucket int, rank string"


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc, parts in by_doc.items():
        ids = ids_of(texts[doc])
        assert [p["piece"] for p in sorted(parts, key=lambda p: p["piece"])] == list(range(-(-len(ids) // capacity)))
        for p in parts:
            own = np.asarray(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert p["start"] == p["piece"] * capacity and p["length"] == min(capacity, len(ids) - p["start"]) == len(own)
            assert p["ids_crc32"] == zlib.crc32(own.tobytes())
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return len(by_sequence)


def test_pieces_and_places(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], SCHEMA)
    rows = packing.pack_documents(docs, capacity=64).collect()
    total = sum(r["length"] for r in rows)
    assert check(rows, TEXTS, 64) <= -(-total // 64) + 2


def test_empty_table(spark):
    out = packing.pack_documents(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, size)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - size)
    return len(gaps)


@pytest.mark.parametrize("kind", ["any", "short", "large"])
@pytest.mark.parametrize("rows", [40, 1 << 15])
def test_supersteps_place_all_in_few_sequences(spark, monkeypatch, kind, rows):
    monkeypatch.setattr(packing, "RANGE", rows)
    rng = random.Random(kind)
    sizes = {"any": [rng.randrange(1, 65) for _ in range(300)], "short": [rng.randrange(1, 12) for _ in range(400)], "large": [rng.randrange(33, 65) for _ in range(80)]}[kind]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    rows = packing.placed(items, 64).collect()
    assert sorted(r["item"] for r in rows) == list(range(len(sizes)))
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["at"], sizes[r["item"]]))
    for spans in by_sequence.values():
        at = 0
        for start, size in sorted(spans):
            assert start == at
            at += size
        assert at <= 64
    assert len(by_sequence) <= 1.03 * best_fit_decreasing(sizes, 64) + 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.booleans()), max_size=40), st.lists(st.integers(0, 40), max_size=4))
def test_sweep_over_ranges_equals_one_sweep(items, cuts):
    """Every piece meets the gap that one sweep over all ranges gives it, whatever the ranges."""
    order = sorted((-size, int(piece), i) for i, (size, piece) in enumerate(items))
    stack, expected = [], {}
    for _, piece, i in order:
        if not piece:
            stack.append(i)
        else:
            expected[i] = stack.pop() if stack else None
    edges = [0, *sorted(min(c, len(order)) for c in cuts), len(order)]
    found, loose = {}, {}
    for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        passed = []
        for _, piece, i in order[a:b]:
            if not piece:
                passed.append(i)
            elif passed:
                found[i] = passed.pop()
            else:
                loose.setdefault((r, packing.PIECE), []).append(i)
        if passed:
            loose[r, packing.GAP] = passed
    runs, stay = packing.across({k: len(v) for k, v in loose.items()})
    for r, first, many, of, number in runs:
        for j in range(many):
            found[loose[r, packing.PIECE][first + j]] = loose[of, packing.GAP][number - j]
    assert found == {i: g for i, g in expected.items() if g is not None}
    assert sum(gaps for _, gaps, _ in stay) == len(stack)
