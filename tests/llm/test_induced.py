from __future__ import annotations

import numpy as np
from hypothesis import given, settings, strategies as st

from concordat.llm.induced import neighbours


def brute(strings, least):
    text = "\0".join(strings) + "\0"
    seen = {}
    for i in range(len(text)):
        piece = text[i : i + least]
        if len(piece) == least and "\0" not in piece:
            seen.setdefault(piece, []).append(i)
    return sorted(i for at in seen.values() if len(at) > 1 for i in at)


def run(strings, least, **options):
    text = "\0".join(strings) + "\0"
    found = neighbours(np.array([0 if c == "\0" else ord(c) - 95 for c in text], np.int64), least, **options)
    return [int(i) for i in found if "\0" not in text[i : i + least] and i + least <= len(text)]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text("ab", max_size=30) | st.text("abc", max_size=60), min_size=1, max_size=6), st.integers(1, 9))
def test_equals_brute_force(strings, least):
    assert run(strings, least) == brute(strings, least)


def test_runs_and_queues_on_disk():
    rng = np.random.default_rng(2)
    strings = ["a" * 500, "b" + "a" * 300, "".join(rng.choice(list("ab"), 3000)), "ab" * 400]
    strings.append(strings[2][1000:1500] + "c" * 40)
    assert run(strings, 20, memory=1000) == brute(strings, 20)
