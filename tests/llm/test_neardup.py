from __future__ import annotations

import random
import re

from concordat.llm import neardup

SCHEMA = "doc_id long, text string, n int, component string"


def brute(rows, words, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(rng, words, share):
    return [rng.choice("xyzuvw") * 3 + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def make(seed=3):
    rng = random.Random(seed)
    rows = [(1000 + i, t) for i, t in enumerate([None, "", " \n", "One", "one", "ONE\ttwo", "one two", "É a", "é a", "x\x1cy z"])]
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(3000)}"
    for b in range(25):
        base = [word() for _ in range(rng.choice([3, 8, 30, 60, 70, 90, 300, 1500]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05, 0.1])))))
    chain = [f"c{i}" for i in range(400)]
    rows += [(2000 + i, " ".join(chain[8 * i : 8 * i + 200])) for i in range(20)]  # neighbours similar, ends not
    passage = [f"p{i}" for i in range(40)]
    rows += [(3000 + i, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(30)])) for i in range(60)]  # one passage, not similar
    return rows


def run(spark, rows, words, **options):
    return {tuple(r) for r in neardup.near_duplicates(spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA), words=words, **options).collect()}


def test_two_words(spark):
    rows = make()
    assert run(spark, rows, 2) == brute(rows, 2)


def test_five_words_without_leader_rounds(spark):
    rows = make(5)
    assert run(spark, rows, 5, rounds=0) == brute(rows, 5)


def test_empty(spark):
    assert run(spark, [], 2) == set()


def test_sizes_at_the_threshold(spark):
    rng = random.Random(7)
    rows, n = [], 0
    for size in [2, 3, 5, 6, 10, 11, 16, 20, 21, 50, 51, 100, 125, 500, 505]:  # sets of size - 1 shingles, and parts of them just above and just below 80 %
        words = [f"s{size}x{i}" for i in range(size)]
        for k in {size, -(-4 * (size - 1) // 5) + 1, -(-4 * (size - 1) // 5)}:
            rows.append((n := n + 1, " ".join(words[:k])))
    phrase = " ".join(f"common{i}" for i in range(30))
    rows += [(1000 + i, phrase + " " + " ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.choice([2, 5, 8, 30, 400])))) for i in range(40)]  # in more than 15 documents of many sizes
    assert run(spark, rows, 2) == brute(rows, 2)


def test_values_shared_with_other_sizes_only_name_no_list(spark):
    reps = [(1, 20, list(range(20))), (2, 200, list(range(64))), (3, 24, [*range(100, 121), 5, 6, 7]), (4, 22, list(range(100, 122)))]
    found = neardup.inverted(spark.createDataFrame(reps, "rep long, n long, sketch array<long>"), 80).collect()
    assert {r["rep"] for r in found} == {3, 4}


def test_both_sides_of_a_block_are_one_row(spark):
    rows = [(1, i, 1, i, i > 0, True) for i in range(40)]
    rows = spark.createDataFrame(rows, "list long, rep long, n long, component long, left boolean, right boolean")
    one = neardup.dealt(rows, neardup.F.lit(1), (50, 50)).collect()
    assert len(one) == 40 and len({r["g"] for r in one}) == 1
    met = {}
    for r in neardup.dealt(rows, neardup.F.lit(1), (10, 15)).collect():
        met.setdefault(r["g"], ([], []))[0].extend([r["rep"]] * r["left"])
        met[r["g"]][1].extend([r["rep"]] * r["right"])
    pairs = sorted((a, b) for left, right in met.values() for a in left for b in right)
    assert pairs == [(a, b) for a in range(1, 40) for b in range(40)] and len(met) > 4


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SKETCH_BLOCK", (4, 8))
    monkeypatch.setattr(neardup, "SET_BLOCK", (400, 900))
    rows = make(9)
    assert run(spark, rows, 2) == brute(rows, 2)
