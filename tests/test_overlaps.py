from __future__ import annotations

import itertools
import random
from collections import defaultdict

import numpy as np

from concordat.functions import similarity as sim, text as tx
from concordat.operators import overlaps, positions

from pyspark.sql import functions as F

SYLLABLES = "про клад ка мон таж каб ель сил ов опт иче ск труб вод гор яч хол од ст ал ьн окр ас мет конс тр укц изв ещ ат пож ар дым бет он арм ир кир пич шт ук".split()


def descriptions(n, seed=1):
    """Different texts of a few inflected words; a third are another one with an ending, a word or the order changed."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(n // 6 + 20)]
    weights = list(itertools.accumulate(1 / (i + 10) for i in range(len(stems))))
    out, base = set(), []
    while len(out) < n:
        if base and rng.random() < 0.3:
            words = list(rng.choice(base))
            k = rng.randrange(len(words))
            what = rng.random()
            if what < 0.4:
                words[k] = words[k][:-1] + rng.choice("аоыиу")
            elif what < 0.6:
                words.insert(k, rng.choice(["25", "100", "мм", "на"]))
            elif what < 0.8 and len(words) > 1:
                words.pop(k)
            else:
                rng.shuffle(words)
        else:
            words = [s + rng.choice(["", "а", "у", "ой", "ого", "ые"]) for s in rng.choices(stems, cum_weights=weights, k=rng.randint(1, 8))]
            base.append(words)
        out.add(" ".join(words))
    return sorted(out)


def all_pairs(texts):
    """Every pair with a token-set ratio of 82 or more, by bounds that need no index: shared weights and shared characters of all pairs."""
    tokens = [set(t.split()) for t in texts]
    strings = [" ".join(sorted(x)) for x in tokens]
    size = np.array([len(s) for s in strings])
    weight = np.array([sum(len(w) + 1 for w in x) for x in tokens])
    chars = sorted({c for s in strings for c in s})
    bags = np.array([[s.count(c) for c in chars] for s in strings], np.int16)
    lists = defaultdict(list)
    for i, x in enumerate(tokens):
        for w in x:
            lists[w].append(i)
    out = set()
    for i, x in enumerate(tokens):
        shared = np.zeros(len(texts), int)
        for w in x:
            shared[lists[w]] += len(w) + 1
        held = shared >= 1 + 0.82 / 1.18 * (np.minimum(weight, weight[i]) - 1) - 1e-6
        bagged = 2 * np.minimum(bags, bags[i]).sum(axis=1) >= 0.82 * (size + size[i]) - 1e-6
        out |= {(i, int(j)) for j in np.flatnonzero(held | bagged) if j > i and sim.token_set(texts[i], texts[j]) >= 82 - 1e-9}
    return out


def test_token_set_pairs_equal_all_pairs_from_few_candidates(spark):
    texts = descriptions(3000)
    table = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    contained = {tuple(r) for r in overlaps.contained_pairs(table, "norm", 82.0).collect()}
    aligned = {tuple(r) for r in overlaps.aligned_pairs(table, "norm", 82.0).collect()}
    found = {p for p in contained | aligned if sim.token_set(texts[p[0]], texts[p[1]]) >= 82 - 1e-9}
    expected = all_pairs(texts)
    assert len(expected) > 500 and found == expected
    assert len(contained | aligned) < 50 * len(expected)
    assert contained <= expected  # needs no alignment


def test_odd_texts(spark):
    texts = ["", " ", "a", "a a", "a b", "b a", "é́ x", "длинное " * 3000, "длинное слово " * 2000, "слово", "x" * 5000, "x" * 4990, "1", "на"]
    table = spark.createDataFrame([*enumerate(texts), (99, None)], "id long, norm string")
    got = {tuple(r) for f in (overlaps.contained_pairs, overlaps.aligned_pairs) for r in f(table, "norm", 82.0).collect()}
    assert {p for p in got if sim.token_set(texts[p[0]], texts[p[1]]) >= 82} == all_pairs(texts)
    empty = table.limit(0)
    assert overlaps.contained_pairs(empty, "norm", 82.0).count() == overlaps.aligned_pairs(empty, "norm", 82.0).count() == 0


def test_opposed_pairs_equal_all_pairs(spark):
    rng = random.Random(5)
    words = ["силовой", "силовая", "оптический", "слаботочный", "горячий", "холодный", "металлический", "деревянный", "кабель", "кабеля", "труба", "линия", "в", "на", "внутри", "монтаж", "щит"]
    raw = sorted({" ".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(250)})
    rows = [(i // 2, t.upper() if i % 3 else t) for i, t in enumerate(raw)]  # two raw texts an id
    norms = {i: " ".join(t.lower() for j, t in rows if j == i) for i, _ in rows}
    stems = lambda t, f: {s for s in f if s in t.lower()}
    expected = set()
    for (i, a), (j, b) in itertools.product(rows, rows):
        clash = any(stems(a, f) and stems(b, f) and stems(a, f) != stems(b, f) for f in sim.QUALIFIERS)
        if i < j and clash and len(set(norms[i].split()) & set(norms[j].split()) - set(sim.STOPWORDS)) >= 2:
            expected.add((i, j))
    table = spark.createDataFrame(list(norms.items()), "id long, norm string")
    got = overlaps.opposed_pairs(table, spark.createDataFrame(rows, "id long, text string"), "norm")
    assert expected and {tuple(r) for r in got.collect()} == expected


def test_candidates_hold_every_pair_that_passes_the_gate(spark):
    """The words' half of a cosine suffices, but for texts without words."""
    rows = [(i, t) for i, t in enumerate([*descriptions(120, 3), "а", "б", "а б", "б а", "а б в", "!", ""])]
    table = spark.createDataFrame(rows, "row_idx long, norm string").withColumn("norm", tx.normalize_text(F.col("norm"))).select(F.col("row_idx").alias("id"), "norm", F.lit(1).alias("copies"))
    weights = positions._weights(table, tx.word_features(F.col("norm")), tx.char_features(F.col("norm")), positions.FEATURES)
    pairs = table.select(F.col("id").alias("l")).crossJoin(table.select(F.col("id").alias("r"))).where("l < r")  # all pairs of a small fixture
    passing = {(r["l"], r["r"]) for r in positions._cosine(pairs, *weights).where(F.col("cosine") >= positions.COSINE).collect()}
    found = {tuple(r) for r in positions.classic_candidates(table.select("id", "norm"), table.select("id", F.col("norm").alias("text")), *weights).collect()}
    assert passing and passing <= found
