from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from concordat.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, sig long"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(rows, every=97, least=3):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def run(spark, rows, **options):
    got = [tuple(r) for r in spelling.variants(spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SCHEMA), **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed, n=120):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(["the", "ing", "er", "on", "st", "É", "ß", "e", "e"]) for _ in range(rng.randint(2, 5))) for _ in range(150)]
    for w in pool[:60]:
        k = rng.randrange(len(w))
        pool += [w[:k] + w[k + 1 :], w[:k] + rng.choice("eaé") + w[k:], w[:k] + "x" + w[k + 1 :]]
    rows = [(i, rng.choice([" ", "\n", "1"]).join(rng.choice(pool) if rng.random() < 0.9 else rng.choice(pool).upper() for _ in range(40))) for i in range(n)]
    return [*rows, (5, None), (6, ""), (7, "12 ×÷ a b"), (None, rows[0][1]), (None, rows[1][1]), rows[2], rows[2], (9, "therińg KKelvin İstanbul " * 3)]


@pytest.mark.parametrize(("every", "hot"), [(97, spelling.HOT), (3, 1), (5, 4)])
def test_matches_brute_force_with_and_without_hot_signatures(spark, every, hot):
    rows = corpus(every)
    want = brute(rows, every)
    assert sum(w[1] is not None for w in want) > 20
    assert run(spark, rows, every=every, hot=hot) == want


def test_orders_of_one_set_of_letters_and_long_words(spark):
    rng = random.Random(8)
    letters = list("abcdefgh")
    words = {"".join(rng.sample(letters, 8)) for _ in range(500)}
    words |= {w[:-1] for w in list(words)[:100]} | {"z" + w[1:] for w in list(words)[:100]}
    long = "ab" * 20_000
    rows = [(i, " ".join([*words, long, long[1:], long + "c"])) for i in range(3)] + [(9, long)]
    for hot in (spelling.HOT, 8):
        assert run(spark, rows, every=10**9, hot=hot) == brute(rows, 10**9)


def test_chains_and_ties(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    rows = [(1, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k)))]
    got = run(spark, rows, every=10**9)
    assert got == brute(rows, 10**9) and {r[2] for r in got} == {"bbbbb"}
    rows = [(1, "house " * 3 + "mouse " * 6 + "louse " * 6)]
    assert run(spark, rows, every=10**9) == {("house", "louse", "louse", 3, 2, 6), ("mouse", None, "mouse", 6, 2, None), ("louse", None, "louse", 6, 2, None)}


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, None), (2, "a b c")]) == set()


def test_query_reads_whole_texts(spark, tmp_path):
    rows = corpus(1)
    spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = spelling.op11_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == brute(rows)
