from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from concordat.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids int, w string"
TEXTS = ["Hello, the world's  \n\n x", "", None, " \x1c\x1d a\x85b c d", "ñandú 日本語 😀👍🏽 'll'S", "a" * 700 + " " * 300 + "b", "é" * 300, "x²½ ١٢", "<|endoftext|>", "the the the", "the the the"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def test_digests_and_round_trip(spark, reference):
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(TEXTS)], SCHEMA)
    rows = {r["doc_id"]: r for r in bpe.digests(docs, PATH, P.PATTERN).collect()}
    coded = bpe.encode(docs, PATH, P.PATTERN)
    ids = {r["doc_id"]: r["ids"] for r in coded.collect()}
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(coded, PATH, P.PATTERN).collect()}
    for i, text in enumerate(TEXTS):
        expected = reference.encode_ordinary(text or "")
        assert ids[i] == expected and back[i] == (text or "").encode()
        assert rows[i]["n_tokens"] == len(expected)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("ab',.1 \n\t\r\v\x85é×\xa0\x1c\u2003\u200b(", max_size=20), min_size=1, max_size=6))
def test_recursive_query_equals_library(reference, texts):
    own = bpe.codec(PATH, P.PATTERN)
    ids, ends = own.ids(pa.array(texts, pa.string()))
    for text, i, j, back in zip(texts, [0, *ends], ends, own.decode(ids, ends), strict=False):
        assert ids[i:j].tolist() == reference.encode_ordinary(text)
        assert back == text.encode()
        assert [i for w in own.split(text) for i in bpe.contract(w.encode(), own.rank)] == reference.encode_ordinary(text)


@pytest.mark.parametrize("size", [64, 65, 100, 199, 256, 257, 1000, 5000])
def test_long_words(reference, size):
    rng = random.Random(size)
    words = ["".join(rng.choice("abcdeé") for _ in range(size)), "".join(rng.choice("etaoinshr") for _ in range(size)), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(size // 3)), "ab" * (size // 2), "".join(rng.choice(["上海", "的", "中国", "人民", "是"]) for _ in range(size // 6))]
    own = bpe.codec(PATH, P.PATTERN)
    ids, ends = own.ids(pa.array(words, pa.string()))
    for word, i, j in zip(words, [0, *ends], ends, strict=False):
        assert ids[i:j].tolist() == reference.encode_ordinary(word)


def test_many_long_words_and_a_long_text_without_spaces(reference):
    """Both once outgrew DuckDB's memory."""
    rng = random.Random(1)
    many = " ".join("".join(rng.choice("abcdefghij") for _ in range(64)) for _ in range(16_000))
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300_000)) + "。" * 3000
    one = "x" * 1_000_000
    own = bpe.codec(PATH, P.PATTERN)
    ids, ends = own.ids(pa.array([many, chinese, one], pa.string()))
    assert ids[: ends[0]].tolist() == reference.encode_ordinary(many)
    assert ids[ends[0] : ends[1]].tolist() == [i for w in own.split(chinese) for i in bpe.contract(w.encode(), own.rank)]
    assert [len(b) for b in own.decode(ids, ends)] == [len(x.encode()) for x in (many, chinese, one)]
