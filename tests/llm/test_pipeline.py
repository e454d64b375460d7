from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from concordat.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(tmp_path, spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["th", "an", "er", "on", "re", "st", "ly", "ou"]) for _ in range(rng.randrange(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts, toxic = {}, set()
    for i in range(150):
        texts[i] = prose(60) + "\n" + prose(90)
        if i % 5 == 0:
            toxic.add(i)
            words = texts[i].split(" ")
            for _ in range(8):
                words.insert(rng.randrange(len(words)), rng.choice(["stupid", "worthless", "pathetic", "moron"]))
            texts[i] = " ".join(words)
        elif i % 7 == 1:
            texts[i] += "\nAll rights of this page are reserved"
    texts[201] = texts[1]  # copy, but for a recurring line
    texts[202] = texts[2].replace(" ", "  ", 1)  # near copy
    passage = prose(120)
    texts[203], texts[204] = prose(80) + "\n" + passage + "\n" + prose(80), prose(70) + "\n" + passage + "\n" + prose(90)
    texts[205], texts[206] = None, ""
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return texts, toxic, passage


def test_stages_take_effect(spark, tmp_path):
    texts, toxic, passage = make(tmp_path, spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-duplicate removal", "suffix-array dedup", "best-fit packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert all(r["n_chars"] == len(r["text"] or "") for r in rows.values())
        seen.append({i: r["text"] for i, r in rows.items()})
    after_toxicity, after_lines, after_near, after_repeats = seen
    gone = set(texts) - set(after_toxicity)
    assert gone <= toxic and len(gone) >= 0.7 * len(toxic)
    assert set(after_lines) == set(after_toxicity) and not any("reserved" in (t or "") for t in after_lines.values())
    assert set(after_lines) - set(after_near) == {201, 202}
    assert set(after_repeats) == set(after_near) and passage not in after_repeats[203] and passage not in after_repeats[204]
    assert all(after_repeats[i] == after_near[i] for i in after_near if i not in (203, 204))
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"]: r["length"] for r in packed} == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in after_repeats.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["ids_crc32"]) for r in packed)


def test_repeats_of_more_than_50_words_are_cut(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    p51, p50, short, solid = prose(51), prose(50), " ".join("abcdefghij"[rng.randrange(10)] for _ in range(51)), "".join(rng.choice("abcdefghij") for _ in range(420))
    assert len(p51) < 400 and len(short) == 101
    texts = {}
    for n, p in enumerate((p51, p50, short, solid)):
        for k in range(2):
            texts[10 * n + k] = (prose(40), p, prose(40))
    docs = spark.createDataFrame([(i, "\n".join(t), "en", "s", 0) for i, t in texts.items()], SCHEMA)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, str(tmp_path)).collect()}
    for i, (a, p, b) in texts.items():
        assert out[i] == (f"{a}\n{p}\n{b}" if p is p50 else f"{a}{b}" if p is solid else f"{a}\n\n{b}"), i


def test_rows_without_doc_id(spark, tmp_path):
    rng = random.Random(10)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    alone, copied, named = prose(80), prose(80), prose(80)
    texts = [(None, alone), (None, copied), (None, copied), (None, copied + " end"), (None, named), (7, named), (8, prose(80)), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    groups = [(i, t) for i, t in left if t not in (copied, copied + " end")]
    assert len(left) == len(groups) + 1 and sorted(groups, key=str) == sorted([texts[0], texts[5], texts[6], (None, None), (None, "")], key=str)

    passage = prose(60)
    rows = [(i, f"{a}\n{passage}\n{b}") for i, a, b in [(None, prose(40), prose(40)), (None, prose(40), prose(40)), (3, prose(40), prose(40)), (4, prose(40), prose(40))]]
    rows += [(None, passage[:200] + prose(60) + passage[200:])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    out = [r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, str(tmp_path)).collect()]
    assert len(out) == 5 and not any(passage in t for t in out)

    rows = [(None if i % 2 else i, f"{prose(30)}\nAccepted login from user {'qwertzuiopas'[i]} at 10.0.0.{i} today") for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    out = [r["text"] for r in corpus_pipeline.drop_lines(spark, docs, str(tmp_path)).collect()]
    assert sorted(out) == sorted(t.split("\n")[0] for _, t in rows)
