"""Toxicity by compression distance: two zstandard dictionaries, one trained on ordinary and one on toxic text.

zstandard's trainer picks what is frequent, and in whole texts of either class that is the same common syllables. So texts
are split first by what explains them: a word is typical of toxic text if it follows many more different words there than
its use in ordinary texts explains (contexts are counted instead of occurrences, because copies of one text repeat its
contexts). The toxic dictionary is trained on toxic texts without the words that ordinary text explains, the ordinary one
on windows of ordinary texts without the typical ones. Both compressors get the ordinary content; the toxic one ends with
the toxic content, the other with bytes that occur in no text, so that their layout is the same. A text is cut into
windows of about ``WINDOW`` bytes at spaces, both compressors pack every window, and what the toxic dictionary saves is
the window's distance. A logistic curve over the largest distances and the number of windows turns them into a score; it
is fitted on texts that the dictionaries behind their distances have not seen, so its threshold holds for new text.

Learning takes at most ``SAMPLE`` labelled rows of each class (by hash of doc_id) with texts of at most ``LONGEST`` bytes;
class weights restore the shares of all labelled rows. Scoring reads every text whole. Null texts count as empty. A
doc_id labelled twice counts as toxic if any label says so; null labels are ignored. Without labels of one class the
score is the share of the other one everywhere. Where samples are too few for the trainer they are the content themselves.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.llm.common import chunks, keyed_text, table

SAMPLE, LONGEST = 2000, 1 << 16
WINDOW, SIZE, LEVEL, TOP = 40, 16384, 12, 3
ODDS = 15.0
FOLDS = 6
THRESHOLD = 0.7


def windows(raw: bytes) -> list[bytes]:
    out, i = [], 0
    while i < len(raw):
        j = raw.find(b" ", i + WINDOW)
        j = len(raw) if j < 0 else j
        out.append(raw[i:j])
        i = j
    return out


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)
    constant: float = 0.0

    def compressors(self) -> tuple:
        import zstandard

        def make(content: bytes):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress

        return make(self.ordinary), make(self.toxic)


def features(texts: list[bytes], model: Model) -> np.ndarray:
    """The largest distances of every text's windows, largest first, the logarithm of their number, and 1."""
    plain, toxic = model.compressors()
    out = np.zeros((len(texts), TOP + 2))
    for row, raw in zip(out, texts, strict=True):
        parts = windows(raw)
        best = sorted([len(plain(w)) - len(toxic(w)) for w in parts], reverse=True)[:TOP]
        row[: len(best)] = best
        row[TOP:] = math.log(max(1, len(parts))), 1
    return np.maximum(out, 0)


def typical_words(texts: list[bytes], labels: np.ndarray) -> set[bytes]:
    """Words with many more different contexts in toxic texts than their use in ordinary ones explains."""
    contexts: tuple[set, set] = (set(), set())
    size = [0, 0]
    for raw, y in zip(texts, labels, strict=True):
        words = raw.split()
        contexts[y].update(zip([b"", *words], words, strict=False))
        size[y] += len(words)
    common, typical = (Counter(w for _, w in c) for c in contexts)
    least = min(6, max(3, int(labels.sum()) // 75))
    share = max(1, size[0]) / max(1, size[1])
    return {w for w, n in typical.items() if n >= least and len(w) > 2 and n * share / (common[w] + 0.5) >= ODDS}


def trained_content(samples: list[bytes], size: int, segment: int) -> bytes:
    """``size`` bytes at most that the trainer picks from the samples, the best last."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, level=LEVEL).as_bytes()[-size:]
    except zstandard.ZstdError:  # too few samples
        return b"".join(dict.fromkeys(samples))[-size:]


def dictionaries(texts: list[bytes], labels: np.ndarray) -> Model:
    typical = typical_words(texts, labels)
    reduced = lambda raw, kept: b" " + b" ".join([w for w in raw.split() if (w in typical) == kept]) + b" "
    toxic = [r for raw, y in zip(texts, labels, strict=True) if y and len(r := reduced(raw, True)) > 8]
    ordinary = [w for raw, y in zip(texts, labels, strict=True) if not y for w in windows(reduced(raw, False))]
    base = trained_content(ordinary, SIZE, 64)
    tail = trained_content(3 * toxic, SIZE // 16, 20)
    unused = np.random.default_rng(1).integers(128, 160, len(tail)).astype(np.uint8).tobytes()  # continuation bytes only: no text holds such runs
    return Model(base + unused, base + tail)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps, with a light penalty; distances can only raise a score."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (weight * (y - p)) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, toxic): the rows to learn from."""
    marks = labels.where("toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model(constant=float(1 in totals))
    short = keyed_text(docs).where(F.octet_length("text") <= LONGEST)
    rows = []
    for y in (0, 1):  # the smaller side of each join is a sample of ids
        ids = marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        rows += short.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE).select("text", F.lit(y).alias("y")).collect()
    texts, y = [r["text"].encode() for r in rows], np.array([r["y"] for r in rows])
    if len(set(y.tolist())) < 2:
        return Model(constant=totals[1] / sum(totals.values()))
    model = dictionaries(texts, y)
    fold = np.arange(len(y)) % FOLDS
    x = np.zeros((len(y), TOP + 2))
    for part in range(FOLDS):
        other, own = np.flatnonzero(fold != part), np.flatnonzero(fold == part)
        x[own] = features([texts[i] for i in own], dictionaries([texts[i] for i in other], y[other]))
    counts = np.bincount(y)
    model.weights = fit(x, y, np.array([totals[k] / counts[k] for k in (0, 1)])[y])
    return model


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.constant)
    z = features([t.as_py() or b"" for t in texts.cast(pa.binary())], model) @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``THRESHOLD`` or more; all columns come back as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in chunks(batches, text):
            yield some.filter(pa.array(_scores(some.column(text), model) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in chunks(batches):
            yield pa.record_batch([some.column("doc_id"), pa.array(_scores(some.column("text"), model))], names=["doc_id", "score"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, score double")


def trained(spark: SparkSession, sf_dir: str) -> Model:
    """From the labelled rows of the table that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    return learn(table(spark, sf_dir, "documents"), labels)


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), trained(spark, sf_dir))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
