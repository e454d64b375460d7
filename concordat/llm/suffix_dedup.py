"""Removal of byte strings that occur more than once, by external induced suffix sorting.

A string of ``least`` bytes is removed wherever it starts, if it starts at two places or more. Candidates: among the
``GRAM``-byte substrings of a window of ``least`` bytes the one of smallest hash (leftmost of equals) is its anchor, so
equal windows have equal anchors at equal places. Successive windows of one anchor are a context: their bytes, and how
many windows start in it. Only contexts whose anchor occurs twice in the corpus can hold repeated windows; only their
hashes are shuffled, and equal contexts are counted as one from then on, however many copies there are.

Contexts that share an anchor with a different context are fetched from the texts and dealt by anchor. A task cuts what
it gets into shards of whole anchors and sorts each shard's suffixes by induction (:mod:`concordat.llm.induced`), with
queues and arrays on disk when a shard outgrows memory; neighbours with ``least`` common bytes are repeated windows.
An anchor that very many different contexts share is first split by the bytes that blocks of their windows have in
common. Contexts that occur twice are repeated as a whole. The runs of repeated windows go back to every occurrence of
their context, are merged per document and cut out.

:func:`remove_repeats` can also be told a number of words: then strings of so many words go as well, however few bytes
they take. For them a text is read as the 8-byte hashes of its words (split at ASCII white space), so lengths in bytes
are lengths in words and the white space between them doesn't count; windows of ``least`` bytes with so many whole words
inside are left to that reading.

Strings are judged on the input; matches end at document borders. Null texts count as empty. Repeated doc_ids are told
apart by their text; rows that are equal in both are two places. So are rows without a doc_id, which stay without one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.llm.common import chunks, discard, keyed_text, partitions, release, table, written
from concordat.llm.hashing import BYTE, mix, powers, prefix
from concordat.llm.induced import neighbours

GRAM, LEAST = 192, 400
SHARD = 2 << 20
HOT, STEP = 2048, 32
LOW = np.uint64(2**28 - 1)
CONTEXTS = "doc_id long, body long, at int, windows int, anchor long, lead int, context long, times int"
CODE = 8
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    edge = np.flatnonzero(np.diff((~_SPACE[raw]).astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def word_codes(text: bytes) -> bytes:
    """The text as the hashes of its words, ``CODE`` bytes each."""
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_edges(raw)
    total, down = prefix(BYTE[raw]), powers(len(raw) + 1)[1]
    return mix((total[ends] - total[starts]) * down[starts]).tobytes()


def _sparse(raw: np.ndarray, least: int, fewer: int) -> np.ndarray:
    """The windows that hold fewer words with white space on both sides."""
    starts, ends = word_edges(raw)
    n = len(raw)
    begun, ended = (np.cumsum(np.bincount(e, minlength=n + 1)[: n + 1], dtype=np.int32) for e in (starts, ends))
    return ended[least - 1 : n] - begun[: n - least + 1] < fewer


def contexts(texts: list[bytes], least: int, gram: int, fewer: int | None = None, unit: int = 1) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor hash, anchor's offset, context hash, times) of all contexts of the texts.

    Equal contexts that follow one another, as in a text that repeats a few bytes, are one row with their number. With ``fewer``, of windows with fewer whole words; with ``unit``, of windows that start at multiples of it.
    """
    of = np.arange(len(texts))
    if fewer is not None and sum(map(len, texts)) >= least:
        starts = np.cumsum([0, *map(len, texts)])
        count = np.append(0, np.cumsum(_sparse(np.frombuffer(b"".join(texts), np.uint8), least, fewer), dtype=np.int32))
        of = np.array([i for i, t in enumerate(texts) if len(t) >= least and count[starts[i + 1] - least + 1] > count[starts[i]]], np.int64)
        texts = [texts[i] for i in of]
    raw = np.frombuffer(b"".join(texts), np.uint8 if unit == 1 else np.uint64)
    starts = np.cumsum([0, *(len(t) // unit for t in texts)])
    least, gram = least // unit, gram // unit
    n, wide = len(raw), least - gram + 1
    if n < least:
        return tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int64, np.int32, np.int64, np.int32))
    total, down = prefix(BYTE[raw] if unit == 1 else raw), powers(n + 1)[1]
    gram_hash = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    smallest, width = gram_hash & ~LOW | np.arange(len(gram_hash), dtype=np.uint64) & LOW, 1
    while width < wide:
        step = min(width, wide - width)
        smallest = np.minimum(smallest[:-step], smallest[step:])
        width += step
    at = np.arange(len(smallest))
    anchor = (at & ~int(LOW)) | (smallest & LOW).astype(np.int64)
    anchor = np.where(anchor < at, anchor + int(LOW) + 1, anchor)  # texts of more than 2^28 bytes
    text = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(at)]
    inside = at + least <= starts[text + 1]
    if fewer is not None:
        inside &= _sparse(raw, least, fewer)
    same = (anchor[1:] == anchor[:-1]) & (text[1:] == text[:-1]) & inside[1:] & inside[:-1]
    first = np.flatnonzero(inside & np.append(True, ~same))
    last = np.flatnonzero(inside & np.append(~same, True))
    lead = anchor[first] - first
    whole = mix(((total[last + least] - total[first]) * down[first]) ^ (lead.astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)))
    again = (whole[1:] == whole[:-1]) & (text[first[1:]] == text[first[:-1]]) & (first[1:] == last[:-1] + 1)
    row = np.flatnonzero(np.append(True, ~again)[: len(first)])
    times = np.diff(np.append(row, len(first))).astype(np.int32)
    first, last, lead, whole = first[row], last[row], lead[row], whole[row]
    return of[text[first]], (unit * (first - starts[text[first]])).astype(np.int32), (unit * (last - first) + 1).astype(np.int32), gram_hash[anchor[first]].view(np.int64), (unit * lead).astype(np.int32), whole.view(np.int64), times


def all_contexts(docs: DataFrame, least: int, gram: int, read: Callable[[bytes], bytes] = bytes, fewer: int | None = None) -> DataFrame:
    unit = 1 if read is bytes else CODE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            text, *rest = contexts([read(t.as_py()) for t in batch.column("text").cast(pa.binary())], least, gram, fewer, unit)
            own = [batch.column(c).take(pa.array(text)) for c in ("doc_id", "body")]
            yield pa.record_batch([*own, *map(pa.array, rest)], names=["doc_id", "body", "at", "windows", "anchor", "lead", "context", "times"])

    shortest = least if unit == 1 else 2 * (least // unit) - 1
    return docs.select("doc_id", "body", "text").where(F.octet_length("text") >= shortest).mapInArrow(run, CONTEXTS)


PIECES = "anchor long, context long, skip int, windows int, bytes binary, shard long"


def pieces(docs: DataFrame, chosen: DataFrame, least: int, read: Callable[[bytes], bytes] = bytes) -> DataFrame:
    """The bytes of the chosen contexts; those of hot anchors in blocks of ``STEP`` windows at equal places from the anchor."""
    by_doc = chosen.groupBy("doc_id", "body").agg(F.collect_list(F.struct("at", "windows", "anchor", "lead", "context", "hot")).alias("chosen"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "__d", "body": "__b"})
    held = docs.join(by_doc, docs.doc_id.eqNullSafe(F.col("__d")) & (docs.body == F.col("__b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, picked in zip(batch.column("text").cast(pa.binary()), batch.column("chosen"), strict=True):
                raw = read(text.as_py())
                for c in picked.as_py():
                    end = c["at"] + c["windows"]
                    if not c["hot"]:
                        rows.append((c["anchor"], c["context"], 0, c["windows"], raw[c["at"] : end - 1 + least], c["anchor"]))
                        continue
                    mark = c["at"] + c["lead"]
                    for block in range((mark - end + 1) // STEP, (mark - c["at"]) // STEP + 1):  # windows that start STEP * block bytes before the anchor or a little more
                        i, j = max(c["at"], mark - STEP * block - STEP + 1), min(end, mark - STEP * block + 1)
                        if i < j:
                            shared = raw[mark - STEP * block : mark - STEP * block - STEP + 1 + least]
                            shard = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=str(block).encode()).digest(), "little", signed=True)
                            rows.append((c["anchor"], c["context"], i - c["at"], j - i, raw[i : j - 1 + least], shard))
                if len(rows) > 4096:
                    yield _pieces(rows)
                    rows = []
            yield _pieces(rows)

    return held.select("text", "chosen").mapInArrow(run, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["anchor", "context", "skip", "windows", "bytes", "shard"])


RUNS = "anchor long, context long, start int, stop int"


def repeated_in(rows: list[tuple], least: int) -> list[tuple[int, int, int, int]]:
    """(anchor, context, first window, end) of the runs of repeated windows of a shard's pieces."""
    text = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).astype(np.int16) + 1
    sizes = np.array([len(r[4]) for r in rows])
    full = np.zeros(len(text) + len(rows), np.int16)
    starts = np.cumsum(np.append(0, sizes[:-1] + 1))
    full[np.arange(len(text)) + np.repeat(np.arange(len(rows)), sizes)] = text
    hit = neighbours(full, least)
    of = np.searchsorted(starts, hit, side="right") - 1
    at = hit - starts[of]
    ok = at < np.array([r[3] for r in rows])[of]
    of, at = of[ok], at[ok]
    if not len(of):
        return []
    new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)))
    end = np.append(new[1:], len(of)) - 1
    return [(rows[of[i]][0], rows[of[i]][1], int(at[i]) + rows[of[i]][2], int(at[j]) + 1 + rows[of[i]][2]) for i, j in zip(new, end, strict=True)]


def repeated(parts: DataFrame, least: int) -> DataFrame:
    """Runs of repeated windows, by induced sorting of every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def sort() -> pa.RecordBatch:
            columns = list(zip(*repeated_in(rows, least), strict=True)) or [()] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["anchor", "context", "start", "stop"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "skip", "windows", "bytes", "shard")), strict=True):
                if size >= SHARD and row[5] != rows[-1][5]:
                    yield sort()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield sort()
        release()

    spark = parts.sparkSession
    dealt = parts.repartition(partitions(spark), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, RUNS)


def spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, read: Callable[[bytes], bytes] = bytes, fewer: int | None = None) -> DataFrame:
    """(doc_id, body, spans array<struct<start, stop>>): the byte ranges to remove, sorted; they may overlap. ``docs`` has doc_id, body, text.

    Ranges are those of the text as ``read`` gives it. With ``fewer``, only windows with fewer whole words are judged.
    """
    found = written(all_contexts(docs, least, gram, read, fewer), "contexts")
    twice = written(found.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "anchors")  # a table of its own: both sides of the join are then dealt for it, and a hot anchor's rows can be split
    shared = written(found.join(twice, "anchor", "left_semi"), "shared-contexts")
    discard(found, twice)
    place = F.min(F.struct("doc_id", "body", "at", "windows", "lead")).alias("r")
    distinct = written(shared.groupBy("anchor", "context").agg(F.sum("times").alias("n"), place), "distinct-contexts")
    groups = written(distinct.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1"), "anchors-of-several")
    chosen = distinct.join(groups, "anchor").select("r.*", "anchor", "context", (F.col("contexts") > HOT).alias("hot"))
    sorted_out = repeated(pieces(docs, chosen, least, read), least)
    whole = distinct.where("n > 1").select("anchor", "context", F.lit(0).alias("start"), F.col("r.windows").alias("stop"))
    runs = written(whole.unionByName(sorted_out), "runs")
    discard(distinct, groups)
    step = F.col("windows") + (0 if read is bytes else CODE - 1)  # to the next of equal contexts; windows of codes start every CODE bytes
    hits = shared.join(runs, ["anchor", "context"]).select("doc_id", "body", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("stop") - 1 + least + (F.col("times") - 1) * step).alias("stop"))
    ordered = F.sort_array(F.collect_set(F.struct("start", "stop")))
    return hits.groupBy("doc_id", "body").agg(ordered.alias("spans"))


def _merged(found: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in found:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["stop"])
        else:
            out.append([s["start"], s["stop"]])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, text and the ranges to remove (null if none) of every row; texts come back whole."""
    docs = keyed_text(docs).withColumn("body", F.xxhash64("text"))
    found = spans(docs, least, gram).withColumnsRenamed({"doc_id": "d", "body": "b"})
    return docs.join(found, docs.doc_id.eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")), "left").select("doc_id", "text", "spans")


def _remaining(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in ranges for x in r), len(raw)]
    return b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))


def _word_ranges(raw: bytes, coded: list[dict]) -> list[dict]:
    """Ranges of :func:`word_codes` as ranges of the text; of a code that is only partly inside nothing goes."""
    starts, ends = word_edges(np.frombuffer(raw, np.uint8))
    return [{"start": int(starts[-(-c["start"] // CODE)]), "stop": int(ends[c["stop"] // CODE - 1])} for c in coded]


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """``docs`` with the repeated strings of ``least`` bytes or of ``words`` words cut out of the text; a character that a cut divides goes with it."""
    keyed = keyed_text(docs, key, text).withColumn("body", F.xxhash64("text"))
    found = spans(keyed, least, gram, fewer=words).withColumn("coded", F.lit(False))
    if words is not None:
        found = found.unionByName(spans(keyed, CODE * words, max(1, CODE * (words // 3)), word_codes).withColumn("coded", F.lit(True)))
    kinds = [F.first(F.when(F.col("coded") == kind, F.col("spans")), ignorenulls=True).alias(name) for name, kind in (("__spans", False), ("__coded", True))]
    found = found.groupBy(F.col("doc_id").alias("__d"), F.col("body").alias("__b")).agg(*kinds)
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = docs.withColumn(text, own).join(found, F.col(key).cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(own) == F.col("__b")), "left").drop("__d", "__b")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t, f, c in zip(batch.column(text).cast(pa.binary()), batch.column("__spans"), batch.column("__coded"), strict=True):
                raw = t.as_py()
                ranges = sorted((f.as_py() or []) + _word_ranges(raw, c.as_py() or []), key=lambda r: (r["start"], r["stop"]))
                kept.append(_remaining(raw, _merged(ranges)).decode("utf-8", "ignore") if ranges else raw.decode())
            yield pa.record_batch([pa.array(kept, pa.string()) if n == text else batch.column(n) for n in names], names=names)

    return marked.mapInArrow(run, marked.drop("__spans", "__coded").schema)


def digests(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """What went and what is left; ``text`` is what is left, without characters that a cut divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            columns: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column("text").cast(pa.binary()), batch.column("spans"), strict=True):
                raw, ranges = text.as_py(), _merged(found.as_py() or [])
                kept = _remaining(raw, ranges)
                for column, value in zip(columns, (len(raw), len(raw) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")), strict=True):
                    column.append(value)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return with_spans(docs, least, gram).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
