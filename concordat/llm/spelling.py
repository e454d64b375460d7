"""Spelling variants: words one code point apart, found by exact PartEnum signatures of their letter multisets.

**Words.** Every maximal run of letters (``RUNS``) of every text, A-Z lower-cased, is counted by tasks before counts are
shuffled, so a word that is everywhere is a row or a few a task. Where crc32 of ``<doc_id>:<run>`` is divisible by ``every``, one code point is left
out first, as the contract of the query has it; a null doc_id reads as an empty one. Kept are words of at least
``shortest`` code points that occur ``least`` times or more. Null and empty texts have no words, repeated rows count again,
long texts are read in place, only the id and the text are read, and an empty table has no words.

**Candidates.** A word is the set of its numbered letters (the second "e" is one of its own), a binary vector. An inserted
or deleted code point changes one bit of it, a replaced one two. The letters are dealt to parts by a hash, and signatures
enumerate what can be left out: words of one length share the content of all but two of ``PARTS`` parts, words whose
lengths differ by one all but one of ``BAND_PARTS``. Each signature carries the length, so no other words meet. Words
that share a signature are compared, first by equal first or second halves (one of them has no edit), then letter by
letter; equal words never meet, being one row.

**Hot signatures** are shared by more than ``HOT`` words (orders of the same syllables, say). Their words meet by what is left
of them without one letter instead, again exactly: two words one replacement apart agree without that place, an
insertion apart the longer one without it is the shorter one. No more words share that than there are letters to put in
one place, so no group is compared pair by pair, however many share a signature.

A word's form is its near word of largest count, ties to the smallest in code-point order, if that count is at least twice
its own. Counts at least double from form to form, so the way to the root is short; it is followed by doubling. Signatures
and keys are 64-bit hashes of exact contents: equal contents always meet, and what meets by chance fails the comparison.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.llm import hashing
from concordat.llm.common import chunks, discard, keyed_text, partitions, release, small, table, written

RUNS = re.compile("[a-zÀ-ÿ]+")
HELD = 200_000  # different words that a task counts before it hands the counts on
PARTS, BAND_PARTS, HOT = 6, 4, 256
SAME, SHORT, LONG = 0, 1, 2
KEYED = "sig long, kind byte, word string, n long"
PAIRS = "word string, n long, near string, near_n long"
ODD = np.uint64(0x9E3779B97F4A7C15)


def words(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in chunks(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text.encode().lower().decode()  # of bytes, so only A-Z change
                runs = Counter(RUNS.findall(text) if len(text) < 1 << 20 else (m[0] for m in RUNS.finditer(text)))
                before = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in runs.items():
                    if len(run) >= shortest:
                        h = zlib.crc32(run.encode(), before)
                        held[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += n
                if len(held) > HELD:
                    yield _counts(held)
                    held.clear()
        yield _counts(held)

    rows = docs.select("doc_id", "text").mapInArrow(counted, "word string, n long").where(F.length("word") >= shortest)
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


class Letters:
    """Code points of many words in one array."""

    def __init__(self, words: list[str]) -> None:
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.owner = np.repeat(np.arange(len(words)), self.size)

    def part_sums(self, parts: int) -> np.ndarray:
        """A hash of each word's numbered letters in each part: their sum, whatever their order."""
        order = np.lexsort((self.flat, self.owner))
        letter = self.flat[order]
        fresh = np.ones(len(letter), bool)
        fresh[1:] = (letter[1:] != letter[:-1]) | (self.owner[1:] != self.owner[:-1])
        nth = np.arange(len(letter)) - np.maximum.accumulate(np.where(fresh, np.arange(len(letter)), 0))
        bit = hashing.mix((letter << np.uint64(40)) + nth.astype(np.uint64) + np.uint64(1))
        out = np.zeros((len(self.size), parts), np.uint64)
        np.add.at(out, (self.owner, ((bit >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)), hashing.mix(bit + ODD))
        return out

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the first n // 2 and the last n - n // 2 letters, for n the word's length and for one less."""
        total = hashing.prefix(hashing.mix(self.flat + ODD))
        down = hashing.powers(len(self.flat) + 1)[1]
        end = self.start + self.size
        part = lambda a, b: (total[b] - total[a]) * down[a]
        h, g = self.size // 2, (self.size - 1) // 2
        return part(self.start, self.start + h), part(self.start + h, end), part(self.start, self.start + g), part(end - (self.size - 1 - g), end)

    def without(self) -> np.ndarray:
        """For every letter the hash of its word without it."""
        total = hashing.prefix(hashing.mix(self.flat + ODD))
        down = hashing.powers(len(self.flat) + 2)[1]
        at, start = np.arange(len(self.flat)), self.start[self.owner]
        end = start + self.size[self.owner]
        return (total[at] - total[start] + (total[end] - total[at + 1]) * down[1]) * down[start]

    def whole(self) -> np.ndarray:
        total = hashing.prefix(hashing.mix(self.flat + ODD))
        return (total[self.start + self.size] - total[self.start]) * hashing.powers(len(self.flat) + 1)[1][self.start]


def _key(content: np.ndarray, size: np.ndarray, tag: np.ndarray | int) -> np.ndarray:
    return hashing.mix(content + hashing.mix(size.astype(np.uint64) * ODD + np.asarray(tag).astype(np.uint64))).view(np.int64)


def _emitted(batch: pa.RecordBatch, owner: np.ndarray, sig: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    at = pa.array(owner)
    return pa.record_batch([pa.array(sig), pa.array(kind.astype(np.int8)), batch.column("word").take(at), batch.column("n").take(at)], names=["sig", "kind", "word", "n"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PartEnum signatures of words (word, n)."""
    for batch in chunks(batches, "word", 1 << 18):
        letters = Letters(batch.column("word").to_pylist())
        all_words = np.arange(len(letters.size))
        parts, band = letters.part_sums(PARTS), letters.part_sums(BAND_PARTS)
        full, band_full = parts.sum(axis=1), band.sum(axis=1)
        owner, sigs, kinds = [], [], []
        for tag, (i, j) in enumerate(combinations(range(PARTS), 2)):
            owner.append(all_words)
            sigs.append(_key(full - parts[:, i] - parts[:, j], letters.size, tag))
            kinds.append(np.full(len(all_words), SAME))
        for i in range(BAND_PARTS):
            for kind, size in ((SHORT, letters.size), (LONG, letters.size - 1)):
                owner.append(all_words)
                sigs.append(_key(band_full - band[:, i], size, 1000 + i))
                kinds.append(np.full(len(all_words), kind))
        yield _emitted(batch, np.concatenate(owner), np.concatenate(sigs), np.concatenate(kinds))


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (word, n) by what is left of them without one letter: with its place for a replacement, and for an insertion."""
    for batch in chunks(batches, "word", 1 << 18):
        letters = Letters(batch.column("word").to_pylist())
        left, size = letters.without(), letters.size[letters.owner]
        place = np.arange(len(left)) - letters.start[letters.owner]
        yield _emitted(batch, letters.owner, _key(left, size, 2000 + place), np.full(len(left), SAME))
        yield _emitted(batch, letters.owner, _key(left, size - 1, 1999), np.full(len(left), LONG))
        yield _emitted(batch, np.arange(len(letters.size)), _key(letters.whole(), letters.size, 1999), np.full(len(letters.size), SHORT))


def _one_edit(letters: Letters, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[i], b no shorter and by one letter at most longer, differ by exactly one edit."""
    n = letters.size[a]
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    k = np.arange(int(n.sum())) - np.repeat(first, n)
    x, y = np.repeat(letters.start[a], n) + k, np.repeat(letters.start[b], n) + k
    longer = np.repeat(letters.size[b] - n, n)
    ahead = letters.flat[x] != letters.flat[y]
    behind = (letters.flat[x] != letters.flat[y + longer]) & (longer > 0)
    from_here = np.minimum.reduceat(np.where(ahead, k, np.iinfo(np.int64).max), first)
    up_to = np.maximum.reduceat(np.where(behind, k, -1), first)
    return np.where(letters.size[b] > n, up_to < from_here, np.add.reduceat(ahead.astype(np.int64), first) == 1)


def _met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of near words that share a key; ``rows`` are sorted by it and hold whole groups."""
    sig, kind = rows.column("sig").to_numpy(), rows.column("kind").to_numpy()
    some = np.zeros(len(sig), bool)
    some[1:] = sig[1:] == sig[:-1]
    some[:-1] |= sig[1:] == sig[:-1]
    at = np.flatnonzero(some)  # most keys are a single word's
    if not len(at):
        return
    rows, sig, kind = rows.take(pa.array(at)), sig[at], kind[at]
    letters = Letters(rows.column("word").to_pylist())
    first, last, first_less, last_less = letters.halves()
    index = np.arange(len(sig))
    for lag in range(1, len(sig)):
        index = index[: np.searchsorted(index, len(sig) - lag)]
        index = index[sig[index] == sig[index + lag]]
        if not len(index):
            break
        i, j = index, index + lag
        swap = kind[i] == LONG
        i, j = np.where(swap, j, i), np.where(swap, i, j)  # the shorter one first
        same = (kind[i] == SAME) & (kind[j] == SAME) & (letters.size[i] == letters.size[j])
        band = (kind[i] == SHORT) & (kind[j] == LONG) & (letters.size[i] + 1 == letters.size[j])
        ok = np.where(same, (first[i] == first[j]) | (last[i] == last[j]), band & ((first[i] == first_less[j]) | (last[i] == last_less[j])))
        i, j = i[ok], j[ok]
        if len(i):
            ok = _one_edit(letters, i, j)
            i, j = pa.array(i[ok]), pa.array(j[ok])
            a, b = rows.take(i), rows.take(j)
            yield from pa.table([*(t.column(c) for t in (a, b) for c in ("word", "n"))], names=["word", "n", "near", "near_n"]).combine_chunks().to_batches()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, whole groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = batch.column("sig").to_numpy()
        cut = int(np.searchsorted(sig, sig[-1]))  # the last group may go on
        if cut or (held and held[-1].column("sig")[-1].as_py() != sig[0]):
            yield from _met(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _met(pa.Table.from_batches(held))
    release()


def near_words(counted: DataFrame, hot: int = HOT) -> DataFrame:
    """Every pair (word, n, near, near_n) of ``counted`` (a written table: word, n) one edit apart, once."""
    signed = counted.repartition(partitions(counted.sparkSession)).mapInArrow(_signed, KEYED)
    crowded = written(signed.groupBy("sig").agg(F.count("*").alias("rows")).where(F.col("rows") > hot).select("sig"), "hot-signatures")
    few = small(crowded)
    rest = signed.join(few, "sig", "left_anti")
    crowd = signed.join(few, "sig", "left_semi").select("word", "n").distinct()
    keyed = [rest, crowd.mapInArrow(_shortened, KEYED)]
    met = [k.repartition("sig").sortWithinPartitions("sig").mapInArrow(_compared, PAIRS) for k in keyed]
    least, most = F.least("word", "near"), F.greatest("word", "near")
    by_order = F.col("word") == least
    pairs = met[0].union(met[1]).select(least.alias("word"), F.when(by_order, F.col("n")).otherwise(F.col("near_n")).alias("n"), most.alias("near"), F.when(by_order, F.col("near_n")).otherwise(F.col("n")).alias("near_n"))
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) followed to the end: (word, root), by doubling the way at every round."""
    found = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(found.join(further, "root", "left").select("word", "root", "next"), "roots")
        discard(found)
        if moved.where("next IS NOT NULL").isEmpty():
            return moved.select("word", "root")
        found = written(moved.select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(moved)


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97, shortest: int = 5, least: int = 3, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    counted = written(words(keyed_text(docs, key, text), every, shortest, least), "words")
    pairs = written(near_words(counted, hot), "near-words")
    both = pairs.union(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near"))).alias("best"))
    joined = counted.join(best, "word", "left")
    is_form = -F.col("best.rank") >= 2 * F.col("n")
    joined = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.rank")).alias("form_n")), "word-forms")
    discard(pairs, counted)
    ends = roots(joined.where("form IS NOT NULL"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
