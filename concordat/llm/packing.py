"""Best-fit packing of tokenised documents into fixed-length training sequences, in bulk-synchronous supersteps.

Pieces still to be placed and the gaps of open sequences are one table, range-sorted by size, gaps before pieces of the
same size, about ``RANGE`` rows to a range. A superstep matches both in a sweep from large to small: a piece takes the
smallest gap that was passed and not taken, its successor in size. Every range is swept by a task; what is left of a gap
is swept again if its size is still ahead in the range. Pieces that only earlier ranges have gaps for and gaps that only
later ranges have pieces for stay loose; they are numbered in order, and how many each range has (one row a range) says
which rank of one range meets which rank of another. Ranks settle conflicts: a loose gap takes one piece, a piece one gap.
Gaps are updated, and the next superstep sorts anew, until no piece is left.

New sequences are opened when pieces are longer than every gap: as many as those pieces need at least. Pieces that fill a
sequence are placed at once. Short pieces (up to ``1 / SHORT`` of a sequence) of one length that a task reads one after
another are first bundled to twice that size at most, so a sequence takes few items and supersteps stay few: a sequence
takes one item in each.

Null texts count as empty ones; an empty document is one piece holding only the closing id. Repeated doc_ids are
packed row by row. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.llm.common import chunks, discard, keyed_text, partitions, table, written
from concordat.llm.units import Units

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
GAP, PIECE, PLACED = 0, 1, 2
SHORT, RANGE = 32, 1 << 15
SWEPT = "kind int, id long, size long, gap long, room long, range long, nth long"
# Other characters, or the string of a special token, can make normalising or splitting reach across a unit's border.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-įĲ-ɏ–—‘-„…€]|<[|]")
_SUSPECT = np.zeros(256, bool)
_SUSPECT[:32] = _SUSPECT[127] = _SUSPECT[0xC2] = _SUSPECT[0xC4] = _SUSPECT[0xC9:] = True
_SUSPECT[[9, 10, 13]] = False


class UnitCache:
    """Token ids of texts, as packed little-endian 32-bit integers.

    The tokenizer never merges across white space or between a letter and a mark, so a unit (:mod:`concordat.llm.units`)
    always has the same ids: each goes through the library when a worker first meets it. A text with an unusual character
    goes through the library whole. ``keep`` units are held at most.
    """

    def __init__(self, path: str, keep: int = 150_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.keep = Tokenizer.from_file(path), {}, keep
        self.folds = bool(self.tokenizer.normalizer) and self.tokenizer.normalizer.normalize_str("ABC") == "abc"

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def each(self, units: list[bytes]) -> list[bytes]:
        """Of many units in one call; the library's offsets tell whose each id is."""
        out: list[bytes] = []
        for at in range(0, len(units), 4096):
            some = [u.decode() for u in units[at : at + 4096]]
            coded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, starts = np.asarray(coded.ids, "<u4"), np.fromiter((o[0] for o in coded.offsets), np.int64, len(coded.ids))
            ends = np.cumsum([len(c) + 1 for c in some])
            cuts = np.searchsorted(starts, ends).tolist()
            out += [ids[i:j].tobytes() for i, j in zip([0, *cuts], cuts, strict=False)]
        return out

    def of_units(self, units: list[bytes]) -> list[bytes]:
        known = self.known
        bare = [u.strip(b" \t\n\r").lower() if self.folds else u.strip(b" \t\n\r") for u in units]
        new = [u for u in dict.fromkeys(bare) if u not in known]
        if len(known) + len(new) > self.keep:
            for u in list(islice(known, self.keep // 2, None)):  # the first to be met are the most common
                del known[u]
            new = [u for u in dict.fromkeys(bare) if u not in known]
        own = dict(zip(new, self.each(new), strict=True))
        out = [known[u] if u in known else own[u] for u in bare]
        known |= {u: ids for u, ids in islice(own.items(), max(0, self.keep - len(known))) if len(u) <= 64}
        return out

    def __call__(self, texts: pa.Array) -> Iterator[memoryview]:
        """The ids of each text."""
        found = Units(texts, leading=False)
        raw = found.raw
        suspect = np.flatnonzero(_SUSPECT[raw] | np.append((raw[:-1] == 60) & (raw[1:] == 124), False)[: len(raw)])
        many = np.diff(np.append(0, np.searchsorted(suspect, found.ends))).tolist()
        unusual = [bool(n) and bool(UNUSUAL.search(t.as_py())) for n, t in zip(many, texts, strict=True)]
        if any(unusual):
            found = Units(pa.array(["" if u else t.as_py() for u, t in zip(unusual, texts, strict=True)], pa.string()), leading=False)
        ids, at = found.joined(self.of_units(found.different))
        for i, u in enumerate(unusual):
            yield memoryview(self.whole(texts[i].as_py())) if u else ids[at[i] : at[i + 1]]


@cache
def unit_cache(path: str) -> UnitCache:
    """Kept by the worker for later tasks."""
    return UnitCache(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The pieces of every document: its ids and a closing 0, cut only where they exceed ``capacity``; and the item each is part of."""
    short = capacity // SHORT

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = unit_cache(tokenizer)
        item = TaskContext.get().partitionId() << 40
        open_items: dict[int, tuple[int, int]] = {}
        for batch in chunks(batches, max_bytes=4 << 20):
            rows: list[list] = [[], [], [], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                ids = bytes(ids) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    own, within = open_items.pop(n, (item, 0))
                    item += not within
                    if within + 2 * n <= 2 * short:
                        open_items[n] = own, within + n
                    for column, value in zip(rows, (doc, k, at // 4, n, zlib.crc32(part), own, within), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "item", "within"])

    return keyed_text(docs, key, text).mapInArrow(cut, f"{PIECES}, item long, within long")


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches the gaps and pieces of each range, largest first; see ``SWEPT``.

    A row for each piece, placed or loose, and for each gap that is left. Loose pieces are numbered in order of size, largest
    first, and so are loose gaps; what is left of a gap that took a piece and passed the range's end has no number.
    """
    passed: list[tuple[int, int]] = []  # (id, size), the smallest last
    ahead: list[tuple[int, int]] = []  # heap of (-size, id)
    out: list[list] = [[] for _ in range(7)]
    own, loose = None, 0

    def put(*row: int | None) -> None:
        for column, value in zip(out, row, strict=True):
            column.append(value)

    def end() -> None:
        for nth, (i, size) in enumerate(passed):
            put(GAP, i, size, None, None, own, nth)
        for size, i in ahead:
            put(GAP, i, -size, None, None, own, None)
        passed.clear()
        ahead.clear()

    def rows() -> pa.RecordBatch:
        kinds = (pa.int32(), *(pa.int64(),) * 6)
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["kind", "id", "size", "gap", "room", "range", "nth"])
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        for place, kind, i, size in zip(*(batch.column(c).to_pylist() for c in ("range", "kind", "id", "size")), strict=True):
            if place != own:
                end()
                own, loose = place, 0
            while ahead and -ahead[0][0] >= size:
                left, gap = heappop(ahead)
                passed.append((gap, -left))
            if kind == GAP:
                passed.append((i, size))
            elif passed:
                gap, room = passed.pop()
                put(PLACED, i, size, gap, room, None, None)
                if room > size:
                    heappush(ahead, (size - room, gap))
            else:
                put(PIECE, i, size, None, None, own, loose)
                loose += 1
        yield rows()
    end()
    yield rows()


def across(loose: dict[tuple[int, int], int]) -> tuple[list[tuple], list[tuple]]:
    """Which loose pieces meet which loose gaps, from how many each range has of either: runs (range, first, many, gap's range, gap's number), a run's gaps being numbered downwards.

    And what stays: (range, gaps that stay, pieces that were matched).
    """
    ranges = sorted({r for r, _ in loose})
    gaps: list[list[int]] = []
    runs, matched = [], {}
    for r in ranges:
        at, many = 0, loose.get((r, PIECE), 0)
        while at < many and gaps:
            of, left = gaps[-1]
            n = min(many - at, left)
            runs.append((r, at, n, of, left - 1))
            at += n
            gaps[-1][1] -= n
            if not gaps[-1][1]:
                gaps.pop()
        matched[r] = at
        if loose.get((r, GAP), 0):
            gaps.append([r, loose[r, GAP]])
    stay = dict(map(tuple, gaps))
    return runs, [(r, stay.get(r, 0), matched[r]) for r in ranges]


def needed(sizes: dict[int, int], capacity: int) -> int:
    """As many sequences as pieces of these sizes need at least."""
    return max(-(-sum(size * n for size, n in sizes.items()) // capacity), sum(n for size, n in sizes.items() if 2 * size > capacity))


def ranges(counts: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(kind, size, first range, ranges), from how many rows there are of each; a size that many share has several ranges to itself."""
    out, at, held = [], 0, 0
    for kind, size in sorted(counts, key=lambda c: (-c[1], c[0])):
        n = counts[kind, size]
        if held and held + n > RANGE:
            at, held = at + 1, 0
        many = -(-n // RANGE)
        out.append((kind, size, at, many))
        at, held = (at + many, 0) if many > 1 else (at, held + n)
    return out


def superstep(state: DataFrame, counts: dict[tuple[int, int], int]) -> DataFrame:
    """The next state (kind, id, size, gap, room): gaps and pieces that are left, and the items placed, with their gap and its room."""
    spark = state.sparkSession
    classes = ranges(counts)
    last = max(first + many for _, _, first, many in classes)
    sized = F.broadcast(spark.createDataFrame(classes, "kind int, size long, first long, many long"))  # two rows a size at most
    dealt = state.join(sized, ["kind", "size"]).withColumn("range", F.col("first") + F.pmod(F.xxhash64("id"), "many"))
    dealt = dealt.select("range", "kind", "id", "size").repartition(min(last, partitions(spark)), "range").sortWithinPartitions("range", F.desc("size"), "kind", "id")
    swept = written(dealt.mapInArrow(sweep, SWEPT), "swept")
    if last == 1:
        return swept.drop("range", "nth")
    loose = swept.where("nth IS NOT NULL")
    found = {(r["range"], r["kind"]): r["count"] for r in loose.groupBy("range", "kind").count().collect()}  # two rows a range
    runs, stay = across(found)
    stays = F.broadcast(spark.createDataFrame(stay, "range long, gaps long, met long"))  # one row a range
    runs = F.broadcast(spark.createDataFrame(runs, "range long, first long, many long, of long, number long"))  # two rows a range at most
    late = loose.where(F.col("kind") == PIECE).join(runs, "range").where("nth >= first AND nth < first + many")
    late = late.select("id", "size", F.col("of").alias("range"), (F.col("number") - F.col("nth") + F.col("first")).alias("nth"))
    late = late.join(loose.where(F.col("kind") == GAP).select("range", "nth", F.col("id").alias("gap"), F.col("size").alias("room")), ["range", "nth"])
    none = F.lit(None).cast("long")
    entries = F.array(
        F.struct(F.lit(PLACED).alias("kind"), F.col("id").alias("id"), F.col("size").alias("size"), F.col("gap").alias("gap"), F.col("room").alias("room")),
        F.struct(F.lit(GAP).alias("kind"), F.col("gap").alias("id"), (F.col("room") - F.col("size")).alias("size"), none.alias("gap"), none.alias("room")))
    after = late.select(F.explode(entries).alias("e")).select("e.*").where("size > 0")
    left = loose.join(stays, "range").where(F.when(F.col("kind") == GAP, F.col("nth") < F.col("gaps")).otherwise(F.col("nth") >= F.col("met")))
    columns = ("kind", "id", "size", "gap", "room")
    out = written(swept.where("nth IS NULL").select(*columns).unionByName(after).unionByName(left.select(*columns)), "superstep")
    discard(swept)
    return out


def placed(items: DataFrame, capacity: int) -> DataFrame:
    """(item, sequence_id, at) for ``items`` (item, size). Sequences of one full item are numbered below 0."""
    spark = items.sparkSession
    out = items.where(F.col("size") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("at"))
    none = F.lit(None).cast("long")
    state = written(items.where(F.col("size") < capacity).select(F.lit(PIECE).alias("kind"), F.col("item").alias("id"), "size", none.alias("gap"), none.alias("room")), "superstep")
    opened = 0
    while True:
        counts = {(r["kind"], r["size"]): r["count"] for r in state.where(F.col("kind") != PLACED).groupBy("kind", "size").count().collect()}  # two rows a size at most
        if not any(kind == PIECE for kind, _ in counts):
            return out
        widest = max((size for kind, size in counts if kind == GAP), default=0)
        fresh = needed({size: n for (kind, size), n in counts.items() if kind == PIECE and size > widest}, capacity)
        state = state.where(F.col("kind") != PLACED)
        if fresh:
            state = state.unionByName(spark.range(opened, opened + fresh).select(F.lit(GAP).alias("kind"), "id", F.lit(capacity).cast("long").alias("size"), none.alias("gap"), none.alias("room")))
            counts[GAP, capacity] = counts.get((GAP, capacity), 0) + fresh
            opened += fresh
        state = superstep(state.select("kind", "id", "size"), counts)
        out = out.unionByName(state.where(F.col("kind") == PLACED).select(F.col("id").alias("item"), F.col("gap").alias("sequence_id"), (capacity - F.col("room")).alias("at")))


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Places the pieces. ``cut`` must be a written table: it is read for the items and again for the placing."""
    items = cut.groupBy("item").agg(F.sum("length").alias("size"))
    found = placed(items, capacity)
    return cut.join(found, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", (F.col("at") + F.col("within")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(written(pieces(docs, tokenizer, capacity), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
