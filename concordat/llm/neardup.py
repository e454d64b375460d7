"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is the hashes (64 bits) of its distinct word shingles; its sketch the ``K`` smallest of them. Documents
with equal sets are one class from then on, however many copies there are. Inverted lists of the retained values
generate overlaps: values are ordered rarest first, and two sketches that overlap in ``t`` values share one of their
first ``K - t + 1``, so only those enter the lists and common values never do for documents that hold rarer ones. A
value counts for a document only if another one that holds it has a set of a size that can be similar; by chance shared
values of texts of other lengths, which grow faster than the corpus, name no list.
``t`` is exact while sketches hold whole sets; beyond, similar documents overlap in fewer than ``LEAST`` of 64 values with
a chance of up to 4.3e-6 at a similarity of 0.8, if one set is inside the other.

Lists are worked off in turns, none of which emits the pairs of a list. In ``rounds`` leader turns every document meets
one member of one of its lists, the leader; what that links is one component and needs no comparison inside. The last
turn compares, in every list that still joins several components, the members outside the largest one with all members.
A turn has two steps (:func:`matched`). The first moves sketches: where the sketch of the union puts a document's
similarity with a partner of another component ``SLACK`` below the threshold or more, the document is out; it says which
documents have partners left, not which pairs. The second moves the full sets of those documents only, decides exactly,
and emits the links that join components. Both deal a list in blocks of bounded size, so that a list that holds a third
of all documents is many tasks and no task holds it whole; a document on both sides of a block is moved there once.

Words are split at ASCII white space, A-Z are lowered. A text with fewer words than a shingle is one shingle; without
words (or null) it is empty and linked with nothing. Repeated rows of one doc_id are judged by the smallest of their sets
(by hash) and come back once. An empty table gives an empty result.

Rows without a doc_id are documents of their own, one for each different text. They stand, and come back, under a number
of 2^62 or more that a hash of the text gives (:func:`numbered`), so that smaller ids are kept before them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concordat.llm.common import chunks, discard, grouped, keyed_text, partitions, small, table, written
from concordat.llm.components import connected
from concordat.llm.hashing import BYTE, mix, powers, prefix

K, LEAST, SLACK = 64, 36, 0.2
BANDS = 15
#: Rows of sketches, and shingles of full sets, on either side of a block.
SKETCH_BLOCK, SET_BLOCK = (512, 1024), (1 << 16, 1 << 17)
SKETCHES = "doc_id long, n long, hi long, lo long, sketch array<long>"
_FOLDED = BYTE.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def numbered(key: str = "doc_id", text: str = "text") -> Column:
    """The id that a row is judged under; it is never null."""
    low = F.lit(2**62 - 1).cast("long")
    return F.coalesce(F.col(key).cast("long"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).bitwiseAND(low).bitwiseOR(F.lit(2**62).cast("long")))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    total, down = prefix(_FOLDED[raw]), powers(len(raw) + 1)[1]
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    word = mix((total[ends] - total[starts]) * down[starts])
    first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    rolled = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for j in range(words):
        rolled = mix(rolled * np.uint64(0x2545F4914F6CDD1D) + word[j : len(word) - words + 1 + j])
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= words:
            out.append(np.unique(rolled[i : j - words + 1].view(np.int64)))
        elif j > i:
            one = np.array([j - i], np.uint64)
            for h in word[i:j]:
                one = mix(one * np.uint64(0x2545F4914F6CDD1D) + h)
            out.append(one.view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def _named(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    m = mix(s.view(np.uint64) + np.uint64(1))
    return tuple(np.array([m.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(m), initial=np.uint64(0))]).view(np.int64).tolist())


def sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets([t.as_py() for t in batch.column("text").cast(pa.binary())], words)
            names = np.array([_named(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([s[:K] for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "hi", "lo", "sketch"])

    return docs.mapInArrow(run, SKETCHES)


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, payload): the sets named in ``wanted`` (rep, hi, lo), read from the texts again. Texts are moved only if the names are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets([t.as_py() for t in batch.column("text").cast(pa.binary())], words)
            named = zip(batch.column("hi").to_pylist(), batch.column("lo").to_pylist(), strict=True)
            at = [i for i, (s, name) in enumerate(zip(sets, named, strict=True)) if _named(s) == name]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array([sets[i] for i in at], pa.list_(pa.int64()))], names=["rep", "payload"])

    found = docs.join(small(wanted.withColumnRenamed("rep", "doc_id")), "doc_id").select("doc_id", "hi", "lo", "text").mapInArrow(run, "rep long, payload array<long>")
    return found.groupBy("rep").agg(F.first("payload").alias("payload"))  # repeated rows


def _band(percent: int) -> Column:
    """Which of ``BANDS`` rings of sizes n is in; sizes that can be similar are in one band or in neighbours, as bands are a little wider than need be."""
    return F.pmod(F.floor(F.ln("n") / (math.log(100 / percent) + 0.01)), F.lit(BANDS)).cast("int")


def inverted(reps: DataFrame, percent: int) -> DataFrame:
    """(list, rep, n): the lists, named by their value, that similar documents meet in."""
    values = reps.select("rep", "n", F.explode("sketch").alias("list"))
    sizes = F.try_sum(F.expr("shiftleft(1L, 4 * band)"))  # four bits a band: right for up to 15 documents, looked at for no more
    shared = values.withColumn("band", _band(percent)).groupBy("list").agg(F.count("*").alias("df"), sizes.alias("sizes")).where("df > 1")
    near = " + ".join(f"(shiftright(sizes, 4 * pmod(band + {d}, {BANDS})) & 15)" for d in (-1, 0, 1))
    met = values.join(shared, "list").withColumn("band", _band(percent)).where(f"df > 15 or {near} > 1")
    held = met.groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "list"))).alias("rare"))
    t = F.when(F.col("n") * 100 <= K * percent, F.ceil(F.col("n") * percent / 100)).otherwise(LEAST)
    length = (F.size("rare") - t + 1).cast("int")  # values that no similar one can hold come first and take up the rest
    kept = held.where(length > 0).select("rep", "n", F.explode(F.slice("rare", 1, length)).alias("r"))
    return kept.select(F.col("r.list").alias("list"), "rep", "n")


def _near(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def dealt(rows: DataFrame, weight: Column, block: tuple[int, int]) -> DataFrame:
    """A row for every group ``g`` it belongs to: a block of the left and a block of the right rows of a list, each of about that weight."""
    side = lambda name: F.sum(F.when(F.col(name), weight).otherwise(0))
    total = rows.groupBy("list").agg(F.ceil(side("left") / block[0]).alias("lb"), F.ceil(side("right") / block[1]).alias("rb"))
    split = written(total.where("lb > 1 or rb > 1"), "blocks")
    blocks = {c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).cast("long") for c in ("lb", "rb")}
    rows = rows.join(split, "list", "left").withColumns(blocks)
    rows = rows.withColumns({"l": F.pmod(F.xxhash64("rep"), "lb"), "r": F.pmod(F.xxhash64("rep"), "rb")})
    cell = lambda l, r: F.struct(l.alias("l"), r.alias("r"))  # noqa: E731, E741
    none = F.array().cast("array<struct<l: bigint, r: bigint>>")
    as_left = F.when(F.col("left"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("rb") - 1), lambda r: cell(F.col("l"), r))).otherwise(none)
    as_right = F.when(F.col("right"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("lb") - 1), lambda l: cell(l, F.col("r")))).otherwise(none)  # noqa: E741
    as_right = F.filter(as_right, lambda x: ~F.col("left") | (x["l"] != F.col("l")))  # the cell of its own left block is there already
    rows = rows.withColumn("cell", F.explode(F.concat(as_left, as_right)))
    sides = {"left": F.col("left") & (F.col("cell.l") == F.col("l")), "right": F.col("right") & (F.col("cell.r") == F.col("r"))}
    return rows.withColumns(sides | {"g": F.xxhash64("list", "cell.l", "cell.r")}).drop("lb", "rb", "l", "r", "cell")


class Side:
    """One side of a group: ids, set sizes, components, and the payloads laid end to end."""

    def __init__(self, group: list[pa.RecordBatch], left: bool) -> None:
        parts = [b.filter(b.column("left" if left else "right")) for b in group]
        parts = [p for p in parts if p.num_rows]
        self.rep, self.n, self.component, self.list = (np.concatenate([p.column(c).to_numpy() for p in parts] or [np.empty(0, np.int64)]) for c in ("rep", "n", "component", "list"))
        self.size = np.concatenate([pa.compute.list_value_length(p.column("payload")).to_numpy() for p in parts] or [np.empty(0, np.int64)]).astype(np.int64)
        self.value = np.concatenate([p.column("payload").flatten().to_numpy() for p in parts] or [np.empty(0, np.int64)])
        self.start = np.append(0, np.cumsum(self.size))

    def payload(self, i: int) -> np.ndarray:
        return self.value[self.start[i] : self.start[i + 1]]

    def index(self) -> Side:
        """Sorted values with their owners and their places in the owner's payload."""
        owner = np.repeat(np.arange(len(self.rep)), self.size)
        place = np.arange(len(self.value)) - self.start[owner]
        order = np.argsort(self.value, kind="stable")
        self.sorted, self.owner, self.place = self.value[order], owner[order], place[order]
        return self

    def overlaps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many values of x each row holds, and the range of each value of x in the index."""
        lo, hi = np.searchsorted(self.sorted, x, "left"), np.searchsorted(self.sorted, x, "right")
        n = hi - lo
        at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.rep)), lo, hi


def _reachable(left: Side, i: int, right: Side, percent: int) -> np.ndarray:
    return (right.component != left.component[i]) & (np.minimum(right.n, left.n[i]) * 100 >= np.maximum(right.n, left.n[i]) * percent)


def estimated(group: list[pa.RecordBatch], percent: int) -> tuple[np.ndarray, ...]:
    """(list, rep, left) of the rows with a partner of another component that the sketch of the union doesn't reject."""
    left, right = Side(group, True), Side(group, False).index()
    share = percent / 100 - SLACK
    sound_left, sound_right = np.zeros(len(left.rep), bool), np.zeros(len(right.rep), bool)
    for i in range(len(left.rep)):
        x = left.payload(i)
        both, lo, hi = right.overlaps(x)
        whole = np.maximum(right.n, left.n[i]) <= K
        union = np.minimum(K, len(x) + right.size - both)
        ok = _reachable(left, i, right, percent) & np.where(whole, 100 * both >= percent * (len(x) + right.size - both), both >= share * union)
        if (ok & ~whole).any():  # of the common values only those count that are among the K smallest of the union
            met, inside = np.zeros(len(right.rep), np.int32), np.zeros(len(right.rep), np.int32)
            for place in np.flatnonzero(hi > lo).tolist():
                some = slice(lo[place], hi[place])
                y = right.owner[some]
                met[y] += 1
                inside[y] += place + right.place[some] + 2 - met[y] <= K
            ok &= whole | (inside >= share * union)
        sound_left[i] = ok.any()
        sound_right |= ok
    return tuple(np.concatenate([left_part[sound_left], right_part[sound_right]]) for left_part, right_part in ((left.list, right.list), (left.rep, right.rep), (np.ones(len(left.rep), bool), np.zeros(len(right.rep), bool))))


def linking(group: list[pa.RecordBatch], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of similar documents, as many as join the components of the group."""
    left, right = Side(group, True), Side(group, False).index()
    parent: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = c = parent.get(up, up)
        return c

    a, b = [], []
    for i in range(len(left.rep)):
        x = left.payload(i)
        both, _, _ = right.overlaps(x)
        ok = _reachable(left, i, right, percent) & (100 * both >= percent * (len(x) + right.size - both))
        for j in np.flatnonzero(ok).tolist():
            p, q = find(int(left.component[i])), find(int(right.component[j]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(left.rep[i])
                b.append(right.rep[j])
    return np.array(a, np.int64), np.array(b, np.int64)


def _by_group(rows: DataFrame, kernel: Callable, percent: int, names: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "g"):
            yield pa.record_batch([pa.array(c) for c in kernel(group, percent)], names=names)

    spark = rows.sparkSession
    return rows.repartition(partitions(spark), "g").sortWithinPartitions("g").mapInArrow(run, schema)


def matched(rows: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links between left and right rows (list, left, right, rep, n, component) of the same list, enough to join all similar ones."""
    rows = written(rows, "rows")
    columns = ["g", "list", "left", "right", "rep", "n", "component", "payload"]
    sketched = dealt(rows, F.lit(1), SKETCH_BLOCK).join(reps.select("rep", F.col("sketch").alias("payload")), "rep").select(*columns)
    kept = _by_group(sketched, estimated, percent, ["list", "rep", "left"], "list long, rep long, left boolean")
    kept = kept.groupBy("list", "rep").agg(F.bool_or("left").alias("left"), F.bool_or(~F.col("left")).alias("right"))
    sound = written(kept.join(rows.drop("left", "right"), ["list", "rep"]), "estimated")
    wanted = written(sound.select("rep").distinct().join(reps.select("rep", "hi", "lo"), "rep"), "wanted")
    full = dealt(sound, F.col("n"), SET_BLOCK).join(full_sets(docs, wanted, words), "rep").select(*columns)
    links = written(_by_group(full, linking, percent, ["a", "b"], "a long, b long").distinct(), "links")
    discard(rows, sound, wanted)
    return links


def by_leaders(now: DataFrame, turn: int, percent: int) -> DataFrame:
    """Rows for :func:`matched`: every document with the leader of the longest of its lists that is led by another component."""
    order = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    leaders = now.groupBy("list").agg(F.min_by(F.struct("rep", "n", "component"), order).alias("l"), F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y"))
    leaders = leaders.where("x <> y").select("list", F.col("l.rep").alias("l_rep"), F.col("l.n").alias("l_n"), F.col("l.component").alias("l_component"), "size")
    pairs = now.join(leaders, "list").where((F.col("component") != F.col("l_component")) & _near("n", "l_n", percent))
    chosen = pairs.groupBy("rep", "n", "component").agg(F.max_by(F.struct("l_rep", "l_n", "l_component"), F.struct("size", "list")).alias("l"))
    chosen = written(chosen.select("rep", "n", "component", "l.*"), "leaders")
    members = chosen.select(F.col("l_rep").alias("list"), F.lit(False).alias("left"), F.lit(True).alias("right"), "rep", "n", "component")
    return members.unionByName(chosen.select(F.col("l_rep").alias("list"), F.lit(True).alias("left"), F.lit(False).alias("right"), F.col("l_rep").alias("rep"), F.col("l_n").alias("n"), F.col("l_component").alias("component")).distinct())


def by_lists(now: DataFrame) -> DataFrame:
    """Rows for :func:`matched`: in lists of several components the members outside the largest one on the left, all on the right.

    Of lists with the same members one is enough.
    """
    sizes = now.groupBy("list", "component").agg(F.count("*").alias("size"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sign"))
    whole = sizes.groupBy("list").agg(F.count("*").alias("components"), F.sum("size").alias("all"), F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("sign").alias("sign"))
    mixed = whole.where("components > 1").groupBy("all", "sign").agg(F.min(F.struct("list", "main")).alias("v")).select("v.list", "v.main")
    held = now.join(written(mixed, "mixed-lists"), "list")
    return held.select("list", (F.col("component") != F.col("main")).alias("left"), F.lit(True).alias("right"), "rep", "n", "component")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rounds: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of 100 * intersection >= percent * union."""
    docs = keyed_text(docs, key, text).withColumn("doc_id", numbered())
    sets = written(sketches(docs, words), "sketches")
    one = written(sets.groupBy("doc_id").agg(F.min(F.struct("hi", "lo", "n")).alias("s")).select("doc_id", "s.*"), "names")
    classes = written(one.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep")), "classes")
    by_set = sets.where("n > 0").groupBy("hi", "lo", "n").agg(F.first("sketch").alias("sketch"))
    reps = written(by_set.join(classes, ["hi", "lo", "n"]).select("rep", "n", "hi", "lo", "sketch"), "sketches-of-classes")
    discard(sets)
    lists = written(inverted(reps, percent), "lists")
    found, labels = None, None
    for turn in range(rounds + 1):
        now = lists.withColumn("component", F.col("rep"))
        if labels is not None:
            now = lists.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("list", "rep", "n", F.coalesce("component", "rep").alias("component"))
        links = matched(by_leaders(now, turn, percent) if turn < rounds else by_lists(now), reps, docs, words, percent)
        found = links if found is None else found.unionByName(links)
        labels = connected(found)
    discard(reps, lists)
    of_rep = classes.join(labels, classes.rep == labels.node, "left").select("hi", "lo", "n", F.coalesce("component", "rep").alias("component_id"))
    out = one.select("doc_id", "hi", "lo", "n").join(of_rep, ["hi", "lo", "n"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
