"""Byte-level BPE by recursive queries, and decoding by ordered aggregation.

A text is split by the vocabulary's pattern; each match is a word that is encoded separately. Every task hands the words
it has not met yet to an in-process DuckDB: a row is a token at its position in a word, with its successor. The
recursive step joins these pairs with the merge table (two ids and the id of their concatenation, which is its rank),
contracts the leftmost pair of least rank of every word, and ends when no word has a pair left. Ids are an ordered
aggregate of a word's last step. Decoding joins the ids of a document with the tokens and concatenates them in order, by
an ordered aggregate too.

The steps of a word are about half the square of its length in rows, so words go through DuckDB in batches whose squares
are bounded. A word of more than ``WHOLE`` bytes is cut first, at the places that no occurrence of a token spans: no merge
ever crosses them, so the parts are encoded each for itself. What is still longer than ``LONGEST`` (one letter repeated)
would take a turn of all its rows for each merge; it runs through the same contraction with a heap.

Null texts count as empty ones; an empty text has no ids. Whole texts are encoded; a lone surrogate can't occur in a
Parquet string. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import tempfile
from collections.abc import Iterator
from functools import cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession

from concordat.llm.common import chunks, keyed_text, table
from concordat.llm.units import Units

WHOLE, LONGEST = 64, 256
#: Of the words of a recursive query the sum of squared lengths; of a decoding query the ids.
SQUARES, DECODED = 3_000_000, 1_000_000
ENCODED = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

ENCODE_SQL = """
WITH RECURSIVE step AS (
  SELECT w, pos, after, tok, next, m.id, 0 AS turn FROM words LEFT JOIN merges m ON m.pair = ((tok << 16) | next)
  UNION ALL
  (WITH best AS (SELECT w, min((id::BIGINT << 28) | pos) AS least FROM step WHERE id IS NOT NULL GROUP BY w),
   cut AS (
     SELECT b.w, b.least >> 28 AS made, l.pos AS at, r.pos AS gone, r.after, r.next
     FROM best b JOIN step l ON l.w = b.w AND l.pos = (b.least & 268435455) JOIN step r ON r.w = l.w AND r.pos = l.after),
   moved AS (
     SELECT s.w, s.pos, s.turn + 1 AS turn,
       CASE WHEN s.pos = c.at THEN c.after ELSE s.after END AS after,
       CASE WHEN s.pos = c.at THEN c.made ELSE s.tok END AS tok,
       CASE WHEN s.pos = c.at THEN c.next WHEN s.after = c.at THEN c.made ELSE s.next END AS next
     FROM step s JOIN cut c ON s.w = c.w WHERE s.pos <> c.gone)
   SELECT v.w, v.pos, v.after, v.tok, v.next, m.id, v.turn FROM moved v LEFT JOIN merges m ON m.pair = ((v.tok << 16) | v.next))
)
SELECT s.w, list(s.tok ORDER BY s.pos) AS ids
FROM step s JOIN (SELECT w, max(turn) AS turn FROM step GROUP BY w) l ON s.w = l.w AND s.turn = l.turn
GROUP BY s.w ORDER BY s.w
"""
DECODE_SQL = """
SELECT c.w, list(t.token ORDER BY c.pos) AS tokens FROM coded c JOIN tokens t ON t.id = c.id GROUP BY c.w
"""


@cache
def ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def contract(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same contraction of one word, leftmost pair of least rank first, over linked tokens and a heap."""
    tokens: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(r, i, word[i : i + 1], word[i + 1 : i + 2]) for i in range(len(word) - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if tokens[i] != left or j >= len(word) or tokens[j] != right:
            continue
        tokens[i], tokens[j] = left + right, None
        after[i] = after[j]
        if after[i] < len(word):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(word) and (r := rank.get(tokens[a] + tokens[b])) is not None:
                heapq.heappush(heap, (r, a, tokens[a], tokens[b]))
    return [rank[t] for t in tokens if t is not None]


def _unicode_white(raw: np.ndarray) -> np.ndarray:
    """Bytes with which characters outside ASCII begin that the pattern may take for white space, and ASCII separators."""
    a, b = np.append(raw[1:], [0])[: len(raw)], np.append(raw[2:], [0, 0])[: len(raw)]
    out = (raw >= 28) & (raw <= 31) | (raw == 0xC2) & ((a == 0x85) | (a == 0xA0))
    return out | (raw == 0xE1) & ((a == 0x9A) | (a == 0xA0)) | (raw == 0xE2) & ((a == 0x80) | (a == 0x81)) & ((b < 0x90) | (b > 0xA6)) | (raw == 0xE3) & (a == 0x80) & (b == 0x80)


class Codec:
    """Units of text and their ids, encoded by DuckDB when first met. One to a Python worker; ``keep`` bounds the units it holds."""

    def __init__(self, path: str, pattern: str, keep: int = 250_000) -> None:
        import duckdb

        self.rank, self.pattern, self.keep = ranks(path), regex.compile(pattern), keep
        self.known: dict[bytes, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": tempfile.mkdtemp(prefix="bpe-")})
        pairs = [(self.rank[t[:i]] << 16 | self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        self._given(given=pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "id": pa.array([r for _, r in pairs], pa.int32())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given ORDER BY pair")
        self._given(given=pa.table({"id": pa.array(self.rank.values(), pa.int64()), "token": pa.array(list(self.rank), pa.binary())}))
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM given")
        self.single = np.array([self.rank[bytes([i])] for i in range(256)], dtype=np.int64)
        self.decimal = pa.array([b"%d," % i for i in range(max(self.rank.values()) + 1)], pa.large_binary())
        self.finder = None

    def _given(self, **tables: pa.Table) -> None:
        for name, rows in tables.items():
            self.db.register(name, rows)

    @staticmethod
    def _positions(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes)
        return np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes), ends

    def parts(self, word: bytes) -> list[bytes]:
        """The word, cut where no occurrence of a token spans the cut."""
        if self.finder is None:
            import ahocorasick

            self.finder = ahocorasick.Automaton()
            for t in self.rank:
                if len(t) > 1:
                    self.finder.add_word(t.decode("latin-1"), len(t))
            self.finder.make_automaton()
        spanned = np.zeros(len(word) + 1, np.int64)
        for end, size in self.finder.iter(word.decode("latin-1")):
            spanned[end - size + 2] += 1
            spanned[end + 1] -= 1
        cuts = [0, *(np.flatnonzero(np.cumsum(spanned)[1:-1] == 0) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as packed 32-bit integers."""
        cut = {w: self.parts(w) for w in words if len(w) > WHOLE}
        todo = list(dict.fromkeys([w for w in words if w not in cut] + [p for ps in cut.values() for p in ps]))
        out: dict[bytes, bytes] = {w: np.asarray(contract(w, self.rank), "<i4").tobytes() for w in todo if len(w) > LONGEST}
        todo = [w for w in todo if w not in out]
        sizes = np.array([len(w) for w in todo], np.int64)
        batch = np.cumsum(sizes * sizes) // SQUARES
        edges = np.flatnonzero(np.diff(batch, prepend=-1, append=-1)).tolist() if todo else [0]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            tok = self.single[np.frombuffer(b"".join(todo[i:j]), np.uint8)]
            w, pos, ends = self._positions(sizes[i:j])
            after = np.append(tok[1:], -1)
            after[ends - 1] = -1  # no token: joins with no pair
            self._given(words=pa.table({"w": w, "pos": pos, "after": pos + 1, "tok": tok, "next": after}))
            found = self.db.sql(ENCODE_SQL).to_arrow_table().column("ids").combine_chunks()
            ids = found.flatten().to_numpy().astype("<i4").tobytes()
            stops = (4 * np.cumsum(pa.compute.list_value_length(found).to_numpy())).tolist()
            out |= zip(todo[i:j], (ids[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True)
        return [b"".join([out[p] for p in cut[w]]) if w in cut else out[w] for w in words]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        """Of lists of ids laid end to end, a bounded number of ids at a time."""
        sizes = np.diff(ends, prepend=0)
        for some in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(ends // DECODED)) + 1) if len(sizes) else ():
            w, pos, _ = self._positions(sizes[some])
            part = ids[ends[some[0]] - sizes[some[0]] : ends[some[-1]]]
            self._given(coded=pa.table({"w": w, "pos": pos, "id": part.astype(np.int64)}))
            found = self.db.sql(DECODE_SQL).to_arrow_table()
            back = dict.fromkeys(range(len(some)), b"")
            at = 0
            for chunk in found.column("tokens").chunks:
                laid = chunk.flatten().cast(pa.large_binary())
                edge = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset : laid.offset + len(laid) + 1]
                stops = np.cumsum(pa.compute.list_value_length(chunk).to_numpy())
                data = memoryview(laid.buffers()[2])
                for n, (i, j) in enumerate(zip(np.append(0, stops[:-1]).tolist(), stops.tolist(), strict=True)):
                    back[found.column("w")[at + n].as_py()] = bytes(data[edge[i] : edge[j]])
                at += len(chunk)
            yield from (back[i] for i in range(len(some)))

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def of_units(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit, as packed 32-bit integers; of the words of new ones DuckDB gets those that are no known unit, once each."""
        known = self.known
        new = [u for u in units if u not in known]
        if len(known) + len(new) > self.keep:
            for u in list(islice(known, self.keep // 2, None)):  # the first to be met are the most common
                del known[u]
            new = [u for u in units if u not in known]
        split = [[w.encode() for w in self.split(u.decode())] for u in new]
        words = list(dict.fromkeys(w for s in split for w in s if w not in known))
        own = dict(zip(words, self.encode(words), strict=True))
        fresh = {u: b"".join([known[w] if w in known else own[w] for w in s]) for u, s in zip(new, split, strict=True)}
        out = [known[u] if u in known else fresh[u] for u in units]
        known |= {u: ids for u, ids in islice(fresh.items(), max(0, self.keep - len(known))) if len(u) <= WHOLE}
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, laid end to end, and where each text's end."""
        found = Units(texts, leading=True, whole=_unicode_white)
        packed, at = found.joined(self.of_units(found.different))
        return np.frombuffer(packed, "<i4")[: at[-1] // 4], np.array(at[1:]) // 4


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """Kept by the worker for later tasks."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in chunks(batches, max_bytes=4 << 20):
            ids, ends = own.ids(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return keyed_text(docs, key, text).mapInArrow(run, ENCODED)


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes of every list of ids; ids outside the vocabulary are an error of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            lists = batch.column("ids")
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            ids = lists.flatten().to_numpy()
            if len(ids) and (ids.min() < 0 or ids.max() >= len(own.decimal)):
                raise ValueError("an id is not in the vocabulary")
            yield pa.record_batch([batch.column("doc_id"), pa.array(own.decode(ids, np.cumsum(sizes)), pa.binary())], names=["doc_id", "bytes"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token counts and the digests of ids and of the bytes they decode to, without moving either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in chunks(batches, max_bytes=4 << 20):
            ids, ends = own.ids(batch.column("text"))
            laid = own.decimal.take(pa.array(ids))
            edge = np.frombuffer(laid.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
            written, at = memoryview(laid.buffers()[2] or b""), edge[np.append(0, ends)].tolist()
            coded = [hashlib.sha256(written[i : max(i, j - 1)]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]
            back = [hashlib.sha256(b).hexdigest() for b in own.decode(ids, ends)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(coded), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return keyed_text(docs).mapInArrow(run, DIGESTS)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
