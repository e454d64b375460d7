"""CSV files with quoted line ends, read in parallel: where records begin is found first, Spark's ``from_csv`` parses them.

Files are scanned by Spark's text source in blocks, a row a physical line. Whether a line begins a record depends on all
lines before it, but only by one bit: whether a quoted field is open. So a first pass says for every block how it would end,
and how many records would begin in it, for both values of that bit; running over blocks (a row each) gives every block
its true bit and first record number. The second pass joins lines to records: whole ones inside a block, and pieces of those
that cross blocks, which then meet by record number. Records keep their place in the file whatever the blocks.

What opens and closes a field is what Spark's own reader takes for it, with ``"`` as quote and escape: a quote opens a
field only at its start; inside, two are one; one that neither another nor a delimiter follows leaves the rest of the
field unquoted. Lines end with LF or CR LF; blank lines between records don't count. A quoted field that is never closed
runs to the end of its file, as one record. A byte order mark is dropped. Every file of a folder begins with a header.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCKS = "file string, start long, bare_open boolean, bare_records long, open_open boolean, open_records long, head string"
PIECES = "file string, record long, start long, whole boolean, text string"
#: A line's complete fields from the start of one, up to a field that stays open; and from inside an open field to what follows it.
_FIELDS = re.compile(r'(?:(?:"(?:[^"]|"")*"(?!")[^,]*|[^",][^,]*|(?=,)),)*+(?P<open>"(?:[^"]|"")*+\Z)?', re.DOTALL)
_CLOSE = re.compile(r'(?:[^"]|"")*+"(?P<rest>[^,]*,?)', re.DOTALL)


def still_open(line: str, open_: bool) -> bool:
    """Whether a quoted field is open after ``line``, given whether one was before it."""
    if '"' not in line:
        return open_
    if open_:
        closed = _CLOSE.match(line)
        if not closed:
            return True
        if not closed["rest"].endswith(","):
            return False
        line = line[closed.end() :]
    return _FIELDS.match(line)["open"] is not None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        for line, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start")), strict=True):
            yield file, start, line.removeprefix("﻿") if start == 0 else line


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: a row for every block; ``head`` is the file's first record, if the block holds all of it."""
    found: dict[tuple[str, int], list] = {}
    for file, start, line in _by_block(batches):
        ends = found.setdefault((file, start), [False, 0, True, 0, None, []])
        blank = line in ("", "\r")
        for k in (0, 2):
            if not ends[k] and not blank:
                ends[k + 1] += 1
            if not (blank and not ends[k]):
                ends[k] = still_open(line, ends[k])
        if start == 0 and ends[4] is None and ends[1]:
            ends[5].append(line)
            if not ends[0]:
                ends[4] = "\n".join(ends[5]).removesuffix("\r")
    rows = [(*key, *ends[:5]) for key, ends in found.items()]
    yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.string()))], names=[c.split()[0] for c in BLOCKS.split(", ")])


class Layout:
    """Where every block begins, and how many records and what header every file has; found in one pass."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.lines = _lines(spark, path)
        self.begins: dict[tuple[str, int], tuple[bool, int]] = {}
        self.records: dict[str, int] = {}
        self.heads: dict[str, str | None] = {}
        open_ = False
        for b in sorted(self.lines.mapInArrow(_outlined, BLOCKS).collect(), key=lambda b: (b["file"], b["start"])):  # a row a block of spark.sql.files.maxPartitionBytes
            number = self.records.get(b["file"], 0)
            open_ = open_ and b["file"] in self.records
            self.begins[b["file"], b["start"]] = (open_, number)
            self.heads.setdefault(b["file"], b["head"])
            self.records[b["file"]] = number + (b["open_records"] if open_ else b["bare_records"])
            open_ = b["open_open"] if open_ else b["bare_open"]


def records(layout: Layout) -> DataFrame:
    """(file, record, text) of every record, headers too; numbers count from 0 in each file."""
    begins = layout.begins

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Second pass: records and pieces of them, some thousands at a time."""
        out: list[tuple] = []
        held: list[str] = []
        at, inside, number, whole = None, False, 0, True

        def put(done: bool) -> None:
            out.append((*at, number, whole and done, "\n".join(held)))
            held.clear()

        for file, start, line in _by_block(batches):
            if (file, start) != at:
                if held:
                    put(False)
                at = (file, start)
                inside, number = begins[at]
                number, whole = number - 1, not inside  # an open record is the one before the block's first
            if not inside:
                if line in ("", "\r"):
                    continue
                number, whole = number + 1, True
            inside = still_open(line, inside)
            held.append(line)
            if not inside:
                put(True)
                if len(out) >= 4096:
                    yield _pieces(out)
                    out = []
        if held:
            put(False)
        yield _pieces(out)

    pieces = layout.lines.mapInArrow(assembled, PIECES)
    crossing = pieces.where("NOT whole").groupBy("file", "record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "\n").alias("text"))
    both = pieces.where("whole").select("file", "record", "text").union(crossing.select("file", "record", "text"))
    return both.select("file", "record", F.regexp_replace("text", "\r\\z", "").alias("text"))


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    file, start, record, whole, text = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.record_batch([pa.array(file, pa.string()), pa.array(record, pa.int64()), pa.array(start, pa.int64()), pa.array(whole, pa.bool_()), pa.array(text, pa.string())], names=[c.split()[0] for c in PIECES.split(", ")])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all records under the header, as strings, null where a record is short, with ``row_idx``: the record's number among those of all files, by path."""
    layout = Layout(spark, path)
    found = records(layout)
    names: list[str] = []
    if any(layout.records.values()):
        file = min(f for f, n in layout.records.items() if n)
        head = layout.heads[file]
        if head is None:  # a header that is longer than a block
            head = found.where((F.col("record") == 0) & (F.col("file") == file)).first()["text"]
        names = next(csv.reader([head]))
    base, first = 0, []
    for file, n in sorted(layout.records.items()):
        first.append((file, base))
        base += max(n - 1, 0)
    files = F.broadcast(spark.createDataFrame(first, "file string, first long"))  # a row a file
    body = found.where("record > 0").join(files, "file")
    number = (F.col("first") + F.col("record") - 1).alias("row_idx")
    if not names:
        return body.select(number)
    cells = ", ".join(f"c{k} string" for k in range(len(names)))
    parsed = F.from_csv("text", cells, {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    return body.select(parsed.alias("c"), number).select(*(F.col(f"c.c{k}").alias(n) for k, n in enumerate(names)), "row_idx")
