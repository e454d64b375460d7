"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: every task writes gzip files of about ``roll`` bytes, one member a record, and each member says in its gzip
header (an extra field) how long it is. Files of tasks that failed or ran twice are not in the manifest that the commit
writes, and readers read what the manifest lists (any folder of ``*.warc.gz`` without one is read whole).

Reading: partitions are planned by file, large files alone and small ones together. Predicates on the record type and on
header fields are pushed into the reader. It inflates a record's headers first; a record that the predicates reject, and
any payload when the option ``payload`` is ``false``, is skipped by its length without being inflated.

Payloads are bytes, read whole however long they are; null counts as empty. Equal payloads of at least ``least`` bytes are archived once, with the record
of the smallest page_id; the others are revisits that name it. Identical repeated rows share a page_id and so its kind.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from concordat.llm.common import shared_dir, table

RECORDS = "record_type string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
COLUMNS = ("record_type", "page_id", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload")
MANIFEST = "_manifest.json"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def member(raw: bytes, level: int = 3) -> bytes:
    """One gzip member whose header holds its whole length and that of ``raw``."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + size.to_bytes(4, "little") + (len(raw) & 0xFFFFFFFF).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04" + bytes(6) + len(extra).to_bytes(2, "little") + extra + body + zlib.crc32(raw).to_bytes(4, "little") + (len(raw) & 0xFFFFFFFF).to_bytes(4, "little")


def record(row: dict, date: str) -> bytes:
    payload = row["payload"] or b""
    clean = (row["target_uri"] or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (payload if row["record_type"] == "response" else b"")
    head = [f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, roll: int) -> None:
        self.path, self.date, self.roll = path, date, roll

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    data = member(record(row, self.date))
                    out.write(data)
                    size += len(data)
                    if size >= self.roll:
                        out.close()
                        files.append((name, size))
                        out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _place(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                system.delete_file(f"{folder}/{name}")


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


def _matches(f: Filter, row: dict) -> bool:
    value = row[f.attribute[0]]
    if isinstance(f, EqualTo):
        return value is not None and value == f.value
    if isinstance(f, In):
        return value is not None and value in f.value
    if isinstance(f, StringStartsWith):
        return value is not None and value.startswith(f.value)
    return (value is None) == isinstance(f, IsNull)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, per_task: int) -> None:
        self.path, self.payload, self.per_task, self.filters = path, payload, per_task, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, IsNull, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in COLUMNS[:-1]:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, folder = _place(self.path)
        listing = f"{folder}/{MANIFEST}"
        if system.get_file_info(listing).type == fs.FileType.File:
            with system.open_input_stream(listing, compression=None) as f:
                files = [tuple(x) for x in json.loads(f.read())]
        else:
            files = [(i.base_name, i.size) for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.base_name.endswith(".warc.gz")]
        out, held, size = [], [], 0
        for name, n in sorted(files, key=lambda f: (-f[1], f[0])):
            if held and size + n > self.per_task:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(name)
            size += n
        return [*out, *([Files(tuple(held))] if held else [])] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, folder = _place(self.path)
        schema = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for name in partition.names:
            with system.open_input_file(f"{folder}/{name}") as f:
                for row in self._records(f):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _records(self, f: pa.NativeFile) -> Iterator[dict]:
        end, at = f.size(), 0
        while at < end:
            f.seek(at)
            start = f.read(4096)
            if start[:2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at byte {at}")
            known = int.from_bytes(start[16:20], "little") if start[3] & 4 and start[12:14] == b"sl" else None
            packed, unpack = start[:known] if known else start, zlib.decompressobj(31)
            raw = unpack.decompress(packed, 2048)
            while b"\r\n\r\n" not in raw or b"\r\n\r\n" not in raw[raw.index(b"\r\n\r\n") + 4 :]:
                more = unpack.unconsumed_tail or f.read(4096)
                if not more and not unpack.eof:
                    raise ValueError(f"record at byte {at} ends early")
                if unpack.eof:
                    break
                raw += unpack.decompress(more, 2048)
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            http = rest.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]
            number = lambda urn: int(urn[10:-1]) if urn and urn[10:-1] else None
            row = {"record_type": fields["WARC-Type"], "page_id": number(fields["WARC-Record-ID"]), "target_uri": fields["WARC-Target-URI"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": int(dict(h.split(": ", 1) for h in http)["Content-Length"]), "refers_to": number(fields.get("WARC-Refers-To")), "payload": None}
            wanted = all(_matches(x, row) for x in self.filters)
            if (wanted and self.payload) or known is None:
                parts = [raw]
                while not unpack.eof:
                    more = unpack.unconsumed_tail or f.read(1 << 16)
                    if not more:
                        raise ValueError(f"record at byte {at} ends early")
                    parts.append(unpack.decompress(more))
                known = known or f.tell() - len(unpack.unused_data) - at
                if wanted and self.payload:
                    block = b"".join(parts)[len(head) + 4 : len(head) + 4 + int(fields["Content-Length"])]
                    row["payload"] = block.partition(b"\r\n\r\n")[2]
            at += known
            if wanted:
                yield row


class WarcSource(DataSource):
    """Options: path, payload (default true), roll (bytes of a written file), per_task (bytes a read task takes), date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true", int(self.options.get("per_task", 32 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), int(self.options.get("roll", 64 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """A record per page; a page without an id is a response that nothing refers to. Only ids and digests meet by digest; page texts are dealt evenly, by page and digest."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    full = full.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    narrow = full.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "payload_digest").distinct()
    first = narrow.groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    later = narrow.join(first, "payload_digest").where(F.col("page_id") > F.col("first"))
    out = full.join(later, ["page_id", "payload_digest"], "left")
    kind = F.when(F.col("first").isNull(), "response").otherwise("revisit")
    return out.select(kind.alias("record_type"), "page_id", "target_uri", "payload_digest", "payload_bytes", F.col("first").alias("refers_to"), F.when(F.col("first").isNull(), F.col("payload")).alias("payload"))


def verified(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: digest and size of responses from their payloads, which must agree with the headers; of revisits from the headers alone."""
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    read = lambda payload, kind: spark.read.format("warc").option("path", path).option("payload", payload).load().where(F.col("record_type") == kind)
    full = read("true", "response").withColumns({"own_digest": F.sha2("payload", 256), "own_bytes": F.octet_length("payload").cast("long")})
    sound = (F.col("own_digest") == F.col("payload_digest")) & (F.col("own_bytes") == F.col("payload_bytes"))
    wrong = F.raise_error(F.concat(F.lit("payload and header differ in record "), F.col("page_id").cast("string")))
    full = full.withColumn("payload_digest", F.when(sound, F.col("own_digest")).otherwise(wrong)).withColumn("payload_bytes", F.col("own_bytes"))
    return full.select(*columns).unionByName(read("false", "revisit").select(*columns))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = f"{shared_dir(spark)}/concordat/warc-{uuid.uuid4().hex}"
    archive_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").option("path", path).save()
    return verified(spark, path)


OP5_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
