from __future__ import annotations

import gzip
import hashlib

from pyspark.sql import functions as F

from concordat.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, first int"
BIG = "é" * 60
ROWS = [(7, "http://a/7", BIG), (3, "http://a/3\r\nX: y", BIG), (9, None, BIG), (1, "http://a/1", "small"), (2, "http://a/2", "small"), (4, "http://b/", None), (5, "http://b/5", "x" * 100_000), (6, "http://b/6", "a\r\n\r\nb" * 40), (9, None, BIG)]


def archive(spark, tmp_path, rows, **options):
    warc.register(spark)
    pages = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA)
    writer = warc.archive_records(pages).write.format("warc").mode("append").options(**options)
    writer.option("path", str(tmp_path / "out")).save()
    return spark.read.format("warc").option("path", str(tmp_path / "out"))


def test_round_trip(spark, tmp_path):
    back = archive(spark, tmp_path, ROWS, roll=500).load().collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in back) == sorted(
        (i, "revisit" if i in (7, 9) else "response", 3 if i in (7, 9) else None, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in ROWS
    )
    html = {i: (h or "").encode() for i, _, h in ROWS}
    for r in back:
        assert bytes(r["payload"]) == (html[r["page_id"]] if r["record_type"] == "response" else b"")
    files = list((tmp_path / "out").glob("*.warc.gz"))
    assert len(files) > 1 and all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in files)


def test_predicates_and_skipped_payloads(spark, tmp_path):
    reader = archive(spark, tmp_path, ROWS)
    assert {r["page_id"] for r in reader.load().where("record_type = 'revisit'").collect()} == {7, 9}
    assert {r["page_id"] for r in reader.load().where(F.col("target_uri").startswith("http://b")).collect()} == {4, 5, 6}
    assert all(r["payload"] is None for r in reader.option("payload", "false").load().collect())


def test_plain_gzip_members_and_no_manifest(spark, tmp_path):
    archive(spark, tmp_path, ROWS)
    folder = tmp_path / "plain"
    folder.mkdir()
    raw = b"".join(gzip.compress(warc.record({"record_type": "response", "page_id": i, "target_uri": "u", "payload": b"z" * i, "payload_bytes": i, "payload_digest": "d", "refers_to": None}, "1970-01-01T00:00:00Z")) for i in (1, 90_000, 3))
    (folder / "x.warc.gz").write_bytes(raw)
    back = spark.read.format("warc").option("path", str(folder)).load().collect()
    assert [(r["page_id"], len(r["payload"])) for r in back] == [(1, 1), (90_000, 90_000), (3, 3)]


def test_files_outside_the_manifest_are_not_read(spark, tmp_path):
    reader = archive(spark, tmp_path, ROWS)
    (tmp_path / "out" / "left-by-a-lost-task.warc.gz").write_bytes(b"\x1f\x8bbroken")
    assert reader.load().count() == len(ROWS)


def test_empty_table(spark, tmp_path):
    assert archive(spark, tmp_path, []).load().count() == 0


def test_pages_without_an_id_are_responses_as_in_the_sql(spark, tmp_path):
    import duckdb

    rows = [*ROWS, (None, "http://c/", BIG), (None, None, BIG), (None, "http://d/", "only here " * 20)]
    spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, warc.op5_warc(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.sql(warc.OP5_SQL).fetchall(), key=repr)
    assert [r[3:] for r in got if r[0] is None] == [("response", None)] * 3
