from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from concordat.sources import csv_records
from concordat.sources.csv_records import Layout, read_csv, records, still_open


def plain(spark, path):
    """Spark's reader with one task a file."""
    df = spark.read.options(header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return [tuple(r) for r in df.collect()]


@pytest.fixture(params=[40, 150, 1 << 20])
def blocks(request, spark):
    for name, value in (("spark.sql.files.maxPartitionBytes", request.param), ("spark.sql.files.openCostInBytes", 0), ("spark.sql.files.minPartitionNum", 1)):
        spark.conf.set(name, value)
    yield request.param
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(name)


def test_hostile_quotes_are_read_as_by_one_task(spark, tmp_path, blocks):
    rng = random.Random(blocks)
    fields = ["a", "", " ", '5" pipe', '"', '"q"', '"a,b"', '"line\nend"', '"x\n\ny"', '"two "" quotes"', '""', '""""', '"open ""\n"', 'é"', "long" * 30, '"' + "deep\n" * 40 + '"', '" , "', "b c"]
    fields.remove('"')
    end = "\n"
    lines = ["one,two,three"] + [",".join(rng.choice(fields) for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(120)]
    path = tmp_path / "t.csv"
    path.write_text(end.join(lines) + end, newline="")
    got = read_csv(spark, str(path))
    rows = got.orderBy("row_idx").collect()
    assert [r["row_idx"] for r in rows] == list(range(len(rows)))
    assert [tuple(r)[:3] for r in rows] == plain(spark, str(path))
    if blocks == 40:
        assert records(Layout(spark, str(path))).select(F.spark_partition_id()).distinct().count() > 20


@pytest.mark.parametrize("text", [
    "a,b\r\n1,2\r\n\r\n3,\"x\r\"\r\n", "﻿a,b\n1,2", "a,b\n\n\n1,2\n\n", "a,b\n", "a,b", "\n\na\n1\n", 'a,b\n1,"never closed\n2,3\n4', 'a,b\n"x"y,2\n3,4\n', 'a,b\n"x"y"z,"2\n3",4\n5,6\n', "a,b\n1\n1,2,3\n"])
def test_odd_files(spark, tmp_path, blocks, text):
    path = tmp_path / "t.csv"
    path.write_text(text, newline="")
    got = [tuple(r)[:-1] for r in read_csv(spark, str(path)).orderBy("row_idx").collect()]
    assert [[c or "" for c in r] for r in got] == [[c or "" for c in r] for r in plain(spark, str(path))]


def test_folder_of_files(spark, tmp_path, blocks):
    rows = [(i, f'x "{i}"\n,{i}' if i % 3 else None) for i in range(90)]
    folder = str(tmp_path / "f.csv")
    spark.createDataFrame(rows, "i int, t string").repartition(3).write.options(header=True, escape='"').csv(folder)
    got = read_csv(spark, folder).collect()
    assert sorted((int(r["i"]), r["t"]) for r in got) == rows and sorted(r["row_idx"] for r in got) == list(range(90))


def test_state_of_a_line():
    assert not still_open("a,b", False) and still_open("a,b", True) and still_open('a,"b', False) and not still_open('b",c', True)
    assert still_open('b","c', True) and not still_open('x"y,"z"', False) and not still_open('"a"b,c', False) and still_open('"a"b,"c', False) and still_open('say ""', True)
    assert not still_open("x" * 200_000 + '"', False) and still_open('"' + '""' * 100_000, False)


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert csv_records.read_csv(spark, str(tmp_path / "e.csv")).collect() == []


def test_checks_cost_one_pass_and_list_no_more_than_they_show(spark, tmp_path, monkeypatch):
    from concordat.schemas import POSITION_COLUMNS, SchemaError
    from concordat.sources import tables

    path = tmp_path / "p.csv"
    path.write_text(",".join(POSITION_COLUMNS) + "\n" + "".join(f'A,{i},1,"два\nслова",м,{"x" if i % 10 == 0 else i},{i},\n' for i in range(1, 201)))
    (found,) = tables.read_checked(spark, "estimate", str(path))
    assert found.counts == {"rows": 200, "quantity": 20, "unit_price": 0}
    assert sorted((r["line"], r["column"], r["value"]) for r in found.problems.collect()) == [(i + 1, "quantity", "x") for i in range(10, 201, 10)]
    assert found.rows.count() == 180 and "Python" not in found.rows._jdf.queryExecution().toString()  # read from what the pass wrote
    monkeypatch.setattr(tables, "SHOWN", 3)
    with pytest.raises(SchemaError, match=r"строках \[11, 21, 31\] и ещё 17\."):
        tables.read_positions(spark, str(path))
