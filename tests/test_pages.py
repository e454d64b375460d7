from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from concordat.operators.pages import Ordered


def test_pages_and_rows_equal_the_global_sort(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1.5, -2.0, 7.0]), rng.choice(["a", "b", "é"])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x double, s string")
    order = [F.desc("x"), F.col("s"), F.col("id")]
    expected = [r["id"] for r in df.orderBy(*order).collect()]
    ordered = Ordered(df, *order, ranges=7)
    assert len(ordered) == 500
    assert {r["ordinal"]: r["id"] for r in ordered.rows().collect()} == dict(enumerate(expected))
    for first, size in ((0, 10), (95, 110), (490, 50), (500, 5), (0, 0)):
        assert [r["id"] for r in ordered.page(first, size).collect()] == expected[first : first + size]
    assert [ordered.row(k)["id"] for k in (0, 137, 499)] == [expected[k] for k in (0, 137, 499)]
    with pytest.raises(IndexError):
        ordered.row(500)


def test_a_page_reads_the_files_that_hold_it(spark):
    ordered = Ordered(spark.range(1000), "id", ranges=8)
    stored = len({f for f in ordered.rows().inputFiles()})
    ranges = {r[0] for r in ordered.page(10, 20).select(F.input_file_name()).collect()}
    assert stored == 8 and len(ranges) == 1


def test_empty(spark):
    ordered = Ordered(spark.range(0), "id")
    assert len(ordered) == 0 and ordered.rows().collect() == ordered.page(0, 10).collect() == []
