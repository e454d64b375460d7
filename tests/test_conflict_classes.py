from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from concordat.operators import requisites
from concordat.plans import queries
from concordat.schemas import REQUISITE_COLUMNS

SCHEMA = ", ".join(["row_idx long", *(f"{c} string" for c in REQUISITE_COLUMNS)])


def made(spark, n, hot):
    """Records of which ``hot`` share one name; some differ in letters, BIN, address, bank or account, some values are null."""
    draw = random.Random(n)
    rows = []
    for i in range(n):
        name = "ТОО Альфа Строй" if i < hot else draw.choice(["ТОО Бета", "ТОО «Бета»", "ТОО Бета Трейд Алматы", "ТОО Бета Трейд Алмата", None, ""])
        rows.append((i, f"D{i}", "1", name, draw.choice(["123456789012", "1234 5678 9012", "223456789012", None]), draw.choice(["Абая 1", "Абая, 1", "Абая 2"]), "Банк", "ABCDKZKA", draw.choice(["KZ1", "KZ2"])))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def flags(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("info", [False, True])
def test_expanded_equals_all_flags(spark, info):
    rows = made(spark, 70, 20)
    found = requisites.conflict_classes(rows, include_info=info)
    assert flags(requisites.expanded(found.pairs, found.members)) == flags(requisites.find_conflicts(rows, include_info=info))


def test_expanded_equals_the_query(spark):
    rows = queries._records(spark, "/root/testdata/sf0.001")
    found = requisites.conflict_classes(rows, include_info=True)
    assert flags(requisites.expanded(found.pairs, found.members)) == flags(requisites.find_conflicts(rows, include_info=True))
    one = found.pairs.where("severity = 'medium'")
    assert requisites.expanded(one, found.members).count() == one.agg(F.sum("flags")).first()[0]


def test_a_hot_name_stays_linear(spark):
    rows = made(spark, 3000, 1000)
    found = requisites.conflict_classes(rows)
    pairs, total = found.pairs.agg(F.count("*"), F.sum("flags")).first()
    assert found.members.count() == 3000 and pairs < 3000 < 300_000 < total


def test_no_rows(spark):
    found = requisites.conflict_classes(spark.createDataFrame([], SCHEMA))
    assert found.pairs.count() == 0 and requisites.expanded(found.pairs, found.members).count() == 0
