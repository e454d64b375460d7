"""Work that must not grow with repeated content: each test looks at where a plan or a stage does its work."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.functions import numbers, text
from concordat.operators import importer, pages, positions, requisites, vectors
from concordat.plans import queries
from concordat.sources import requests
from concordat.stages import written


@pytest.fixture
def folder(spark, tmp_path):
    """Parts of three names, a hundred copies each."""
    rows = [(i, ("red pump", "blue pump", "steel door")[i % 3], "B", "T", 1 + i % 7, 1.0 + i % 5) for i in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_character_features_are_made_once_a_name(spark, folder):
    found = queries.char_ngrams(spark, folder)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [p_name" in plan.split("Generate")[-1]
    counts = {(r["profile"], r["feature"]): r["parts"] for r in found.collect()}
    assert counts["web", "pump"] == counts["classic", "pump"] == 200 and counts["web", "door"] == 100


def _records(spark):
    names = ["Alpha Trading LLP", "Alpha Tradinq LLP", "Alpha Trading LLP", "Beta"]
    rows = [(i, f"D{i}", "1", n, "1", "street", f"bank {i % 2}", "", "") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "row_idx long, document_id string, page_or_sheet string, entity_name string, bin string, legal_address string, bank_name string, bik string, account_number string")


def test_web_names_are_normalised_before_they_are_paired(spark):
    cases = requisites.web_cases(_records(spark)).select("subtitle", "severity")
    assert "llp" not in cases._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in cases.collect()} == {("D0 ↔ D1", "critical"), ("D0 ↔ D3", "critical"), ("D1 ↔ D2", "critical"), ("D2 ↔ D3", "critical")}


def test_names_are_aligned_once_a_pair_of_names(spark):
    flags = requisites.find_conflicts(_records(spark)).select("flag_id", "name_similarity")
    assert "Aggregate [_bin" in flags._jdf.queryExecution().optimizedPlan().toString()
    found = {r["flag_id"]: r["name_similarity"] for r in flags.collect()}
    assert found == pytest.approx({"D0 ↔ D1": 200 * 14 / 30, "D1 ↔ D2": 200 * 14 / 30})  # 15 letters, one of them different


def test_a_text_is_normalised_once_for_all_its_grams(spark):
    df = spark.createDataFrame([("Red-Pump",)], "s string").select(text.grams(text.normalize(F.col("s"))).alias("g"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert df.first()["g"][:2] == [" re", "red"]


def test_documents_are_folded_once_for_all_three_rules(spark, tmp_path):
    spark.createDataFrame([(1, "Ёлка-1 ООО ТОО", "ru", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.text_normalized(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert found.first()["words"] == md5("елка 1 ооо тоо".encode()).hexdigest()


def _positions(spark):
    """Forty copies of one text and three of another like it, in two blocks, one of them null."""
    rows = [(i, f"D{i % 3}", str(i), "1", "red steel pump" if i % 14 else "red steel pumps", "m", 1.0 + i % 4, 10.0, "", None if i % 2 else "x") for i in range(43)]
    return spark.createDataFrame(rows, "row_idx long, document_id string, position_id string, page_or_sheet string, work_description string, unit string, quantity double, unit_price double, norm_ref string, kind string")


@pytest.mark.parametrize("meetings", [1 << 21, 50])
def test_pairs_of_a_hot_text_are_divided_among_tasks(spark, monkeypatch, meetings):
    monkeypatch.setattr(positions, "MEETINGS", meetings)
    pairs = positions.find_pairs(_positions(spark), block=("kind",)).select("left_index", "right_index")
    made = pairs.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert {tuple(r) for r in pairs.collect()} == {(i, j) for i in range(43) for j in range(i + 1, 43) if (j - i) % 2 == 0} and pairs.count() == 22 * 21 // 2 + 21 * 20 // 2
    if meetings == 50:
        assert len(made) > 8 and max(r["count"] for r in made) < 0.3 * pairs.count()


def test_an_order_has_ranges_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(pages, "RANGE", 50)
    ordered = pages.Ordered(spark.range(2000).select(F.pmod(F.col("id") * 7919, F.lit(2000)).alias("k")), "k")
    assert max(b - a for a, b in zip(ordered._ranges[1], ordered._ranges[1][1:])) < 200
    assert all(r["ordinal"] == r["k"] for r in ordered.rows().collect()) and len(ordered) == 2000


def test_cheap_roundings_are_the_plain_ones(spark):
    values = [0.0, 0.005, 0.05, 0.25, 0.125, 6.25, 12.35, 43.75, 99.95, 99.994999, 1e7, -1.25, 1e-9, float("nan"), float("inf"), None, *(i / 48 * 100 for i in range(49)), *(i / 7 for i in range(40))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    x = F.col("x")
    checks = [numbers.fixed(x, n).eqNullSafe(F.when(x.isNotNull(), F.format_string(f"%.{n}f", x))) for n in (1, 2)] + [numbers.rounded(x, n).eqNullSafe(F.round(x, n)) for n in (2, 6)]
    assert [r["x"] for r in df.where(~(checks[0] & checks[1] & checks[2] & checks[3])).collect()] == []


def test_headers_are_looked_for_without_reading_the_spellings_anew(monkeypatch):
    calls = []
    plain = importer.plain_header
    monkeypatch.setattr(importer, "plain_header", lambda c: calls.append(c) or plain(c))
    cells = ["№ п/п", "Наименование работ (полное)", "Ед. изм.", "Кол-во", "Цена за единицу", "Обоснование", "", "17,5", "красный насос"]
    assert importer.assign(cells, "estimate")[1] == {"position_id": 0, "work_description": 1, "unit": 2, "quantity": 3, "unit_price": 4, "norm_ref": 5}
    assert len(calls) == len(cells)
    every = [(f, c) for f in importer.ALIASES for c in (*importer.ALIASES[f], "17,5", "цен", "x " + importer.ALIASES[f][0])]
    for field, c in every:  # what is skipped has no score
        own = plain(c)
        assert (own in importer._HELD or importer._HOLDS.search(own) is not None) or importer.header_score(c, field) == 0


@pytest.mark.parametrize("rows", [60, 240])
def test_vectors_without_structure_are_sent_to_a_bounded_number_of_tasks(spark, monkeypatch, rows):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    monkeypatch.setattr(vectors, "MOST", 4)
    monkeypatch.setattr(vectors, "TILE", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a block comes in several batches
    try:
        v = np.random.default_rng(rows).normal(size=(rows, 6)).round(3)
        named = written(vectors.classes(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")), "t")
        sent = []
        meeting = vectors._meeting
        monkeypatch.setattr(vectors, "_meeting", lambda blocked, meet, *rest: sent.append((blocked.groupBy("block").count().collect(), meet)) or meeting(blocked, meet, *rest))
        got = {(r["l"], r["r"]) for r in vectors.similar_pairs(named, 0.4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == {(i, j) for i, j in zip(*np.nonzero(np.round(unit @ unit.T, 12) >= 0.4)) if i < j}
    blocks, meet = sent[0]
    size = {r["block"]: r["count"] for r in blocks}
    assert len(size) == 4 and max(size.values()) < 2 * rows / 4
    assert sum(size[i] + size[j] for _, i, j in meet) <= 5 * rows


def test_a_request_is_parsed_once(spark):
    bodies = spark.createDataFrame([(1, '{"rows": []}'), (2, None)], "request long, body string")
    rows, refused = requests.read_requests(bodies, "estimate")
    assert [d._jdf.queryExecution().optimizedPlan().toString().count("from_json") for d in (rows, refused)] == [1, 1]
    assert rows.collect() == [] and {tuple(r) for r in refused.collect()} == {(1, "row_count"), (2, "row_count")}
