from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from concordat.operators import importer, registry, review, search
from concordat.schemas import POSITION_COLUMNS, SchemaError
from concordat.sources import tables
from concordat.streaming import decision_stream, start_latest

HEAD = ",".join(POSITION_COLUMNS)


def write_xlsx(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>shared </t><r><t>text</t></r></si></sst>')
        for i, rows in enumerate(sheets.values()):
            cell = lambda j, r, v: f'<c r="{chr(65 + j)}{r}" t="s"><v>0</v></c>' if v == "shared text" else f'<c r="{chr(65 + j)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
            body = "".join(f'<row r="{r}">' + "".join(cell(j, r, v) for j, v in enumerate(row) if v != "") + "</row>" for r, row in enumerate(rows, 1) if row)
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_csv_and_xlsx(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'extra,{HEAD}\nx,A,1, l ,"Работа, ""два""",м,"1 000,5",2,\n\nx,A,2,l,Труба,м,3,4,N\n', encoding="utf-8")
    write_xlsx(tmp_path / "b.XLSX", {"one": [POSITION_COLUMNS, ["B", "1", "s", "shared text", "шт", "5", "6,5", ""], [], ["B", "2", "s", "Дверь", "шт", "5", "6", "N"]], "two": [["other"]]})
    rows = tables.read_positions(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.XLSX")).orderBy("row_idx").collect()
    assert [(r["document_id"], r["work_description"], r["quantity"], r["unit_price"]) for r in rows] == [("A", 'Работа, "два"', 1000.5, 2.0), ("A", "Труба", 3.0, 4.0), ("B", "shared text", 5.0, 6.5), ("B", "Дверь", 5.0, 6.0)]


def test_bad_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("document_id,unit\nA,м\n")
    with pytest.raises(SchemaError, match="position_id, page_or_sheet"):
        tables.read_positions(spark, str(tmp_path / "a.csv"))
    with pytest.raises(SchemaError, match="CSV и XLSX"):
        tables.read_positions(spark, str(tmp_path / "a.txt"))
    (tmp_path / "b.csv").write_text(HEAD + "\n")
    with pytest.raises(SchemaError, match="не содержит строк"):
        tables.read_positions(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text(f"{HEAD}\nA,1,l,x,м,1,2,\nA,2,l,x,м,many,z,\n")
    with pytest.raises(SchemaError, match=r"quantity должно быть числом; ошибки в строках \[3\]"):
        tables.read_positions(spark, str(tmp_path / "c.csv"))
    bad = tables.demo_rows(spark, "requisite", [("D", "1", "n", "12", "a", "b", "ABCD", "KZ1")])
    with pytest.raises(SchemaError, match="БИН.*; БИК.*; ИИК"):
        tables.checked_requisites(bad)
    with pytest.raises(SchemaError):
        tables.checked_request(bad, "requisite")


def sheet(spark, rows, name="s", file="/x/смета.csv"):
    return importer.without_blank_rows(spark.createDataFrame([(file, name, i, [str(c) for c in r]) for i, r in enumerate(rows)], "file string, sheet string, row_idx long, cells array<string>"))


def test_header_below_titles(spark):
    rows = sheet(spark, [["Локальная смета", ""], [], ["Объект: школа"], ["№ п/п", "Наименование работ и затрат", "Ед. изм.", "Количество", "Цена за единицу", "Обоснование"], ["1", "Монтаж кабеля", "м", "10", "20", "E1"], ["2", "Окраска стен", "м2", "5", "7", "E2"], ["", "Итого", "", "", "99", ""]])
    found = importer.layouts(rows, "estimate")
    out = importer.import_sheets(rows, "estimate", found).orderBy("row_idx").collect()
    assert [(r["document_id"], r["position_id"], r["page_or_sheet"], r["work_description"], r["unit"], r["quantity"], r["unit_price"], r["norm_ref"]) for r in out] == [("смета", "1", "s", "Монтаж кабеля", "м", "10", "20", "E1"), ("смета", "2", "s", "Окраска стен", "м2", "5", "7", "E2")]
    report = importer.reports(rows, found, importer.import_sheets(rows, "estimate", found)).first()
    assert report["header_row"] == 3 and report["rows"] == 2 and report["mapping"]["quantity"] == "Количество" and report["inferred"] == []


def test_without_header(spark):
    rows = sheet(spark, [["1.1", "Устройство цементной стяжки", "м2", "120", "3500,50", "Е11-0101"], ["1.2", "Прокладка кабеля в трубах", "м3", "45", "1200,00", "Е08-0202"], ["1.3", "Установка светильников", "шт", "16", "5400,25", "Е08-0303"]])
    found = importer.layouts(rows, "estimate").first()
    assert found["start"] == 0 and found["mapping"] == {"unit": 2, "position_id": 0, "norm_ref": 5, "work_description": 1, "quantity": 3, "unit_price": 4}
    assert importer.import_sheets(rows, "estimate").count() == 3
    firms = sheet(spark, [["ТОО Альфа Строй", "123456789012", "KZ123456789012345678", "ABCDKZKA"], ["ТОО Гамма Монтаж", "223456789012", "KZ223456789012345678", "BBCDKZKA"]], name="r")
    row = importer.import_sheets(firms, "requisite").orderBy("row_idx").first()
    assert (row["entity_name"], row["bin"], row["account_number"], row["bik"]) == ("ТОО Альфа Строй", "123456789012", "KZ123456789012345678", "ABCDKZKA")


def test_reads_sheets_of_files(spark, tmp_path):
    (tmp_path / "est.csv").write_text("﻿Наименование,Ед. изм.,Количество,Цена\nТруба стальная,м,3,5\n", encoding="utf-8")
    write_xlsx(tmp_path / "b.xlsx", {"пустой": [[]], "лист": [["Наименование", "Ед. изм.", "Количество", "Цена"], ["Дверь деревянная", "шт", "1", "2"]]})
    rows = importer.read_sheets(spark, str(tmp_path / "est.csv"), str(tmp_path / "b.xlsx"))
    assert {(r["document_id"], r["work_description"], r["unit_price"]) for r in importer.import_sheets(rows, "estimate").collect()} == {("est", "Труба стальная", "5"), ("b", "Дверь деревянная", "2")}


def test_review_store(spark, tmp_path):
    store = review.DecisionStore(spark, str(tmp_path / "store"))
    put = lambda role, version, decision="accepted", item="i": store.record(track="requisite", item_id=item, decision=decision, role=role, actor=f" {role} ", expected_version=version, severity="critical", comment=" c ", evidence={"б": 1, "a": None})
    assert store.state("requisite", "i")["status"] == "pending"
    first = put("expert", 0)
    assert store.state("requisite", "i", "critical")["status"] == "second_approval" and "контролёра" in store.state("requisite", "i", "critical")["label"]
    with pytest.raises(review.DecisionConflict):
        put("controller", 0)
    second = put("controller", first)
    state = review.DecisionStore(spark, str(tmp_path / "store")).state("requisite", "i", "critical")
    assert (state["status"], state["version"], state["accepted_roles"], state["last_actor"]) == ("accepted", second, ["controller", "expert"], "controller")
    put("expert", second, "rejected")
    assert store.state("requisite", "i", "critical")["status"] == "rejected"
    assert [r["decision"] for r in store.history("requisite", "i").collect()] == ["rejected", "accepted", "accepted"]
    assert store.decisions().first()["evidence_json"] == '{"a": null, "б": 1}' and store.audit_events().count() == 3
    for wrong in ({"track": "x"}, {"role": "x"}, {"decision": "x"}, {"actor": " "}):
        with pytest.raises(ValueError):
            store.record(**({"track": "estimate", "item_id": "i", "decision": "accepted", "role": "expert", "actor": "a", "expected_version": 0} | wrong))
    items = spark.createDataFrame([("i", "critical"), ("j", "high")], "flag_id string, severity string")
    shown = {r["flag_id"]: (r["review_status"], r["version"]) for r in review.with_state(items, store.decisions(), "requisite", "flag_id").collect()}
    assert shown["i"][0] == "rejected" and shown["j"] == ("pending", 0)
    query = start_latest(decision_stream(spark, str(tmp_path / "store")), str(tmp_path / "latest"), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert {(r["role"], r["decision"]) for r in spark.read.parquet(str(tmp_path / "latest")).collect()} == {("expert", "rejected"), ("controller", "accepted")}


def test_web_states(spark):
    log = spark.createDataFrame([(1, "a", "accepted", "expert", "critical"), (2, "b", "accepted", "expert", "high"), (3, "c", "rejected", "controller", "high"), (4, "a", "accepted", "controller", "critical"), (5, "d", "accepted", "expert", "critical")], "id long, case_id string, action string, role string, severity string")
    got = {r["case_id"]: (r["status"], r["accepted_roles"]) for r in review.web_states(log).collect()}
    assert got == {"a": ("accepted", ["controller", "expert"]), "b": ("accepted", ["expert"]), "c": ("rejected", []), "d": ("pending_second", ["expert"])}


def test_registry(spark):
    rows = spark.createDataFrame([(0, "1", "x", "addr"), (1, "1", "y", "addr2"), (2, "2", "z", "addr3")], "row_idx long, bin string, entity_name string, legal_address string")
    keys = spark.createDataFrame([("1",), ("3",)], "bin string")
    got = {r["bin"]: (r["entity_name"], r["found"], r["source"]) for r in registry.TableRegistry(rows).lookup(keys).collect()}
    assert got == {"1": ("x", True, "Синтетический mock"), "3": (None, False, None)}
    for provider in (registry.DisabledRegistry(), registry.GatewayRegistry()):
        with pytest.raises(registry.RegistryUnavailable):
            provider.lookup(keys)
    gateway = registry.GatewayRegistry(lambda asked: asked.where("bin = '1'").withColumn("entity_name", F.lit("w")))
    assert {r["bin"]: (r["entity_name"], r["found"]) for r in gateway.lookup(keys.withColumn("bin", F.col("bin"))).collect()} == {"1": ("w", True), "3": (None, False)}
    answers = spark.createDataFrame([("2", '[{"code":"1","name":"n1"},{"code":"2","name":"n2","endDate":"2020","endReason":{"ru":"Ликвидация"}}]'), ("9", '[{"code":"1","name":"n1"}]'), ("8", "[]")], "bin string, payload string")
    got = {r["bin"]: (r["registry_name"], r["active"], r["registry_status"]) for r in registry.taxpayer_status(answers).collect()}
    assert got == {"2": ("n2", False, "Ликвидация"), "9": ("n1", True, "Действующий"), "8": (None, None, None)}


def test_filters(spark):
    rows = spark.createDataFrame([("A", "B", "proposed"), ("C", "B", "excluded")], "left_document_id string, right_document_id string, status string")
    assert search.filtered(rows, document="A", status=["proposed", "excluded"]).count() == 1 and search.filtered(rows, status=["excluded"]).count() == 1
    assert [r[0] for r in search.document_names(rows).collect()] == ["A", "B", "C"]
    assert {r["status"] for r in search.labelled(rows, "status", {"proposed": "да"}).collect()} == {"да", "excluded"}
    assert importer.column_profile(rows.select(F.lit("12,5 %").alias("a"), F.lit("x").alias("b")), ["a", "b"]).where("number_share = 1").count() == 1
