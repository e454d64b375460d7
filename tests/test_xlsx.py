from __future__ import annotations

import io
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from concordat.functions.cell_formats import general, is_date, plain, shown
from concordat.operators import importer
from concordat.schemas import SchemaError
from concordat.sources import xlsx

SHOWN = [
    (1234.5, "#,##0.00", "1,234.50"), (0.125, "0.0%", "12.5%"), (-5, "0;(0)", "(5)"), (-5, "0", "-5"), (0, '0;-0;"нет"', "нет"), (5, "#.##", "5."), (0.5, "#.##", ".5"),
    (45000, "m/d/yy", "3/15/23"), (45000.5, "dd.mm.yyyy h:mm", "15.03.2023 12:00"), (45000, "dddd, d mmmm yyyy", "Wednesday, 15 March 2023"), (1.5, "[h]:mm:ss", "36:00:00"), (0.75, "h:mm AM/PM", "6:00 PM"),
    (45000.000011574, "mm:ss.0", "00:01.0"), (61, "d-mmm-yy", "1-Mar-00"), (1, "d-mmm-yy", "1-Jan-00"), (0.999999999, "h:mm:ss", "0:00:00"), (-1, "m/d/yy", ""), (3e6, "m/d/yy", ""),
    (12345678, "0.00E+00", "1.23E+07"), (9.999, "0.00E+00", "1.00E+01"), (12345, "##0.0E+0", "12.3E+3"), (3.25, "# ?/?", "3 1/4"), (0.5, "?/?", "1/2"), (2.999, "# ?/?", "3"),
    (1234567, '#,##0," тыс"', "1,235 тыс"), (150000, "#,##0.00\\ [$₸-43F]", "150,000.00 ₸"), (9991234, "000-0000", "999-1234"), (7, "000", "007"), (999.5, "#,##0", "1,000"), (1e6, "#,##0", "1,000,000"),
    (5, '[>3]"много";"мало"', "много"), (2, '[>3]"много";"мало"', "мало"), (-0.001, "0.0", "0.0"), (-1234.5, "#,##0.00;[Red]-#,##0.00", "-1,234.50"), (7, "@", "7"), (1.005, "0.00", "1.01"), (2, "General", "2"),
]


def test_shown_numbers():
    assert [(v, c, shown(float(v), c)) for v, c, _ in SHOWN] == SHOWN


def test_general_and_plain_numbers():
    values = {0.1 + 0.2: "0.3", 123456.789012345: "123456.789", 12345678901234: "1.23457E+13", 0.00001: "1E-05", 99999999999: "99999999999", -2.5: "-2.5"}
    assert {v: general(float(v)) for v in values} == values
    assert [plain(5.0, "0.00"), plain(6.5, "General"), plain(0.1 + 0.2, "0"), plain(1e20, "0")] == ["5", "6.5", "0.30000000000000004", "100000000000000000000"]
    assert [plain(45000.0, "d.m.yy"), plain(45000.25, "m/d/yy h:mm"), plain(0.5, "h:mm"), plain(0.0, "d.m.yy", since_1904=True)] == ["2023-03-15 00:00:00", "2023-03-15 06:00:00", "12:00:00", "1904-01-01 00:00:00"]
    assert is_date("[$-419]d mmm;@") and not is_date('0" day"') and not is_date("[Red]0.00")


def put(path, sheets, codes=()):
    path.write_bytes(xlsx.workbook(sheets, codes))
    return str(path)


def cells_of(df):
    return [(r["sheet"], r["row_idx"], r["cells"]) for r in df.orderBy("file", "sheet_idx", "row_idx").collect()]


def test_values_and_what_is_shown(spark, tmp_path):
    path = put(tmp_path / "a b%20.xlsx", {"один": [["x", 2.0, (1234.5, 0)], [], [None, (45000, 1)]], "two": [[" <&> "]], "none": []}, ("#,##0.00", "dd.mm.yyyy"))
    assert cells_of(xlsx.read_cells(spark, [path], shown=True)) == [("один", 0, ["x", "2", "1,234.50"]), ("один", 2, ["", "15.03.2023"]), ("two", 0, [" <&> "])]
    assert cells_of(xlsx.read_cells(spark, [path])) == [("один", 0, ["x", "2", "1234.5"]), ("один", 2, ["", "2023-03-15 00:00:00"]), ("two", 0, [" <&> "])]
    assert cells_of(xlsx.read_cells(spark, [path], first=True))[-1][0] == "один"


def raw_book(path, body, shared="", workbook=""):
    book = io.BytesIO(xlsx.workbook({"s": []}))
    with zipfile.ZipFile(book) as old, zipfile.ZipFile(path, "w") as new:
        for n in old.namelist():
            content = old.read(n).decode()
            if n.endswith("sheet1.xml"):
                content = content.replace("<sheetData>", f"<sheetData>{body}")
            new.writestr(n, content.replace("<sheets>", f"{workbook}<sheets>"))
        if shared:
            new.writestr("xl/sharedStrings.xml", f'<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{shared}</sst>')
    return str(path)


def test_kinds_of_cells(spark, tmp_path):
    body = '<row r="3"><c r="B3" t="s"><v>1</v></c><c r="D3" t="b"><v>1</v></c><c t="e"><v>#DIV/0!</v></c><c t="str"><f>A1</f><v>f</v></c><c t="s"><v>0</v></c><c r="AA3"/></row><row><c><v>7</v></c></row>'
    path = raw_book(tmp_path / "k.xlsx", body, "<si/><si><t>ру</t><r><t>с</t></r><rPh><t>no</t></rPh></si>")
    wide = [""] * 27
    assert cells_of(xlsx.read_cells(spark, [path], shown=True)) == [("s", 2, [*["", "рус", "", "TRUE", "", "f", ""], *wide[7:]]), ("s", 3, ["7"])]
    assert cells_of(xlsx.read_cells(spark, [path]))[0][2][:7] == ["", "рус", "", "True", "nan", "f", ""]
    later = raw_book(tmp_path / "l.xlsx", '<row r="1"><c s="0"><v>1</v></c></row>', workbook='<workbookPr date1904="1"/>')
    with zipfile.ZipFile(later) as z:
        assert xlsx.formats(z) == (["General"], True)


def test_what_is_no_sheet(spark, tmp_path):
    for name, body in [("row", '<row r="1048577"><c><v>1</v></c></row>'), ("column", '<row r="1"><c r="XFE1"><v>1</v></c></row>')]:
        with pytest.raises(Exception, match="a cell outside the sheet"):
            xlsx.read_cells(spark, [raw_book(tmp_path / f"{name}.xlsx", body)]).count()
    (tmp_path / "not.xlsx").write_bytes(b"PK not a workbook")
    with pytest.raises(Exception, match="BadZipFile"):
        xlsx.read_cells(spark, [str(tmp_path / "not.xlsx")])
    path = put(tmp_path / "big.xlsx", {"s": [["x" * 100]]})
    with pytest.raises(Exception, match="big.xlsx: файл больше"):
        xlsx.read_cells(spark, [path], most=1000)
    with zipfile.ZipFile(path) as z, pytest.MonkeyPatch.context() as m:
        m.setattr(xlsx, "UNPACKED", 10)
        with pytest.raises(SchemaError, match="unpacked"):
            list(xlsx.Book(z, shown=True).rows("xl/worksheets/sheet1.xml"))


def test_sheets_are_tasks(spark, tmp_path):
    paths = [put(tmp_path / f"{i}.xlsx", {f"s{j}": [[i, j]] for j in range(8)}) for i in range(3)]
    rows = xlsx.read_cells(spark, paths)
    assert rows.rdd.getNumPartitions() > 1 and rows.count() == 24
    assert rows.where("cells[0] || '/s' || cells[1] || '.' <> regexp_extract(file, '([0-9]+)[.]xlsx', 1) || '/' || sheet || '.'").count() == 0


def test_memory_of_a_large_sheet():
    """What reading holds doesn't grow with the rows, but for an empty element each."""
    peaks = []
    for n in (5_000, 50_000):
        with zipfile.ZipFile(io.BytesIO(xlsx.workbook({"s": ([f"text {i}", i, i / 8] for i in range(n))}))) as z:
            tracemalloc.start()
            assert sum(1 for _ in xlsx.Book(z, shown=True).rows("xl/worksheets/sheet1.xml")) == n
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert (peaks[1] - peaks[0]) / 45_000 * xlsx.ROWS < 500e6


def test_written_workbooks(spark, tmp_path):
    cells = F.array(xlsx.cell(text=F.col("id").cast("string")), xlsx.cell(number=F.col("id") / 8, style=0))
    rows = spark.range(100).select(F.concat(F.lit("b"), F.col("id") % 3).alias("book"), F.concat(F.lit("s"), F.col("id") % 2).alias("sheet"), (-F.col("id")).alias("at"), cells.alias("cells"))
    folder = f"file://{tmp_path}/out"
    assert xlsx.write_workbooks(rows, folder, ("0.00",)).agg(F.sum("rows"), F.count("*")).first()[:] == (100, 3)
    xlsx.write_workbooks(rows, folder, ("0.00",))  # again: the same files
    back = importer.read_sheets(spark, f"{folder}/*.xlsx")
    assert back.count() == 100 and back.where("cells[1] <> format_string('%.2f', floor(int(cells[0]) / 8 * 100 + 0.5) / 100)").count() == 0
    assert back.where("file LIKE '%b0.xlsx' AND sheet = 's0'").orderBy("row_idx").first()["cells"][0] == "96"


def test_csv_sheets_in_parallel(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Ведомость\n\nНаименование,"Ед, ""изм""",Цена\n"Труба\nстальная",м\nДверь,шт,5,лишнее\n', encoding="utf-8")
    out = [r["cells"] for r in importer.read_sheets(spark, str(tmp_path / "a.csv")).orderBy("row_idx").collect()]
    assert [[c for c in row if c] for row in out] == [["Ведомость"], ["Наименование", 'Ед, "изм"', "Цена"], ["Труба\nстальная", "м"], ["Дверь", "шт", "5", "лишнее"]]
    with pytest.raises(SchemaError, match="a.csv: файл больше"):
        importer.read_sheets(spark, str(tmp_path / "a.csv"), most=10)
