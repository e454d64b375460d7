"""Spreadsheets (.xlsx, .xlsm) as rows of cell texts, a sheet a task's work.

Files are listed by Spark and outlined on the executors: a row a sheet, from the archive's directory and the workbook's
part. Sheets are then dealt to tasks by file and number, as many tasks as their unpacked size asks for, and each is read
as a stream: XML row by row, shared strings as one buffer with offsets. A sheet has 1,048,576 rows at most, so that is
the largest task, and what it holds is a batch of rows and the shared strings.

Texts of cells: ``shown`` gives what the sheet shows (numbers and dates by their format, TRUE and FALSE, errors empty),
otherwise values (whole numbers without a point, dates as ISO texts, True and False, errors ``nan``). Rows without cells
don't come out; ``row_idx`` is a row's place in its sheet. A workbook without sheets gives no rows. A file that is not a
workbook, is larger than ``most``, or unpacks beyond ``UNPACKED`` is an error, as is a cell outside a sheet's bounds.
Files are opened by pyarrow, so it must know the file system.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from array import array
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concordat.functions.cell_formats import BUILT_IN, plain, shown as shown_text
from concordat.schemas import SchemaError
from concordat.stages import written

CELLS = "file string, sheet string, sheet_idx int, row_idx long, cells array<string>"
SHEETS = "file string, sheet string, sheet_idx int, part string, size long"
UNPACKED = 4 << 30  # bytes of one part
STRINGS = 1 << 30  # bytes of a workbook's shared strings, which a task holds
TASK = 32 << 20  # unpacked bytes that one task is meant to read
ROWS, COLUMNS, BATCH = 1 << 20, 1 << 14, 4096
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_C, _V, _T = f"{_MAIN}c", f"{_MAIN}v", f"{_MAIN}t"
_TYPE = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("sheet_idx", pa.int32()), ("row_idx", pa.int64()), ("cells", pa.list_(pa.string()))])


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """A path as Spark gives it: the file system and the path there."""
    url = urlsplit(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    system, root = fs.FileSystem.from_uri(f"{url.scheme}://{url.netloc}/")
    return system, f"{root.rstrip('/')}/{path[len(url.scheme) + 3 + len(url.netloc):].lstrip('/')}"


def opened(path: str):  # noqa: ANN201
    system, place = _place(path)
    return system.open_input_file(place)


def _column(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _elements(z: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a name in a part, one at a time; what has been read is let go."""
    if z.getinfo(part).file_size > UNPACKED:  # the archive gives no more than it declares
        raise SchemaError(f"{part}: {z.getinfo(part).file_size} bytes unpacked")
    with z.open(part) as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == tag:
                yield e
                e.clear()


def outline(path: str, z: zipfile.ZipFile) -> Iterator[tuple[str, str, int, str, int]]:
    """(file, sheet, number, part, unpacked bytes) of every sheet, in workbook order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for i, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
        target = targets[sheet.get(f"{_REL}id")].lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        if part.startswith("xl/worksheets/"):  # others are charts and macros
            yield path, sheet.get("name"), i, part, z.getinfo(part).file_size


class Strings:
    """The shared strings of a workbook: one buffer and where each of them ends."""

    def __init__(self, z: zipfile.ZipFile) -> None:
        self.buffer, self.ends = bytearray(), array("q", [0])
        if "xl/sharedStrings.xml" in z.namelist():
            if z.getinfo("xl/sharedStrings.xml").file_size > STRINGS:
                raise SchemaError(f"shared strings: {z.getinfo('xl/sharedStrings.xml').file_size} bytes unpacked")
            for item in _elements(z, "xl/sharedStrings.xml", f"{_MAIN}si"):
                self.buffer += _text(item).encode()
                self.ends.append(len(self.buffer))

    def __getitem__(self, i: int) -> str:
        return self.buffer[self.ends[i] : self.ends[i + 1]].decode()


def _text(item: ElementTree.Element | None) -> str:
    """A text and its formatted runs, without the phonetic ones."""
    if item is None or (len(item) == 1 and item[0].tag == _T):
        return "" if item is None else item[0].text or ""
    return "".join(t.text or "" for t in (*item.findall(f"{_MAIN}t"), *item.findall(f"{_MAIN}r/{_MAIN}t")))


def formats(z: zipfile.ZipFile) -> tuple[list[str], bool]:
    """The format code of every cell style, and whether days count from 1904."""
    codes, out = dict(BUILT_IN), []
    if "xl/styles.xml" in z.namelist():
        styles = ElementTree.fromstring(z.read("xl/styles.xml"))
        codes |= {int(f.get("numFmtId")): f.get("formatCode") for f in styles.findall(f"{_MAIN}numFmts/{_MAIN}numFmt")}
        out = [codes.get(int(x.get("numFmtId") or 0), "General") for x in styles.findall(f"{_MAIN}cellXfs/{_MAIN}xf")]
    properties = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_MAIN}workbookPr")
    return out, properties is not None and properties.get("date1904") in ("1", "true")


class Book:
    """An open workbook with its strings and styles."""

    def __init__(self, z: zipfile.ZipFile, shown: bool) -> None:
        self.z, self.shown, self.strings = z, shown, Strings(z)
        self.codes, self.since_1904 = formats(z)

    def rows(self, part: str) -> Iterator[tuple[int, list[str]]]:
        """(row_idx, cell texts) of a sheet's rows that have cells."""
        at = -1
        for r in _elements(self.z, part, f"{_MAIN}row"):
            at = int(r.get("r")) - 1 if r.get("r") else at + 1
            cells: list[str] = []
            for c in r:
                if c.tag != _C:
                    continue
                column = _column(c.get("r")) if c.get("r") else len(cells)
                if column >= COLUMNS or at >= ROWS:
                    raise SchemaError(f"{part}: a cell outside the sheet, row {at + 1}, column {column + 1}")
                cells += [""] * (column + 1 - len(cells))
                cells[column] = self._cell(c)
            if cells:
                yield at, cells

    def _cell(self, c: ElementTree.Element) -> str:
        kind = c.get("t") or "n"
        if kind == "inlineStr":
            return _text(c.find(f"{_MAIN}is"))
        value = next((v.text for v in c if v.tag == _V), None) or ""
        if not value or kind in ("str", "d"):
            return value
        if kind == "s":
            return self.strings[int(value)]
        if kind == "b":
            yes = value in ("1", "true")
            return str(yes).upper() if self.shown else str(yes)
        if kind == "e":
            return "" if self.shown else "nan"
        style = int(c.get("s") or 0)
        code = self.codes[style] if style < len(self.codes) else "General"
        return (shown_text if self.shown else plain)(float(value), code, self.since_1904)


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPE.types, strict=True)], schema=_TYPE)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPE.types, strict=True)], schema=_TYPE)


def find_sheets(spark: SparkSession, paths: list[str], most: int | None = None) -> DataFrame:
    """A row a sheet of all files, written once."""

    def outlined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"], strict=True):
                if most is not None and length > most:
                    # Fixed value: what is said of a large file.
                    raise SchemaError(f"{path.rsplit('/', 1)[-1]}: файл больше {most // 1_000_000} МБ")
                with opened(path) as f, zipfile.ZipFile(f) as z:
                    yield pd.DataFrame(list(outline(path, z)), columns=[c.split()[0] for c in SHEETS.split(", ")])

    files = spark.read.format("binaryFile").load(paths).select("path", "length")  # no content is read
    return written(files.mapInPandas(outlined, SHEETS), "sheets")


def read_cells(spark: SparkSession, paths: list[str], shown: bool = False, most: int | None = None, first: bool = False) -> DataFrame:
    """A row a sheet row, of all sheets or the ``first`` of every file; ``most`` is the largest file in bytes."""
    sheets = find_sheets(spark, paths, most)
    if first:
        sheets = sheets.where("sheet_idx = 0")
    n, size = sheets.selectExpr("count(*)", "coalesce(sum(size), 0)").first()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, size // TASK)))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for file, own in batch.groupby("file"):
                with opened(file) as f, zipfile.ZipFile(f) as z:
                    book = Book(z, shown)
                    for s in own.itertuples():
                        for at, cells in book.rows(s.part):
                            yield file, s.sheet, s.sheet_idx, at, cells

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(b.to_pandas() for b in batches))

    return sheets.repartition(tasks, "file", "sheet_idx").mapInArrow(read, CELLS)


def cell(text: Column | None = None, number: Column | None = None, style: int | None = None) -> Column:
    """A cell for :func:`write_workbooks`."""
    values = {"text": (text, "string"), "number": (number, "double"), "style": (F.lit(style), "int")}
    return F.struct(*((F.lit(None) if v is None else v).cast(t).alias(n) for n, (v, t) in values.items()))


def write_workbooks(rows: DataFrame, folder: str, codes: tuple[str, ...] = ()) -> DataFrame:
    """Writes rows (book, sheet, at, cells: array of structs text, number, style) as ``folder``/book.xlsx; (file, rows) of every book, written once.

    A cell is its text or else its number, shown by a format code (the ``style``-th, none if null); null in both is empty.
    A book is one task's work, and its sheets (by name) and rows (by ``at``) are bounded by what a workbook holds. It is written
    aside and then named, so a task that runs again, or twice at once, leaves one whole file.
    """

    def value(c) -> str | float | tuple[float, int] | None:  # noqa: ANN001
        if c["text"] is not None:
            return c["text"]
        number = None if c["number"] is None else int(c["number"]) if c["number"] == int(c["number"]) else float(c["number"])
        return number if number is None or c["style"] is None else (number, int(c["style"]))

    def put(own: pd.DataFrame) -> pd.DataFrame:
        book = own["book"].iloc[0]
        own = own.sort_values(["sheet", "at"])
        if (most := own.groupby("sheet").size().max()) > ROWS:
            raise SchemaError(f"{book}: a sheet of {most} rows")
        content = workbook({name: ([value(c) for c in cells] for cells in of["cells"]) for name, of in own.groupby("sheet")}, codes)
        system, place = _place(f"{folder}/{book}.xlsx")
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        aside = f"{place.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"  # Spark doesn't list names that begin so
        with system.open_output_stream(aside) as f:
            f.write(content)
        try:
            system.move(aside, place)
        except OSError:  # another attempt was first, and has written the same
            if system.get_file_info(place).type != fs.FileType.File:
                raise
            system.delete_file(aside)
        return pd.DataFrame({"file": [f"{folder}/{book}.xlsx"], "rows": [len(own)]})

    return written(rows.groupBy("book").applyInPandas(put, "file string, rows long"), "workbooks")


def workbook(sheets: dict[str, Iterable[list]], codes: tuple[str, ...] = ()) -> bytes:
    """A workbook of texts, numbers and (number, k) pairs, which are shown by the k-th of the format codes; None is no cell."""
    out = io.BytesIO()
    head, ns = '<?xml version="1.0" encoding="UTF-8"?>', f'xmlns="{_MAIN[1:-1]}"'

    def xml(v) -> str:  # noqa: ANN001
        if v is None:
            return "<c/>"
        if isinstance(v, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        number, style = (v[0], v[1] + 1) if isinstance(v, tuple) else (v, 0)
        return f'<c s="{style}"><v>{number!r}</v></c>'

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook {ns} xmlns:r="{_REL[1:-1]}"><sheets>{listed}</sheets></workbook>')
        relations = "".join(f'<Relationship Id="r{i}" Type="{_REL[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        package = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships {package}>{relations}<Relationship Id="st" Type="{_REL[1:-1]}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'{head}<Relationships {package}><Relationship Id="r1" Type="{_REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/{p}.xml" ContentType="{kind}.{t}+xml"/>' for p, t in [("workbook", "sheet.main"), ("styles", "styles"), *((f"worksheets/sheet{i}", "worksheet") for i in range(1, len(sheets) + 1))])
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{parts}</Types>')
        own = "".join(f"<numFmt numFmtId=\"{164 + k}\" formatCode={quoteattr(c)}/>" for k, c in enumerate(codes))
        styles = "".join(f'<xf numFmtId="{n}" applyNumberFormat="1"/>' for n in (0, *range(164, 164 + len(codes))))
        z.writestr("xl/styles.xml", f'{head}<styleSheet {ns}><numFmts count="{len(codes)}">{own}</numFmts><cellXfs count="{len(codes) + 1}">{styles}</cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f"{head}<worksheet {ns}><sheetData>".encode())
                for r, row in enumerate(rows, 1):
                    f.write(f'<row r="{r}">{"".join(map(xml, row))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()
