"""Strict readers of both document kinds: CSV records found in parallel and parsed by Spark, spreadsheets by ours, then checks and parsing.

Rows carry ``row_idx``, their place in the input: file by file, line by line. It is a file's ordinal and the row's
number in the file, so it needs no global numbering and stays the same whatever the partitions.
"""

from __future__ import annotations

from pathlib import PurePosixPath
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from concordat.functions.numbers import parse_strict, stripped
from concordat.schemas import COLUMNS, KINDS, NUMBERS, POSITION_COLUMNS, REQUISITE_COLUMNS, SchemaError
from concordat.sources.csv_records import read_csv
from concordat.sources.xlsx import read_cells
from concordat.stages import written

FILE_ROWS = 1 << 33  # row_idx leaves room for so many rows a file
SHOWN = 1000  # lines that an error lists
# What is said of a document with a wrong value, in this order.
MESSAGES = {"bin": "БИН должен содержать 12 цифр", "bik": "БИК должен содержать 8 букв/цифр", "account_number": "ИИК должен быть 20-символьным KZ-форматом"}


def read_raw(spark: SparkSession, path: str, name: str | None = None, ordinal: int = 0) -> DataFrame:
    """All cells of a file as strings under its header, null cells as empty ones."""
    suffix = PurePosixPath(name or path).suffix.lower()
    if suffix == ".csv":
        raw = read_csv(spark, path)
        return raw.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns if c != "row_idx"), (F.lit(ordinal * FILE_ROWS) + F.col("row_idx")).alias("row_idx"))
    if suffix in (".xlsx", ".xlsm"):
        cells = read_cells(spark, [path], first=True).select("row_idx", "cells")
        header = cells.where("row_idx = 0").first()
        names = header["cells"] if header else []
        body = cells.where("row_idx > 0 AND exists(cells, c -> c <> '')")
        return body.select(*(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)), (F.lit(ordinal * FILE_ROWS) + F.col("row_idx") - 1).alias("row_idx"))
    raise SchemaError("Поддерживаются только файлы CSV и XLSX.")


def validated(raw: DataFrame, kind: str) -> DataFrame:
    """The kind's columns in order, trimmed. Missing columns are an error; whether there are rows is seen when they are read."""
    # This message, those of accepted() and the patterns of rules().
    required = COLUMNS[kind]
    if missing := [c for c in required if c not in raw.columns]:
        raise SchemaError(f"В документе «{KINDS[kind]}» отсутствуют поля: {', '.join(missing)}")
    return raw.select("row_idx", *(stripped(F.col(c)).alias(c) for c in required))


class Checked(NamedTuple):
    """What one pass over a document found: the rows without a problem, the problems of the others, and how many of each there are."""

    rows: DataFrame
    problems: DataFrame  # row_idx, line, column, value
    counts: dict[str, int]  # of every checked column, and "rows" for all rows


def rules(kind: str) -> dict[str, Column]:
    """The checked columns of a kind, and when a value is wrong."""
    if kind == "estimate":
        return {c: parse_strict(F.col(c)).isNull() for c in NUMBERS}
    compact = lambda c: F.regexp_replace(c, r"(?U)[\s-]", "")
    return {
        "bin": ~F.regexp_replace("bin", r"(?U)\D", "").rlike(r"^[0-9]{12}\z"),
        "bik": ~compact("bik").rlike(r"^[A-Za-z0-9]{8}\z"),
        "account_number": ~compact("account_number").rlike(r"(?i)^(KZ)?[A-Za-z0-9]{18,20}\z"),
    }


def checked(rows: DataFrame, kind: str) -> Checked:
    """All checks of a kind in the pass that reads the rows: they are written once, with what is wrong with each, and counted as they are written."""
    wrong = {c: F.coalesce(broken, F.lit(True)) for c, broken in rules(kind).items()}
    marked = rows.withColumn("_wrong", F.array_compact(F.array(*(F.when(broken, F.lit(c)) for c, broken in wrong.items()))))
    seen = Observation()
    counted = marked.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.array_contains("_wrong", c)).alias(c) for c in wrong))
    table = written(counted, "checked-rows")
    sound = table.where(F.size("_wrong") == 0).drop("_wrong")
    if kind == "estimate":
        sound = sound.withColumns({c: parse_strict(F.col(c)) for c in NUMBERS})
    broken = table.select("row_idx", (F.col("row_idx") % FILE_ROWS + 2).cast("long").alias("line"), F.explode("_wrong").alias("column"), F.create_map(*(x for c in wrong for x in (F.lit(c), F.col(c)))).alias("_values"))
    return Checked(sound, broken.select("row_idx", "line", "column", F.col("_values")[F.col("column")].alias("value")), seen.get)


def accepted(found: Checked, kind: str) -> DataFrame:
    """The rows of a document without problems; one that has any, or no rows, is an error."""
    if not found.counts["rows"]:
        raise SchemaError(f"Документ «{KINDS[kind]}» не содержит строк данных.")
    if kind == "estimate":
        for column in NUMBERS:
            if n := found.counts[column]:
                lines = [r["line"] for r in found.problems.where(F.col("column") == column).orderBy("line").limit(SHOWN).select("line").collect()]
                more = f" и ещё {n - SHOWN}" if n > SHOWN else ""
                raise SchemaError(f"Поле {column} должно быть числом; ошибки в строках {lines}{more}.")
    elif problems := [MESSAGES[c] for c in MESSAGES if found.counts[c]]:
        raise SchemaError("; ".join(problems) + ".")
    return found.rows


def parsed_positions(rows: DataFrame) -> DataFrame:
    """Positions with numbers; rows that hold none are reported by their line, of the first column that has any."""
    return accepted(checked(rows, "estimate"), "estimate")


def checked_requisites(rows: DataFrame) -> DataFrame:
    return accepted(checked(rows, "requisite"), "requisite")


def read_checked(spark: SparkSession, kind: str, *paths: str) -> list[Checked]:
    """Documents of a kind with what is wrong in them, one :class:`Checked` a path."""
    return [checked(validated(read_raw(spark, p, ordinal=i), kind), kind) for i, p in enumerate(paths)]


def read_positions(spark: SparkSession, *paths: str) -> DataFrame:
    return _union([accepted(c, "estimate") for c in read_checked(spark, "estimate", *paths)])


def read_requisites(spark: SparkSession, *paths: str) -> DataFrame:
    return _union([accepted(c, "requisite") for c in read_checked(spark, "requisite", *paths)])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def demo_rows(spark: SparkSession, kind: str, rows: list[tuple]) -> DataFrame:
    """Literal rows of a kind, numbered in order."""
    columns = POSITION_COLUMNS if kind == "estimate" else REQUISITE_COLUMNS
    return spark.createDataFrame([(i, *map(str, r)) for i, r in enumerate(rows)], ", ".join(["row_idx long", *(f"{c} string" for c in columns)]))


def checked_request(rows: DataFrame, kind: str, least: int = 2, most: int | None = None) -> DataFrame:
    """Rows of a request: every field present, a number of rows within bounds (``most`` is a deployment's choice)."""
    if missing := [c for c in COLUMNS[kind] if c not in rows.columns]:
        raise SchemaError(f"missing fields: {', '.join(missing)}")
    n = rows.limit((most or least) + 1).count()
    if n < least or (most is not None and n > most):
        raise SchemaError(f"between {least} and {most or 'any number of'} rows are needed")
    return rows
