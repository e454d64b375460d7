"""Filters and listings over pairs, flags and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def filtered(rows: DataFrame, document: str | None = None, **allowed: list[str] | None) -> DataFrame:
    """Rows whose columns hold allowed values (None: any), with the document on either side."""
    for column, values in allowed.items():
        if values is not None:
            rows = rows.where(F.col(column).isin(values))
    return rows if document is None else rows.where((F.col("left_document_id") == document) | (F.col("right_document_id") == document))


def matches(query: Column, columns: list[str]) -> Column:
    """Whether the text of the columns holds the query, whatever the case."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(query))


def find_cases(cases: DataFrame, query: str = "", severity: str | None = None, document: str | None = None) -> DataFrame:
    out = cases.where(matches(F.lit(query), ["title", "subtitle", "difference"])) if query else cases
    out = out.where(F.col("severity") == severity) if severity else out
    return out.where(F.array_contains("documents", document)) if document else out


def document_names(rows: DataFrame) -> DataFrame:
    """Each document on either side, once, in order."""
    both = rows.select(F.col("left_document_id").alias("document_id")).union(rows.select("right_document_id"))
    return both.distinct().orderBy("document_id")


def labelled(rows: DataFrame, column: str, labels: dict[str, str]) -> DataFrame:
    shown = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return rows.withColumn(column, F.coalesce(shown[F.col(column)], F.col(column)))
