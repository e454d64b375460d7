"""Requests and responses as JSON: bodies with rows in, results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from concordat.functions.text import once
from concordat.schemas import COLUMNS

LEAST_ROWS, MOST_ROWS, MOST_BYTES = 2, 500, 2_000_000


def read_requests(bodies: DataFrame, kind: str, key: str = "request", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Bodies (a key and the JSON text) to their rows (key, row_idx, the kind's columns as strings), and (key, problem) of those refused.

    A body is refused if it is too long, holds no array of rows, too few or too many, or a row without one of the columns.
    """
    columns = COLUMNS[kind]
    parsed = F.from_json(F.get_json_object(body, "$.rows"), "array<map<string,string>>")
    size = F.octet_length(F.coalesce(F.col(body), F.lit("")))
    missing = lambda r: F.size(F.array_intersect(F.map_keys(r), F.array(*(F.lit(c) for c in columns)))) < len(columns)
    lacking = lambda rows: F.exists(rows, lambda r: r.isNull() | missing(r))
    judged = lambda rows: F.when(size > MOST_BYTES, "too_long").when(rows.isNull() | ~F.size(rows).between(LEAST_ROWS, MOST_ROWS), "row_count").when(lacking(rows), "missing_fields")
    # A body is parsed once: what is named by a lambda isn't computed anew where it is named again.
    found = once(parsed, judged)
    checked = bodies.select(F.col(key), once(parsed, lambda rows: F.struct(rows.alias("rows"), judged(rows).alias("problem"))).alias("c"))
    rows = checked.select(key, F.posexplode(F.when(F.col("c.problem").isNull(), F.col("c.rows"))).alias("row_idx", "r"))
    rows = rows.select(key, F.col("row_idx").cast("long").alias("row_idx"), *(F.coalesce(F.col("r")[c], F.lit("")).alias(c) for c in columns))
    refused = bodies.select(F.col(key), F.explode(F.filter(F.array(found), lambda p: p.isNotNull())).alias("problem"))  # a generator, as a filter would judge twice
    return rows, refused


def as_responses(results: DataFrame, key: str, order: str, fields: list[str], name: str = "cases") -> DataFrame:
    """(key, response): the results of each key as one JSON object with an array in order."""
    item = F.struct(F.col(order).alias("_order"), *fields)
    listed = F.transform(F.sort_array(F.collect_list(item)), lambda r: F.struct(*(r[f].alias(f) for f in fields)))
    return results.groupBy(key).agg(F.to_json(F.struct(listed.alias(name)), {"ignoreNullFields": "false"}).alias("response"))
