"""Results in a global order, a page or a row at a time, without sorting them into one task.

The result is dealt by ranges of its order and sorted within them, then written once with each range as a folder. How many
rows a range has, a row each, gives every row its ordinal. A page reads the folders that hold its ordinals and no other;
so does the row at an ordinal. Rows that are equal in all order columns are in one range, in no stated order: end the
order with columns that tell rows apart.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cached_property
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, functions as F

from concordat.stages import new_path, written

RANGE = 1 << 20  # rows of a range, which a task sorts
PLACE = (1 << 33) - 1  # monotonically_increasing_id: the partition above, the place in it below


class Ordered:
    """``df`` in the order of ``by`` (columns, as for orderBy)."""

    def __init__(self, df: DataFrame, *by: Column | str, ranges: int | None = None) -> None:
        self._spark = df.sparkSession
        self.path = new_path(self._spark, "ordered")
        df = written(df, "unordered")  # the bounds of the ranges take a pass of their own
        dealt = df.repartitionByRange(ranges or max(self._spark.sparkContext.defaultParallelism, -(-df.count() // RANGE)), *by)
        placed = dealt.sortWithinPartitions(*by).withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(PLACE)})
        placed.write.partitionBy("_range").option("compression", "zstd").parquet(self.path)
        self._schema = placed.schema

    @cached_property
    def _ranges(self) -> tuple[list[int], list[int]]:
        """The ranges that have rows, and the ordinal that each begins with; the number of rows ends the list."""
        counts = sorted((r["_range"], r["count"]) for r in self._stored().groupBy("_range").count().collect())  # a row a range
        return [k for k, _ in counts], list(accumulate((n for _, n in counts), initial=0))

    def _stored(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self.path)

    def _numbered(self, ranges: list[int]) -> DataFrame:
        names, first = self._ranges
        begins = self._spark.createDataFrame([(k, first[i]) for i, k in enumerate(names) if k in set(ranges)], "_range int, _first long")
        own = self._stored().where(F.col("_range").isin(ranges))
        return own.join(F.broadcast(begins), "_range").withColumn("ordinal", F.col("_first") + F.col("_place")).drop("_range", "_place", "_first")  # a row a range

    def __len__(self) -> int:
        return self._ranges[1][-1]

    def rows(self) -> DataFrame:
        """All rows with ``ordinal``, from 0."""
        return self._numbered(self._ranges[0])

    def page(self, first: int, size: int) -> DataFrame:
        """Rows first to first + size - 1 by ordinal, in order; read from the ranges that hold them."""
        names, begins = self._ranges
        last = min(first + size, len(self))
        held = [k for i, k in enumerate(names) if begins[i] < last and begins[i + 1] > first]
        return self._numbered(held).where((F.col("ordinal") >= first) & (F.col("ordinal") < last)).orderBy("ordinal")

    def row(self, ordinal: int) -> Row:
        """The row at an ordinal, from one range."""
        if not 0 <= ordinal < len(self):
            raise IndexError(ordinal)
        names, begins = self._ranges
        return self._numbered([names[bisect_right(begins, ordinal) - 1]]).where(F.col("ordinal") == ordinal).first()
