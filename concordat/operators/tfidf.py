"""TF-IDF weights in long form, candidate pairs without all-pairs loops, and exact cosines.

Texts are deduplicated by their features before pairing is left to the caller; a vector here belongs to an ``id``.
Two vectors of norm 1 with a product of at least t share a feature among the rarest of each whose remainder has a norm
of at least t, so an inverted index over those prefixes finds every such pair and common features rarely enter it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def vectors(docs: DataFrame, features: Column, cap: int | None = None, unit: bool = True) -> DataFrame:
    """(id, feature, weight, df) of ``docs`` (id, ...): (1 + ln count) * (ln((N + 1) / (df + 1)) + 1), normed if ``unit``.

    ``cap`` keeps the features of highest total count (ties by feature). N counts documents without features too.
    With a column ``copies`` a row stands for so many equal documents.
    """
    docs = docs.withColumn("copies", F.col("copies") if "copies" in docs.columns else F.lit(1))
    counts = docs.select("id", "copies", F.explode(features).alias("feature")).groupBy("id", "feature").agg(F.count("*").alias("c"), F.first("copies").alias("copies"))
    shares = counts.groupBy("feature").agg(F.sum("copies").alias("df"), F.sum(F.col("c") * F.col("copies")).alias("total"))
    if cap:
        shares = shares.orderBy(F.desc("total"), "feature").limit(cap)
    n = docs.select(F.sum("copies").alias("n"))
    weighted = counts.join(shares.select("feature", "df"), "feature").crossJoin(F.broadcast(n))  # one row
    weight = (1 + F.log("c")) * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    out = weighted.select("id", "feature", "df", weight.alias("weight"))
    if unit:
        norms = out.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
        out = out.join(norms, "id").withColumn("weight", F.col("weight") / F.col("norm")).drop("norm")
    return out


def candidates(unit_vectors: DataFrame, least: float) -> DataFrame:
    """(l, r), l < r: every pair with a product of at least ``least``, and some others: pairs that meet in a feature and whose remainders from it on have norms that allow the product."""
    w = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("feature"))
    rest = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(w))  # of this feature and all that are more common
    prefix = unit_vectors.withColumn("rest", rest).where(F.col("rest") >= least - 1e-9)
    left, right = (prefix.select(F.col("id").alias(s), "feature", F.col("rest").alias(f"{s}_rest")) for s in ("l", "r"))
    return left.join(right, "feature").where((F.col("l") < F.col("r")) & (F.col("l_rest") * F.col("r_rest") >= least - 1e-9)).select("l", "r").distinct()


def packed(unit_vectors: DataFrame, name: str) -> DataFrame:
    """(id, name): a vector as one struct of two arrays, features (64-bit hashes, in order) and weights."""
    entries = F.sort_array(F.collect_list(F.struct(F.xxhash64("feature").alias("f"), F.col("weight").alias("w"))))
    rows = unit_vectors.groupBy("id").agg(entries.alias("e"))
    return rows.select("id", F.struct(F.col("e.f").alias("f"), F.col("e.w").alias("w")).alias(name))


@pandas_udf(DoubleType())
def _dots(af: pd.Series, aw: pd.Series, bf: pd.Series, bw: pd.Series) -> pd.Series:
    out = np.zeros(len(af))
    for k, (f, v, g, w) in enumerate(zip(af, aw, bf, bw, strict=True)):
        if f is not None and g is not None and len(f) and len(g):
            at = np.minimum(np.searchsorted(f, g), len(f) - 1)
            same = f[at] == g
            out[k] = float((v[at[same]] * w[same]).sum())
    return pd.Series(out)


def dot(a: Column, b: Column) -> Column:
    """Product of two packed vectors; a missing one is zero. Both are in order of features, so a look-up is a binary search, and the sum doesn't depend on partitions."""
    return _dots(a["f"], a["w"], b["f"], b["w"])
