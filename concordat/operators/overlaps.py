"""Exact candidate pairs for token-set similarity and for technical conflicts, without pairing all texts that share a word.

A token-set ratio of t percent is reached in one of two ways (x and y are the texts' different tokens, joined by spaces).

* What is shared holds most of one side: 100 * (1 - (1 + rest) / (2 * shared + 1 + rest)) >= t. With a weight of
  length + 1 a token, the shared weight is then at least ``1 + t / (200 - t) * (weight - 1)`` of that side's. Of that side's
  tokens, rarest first, one of those must be shared behind which too little weight would be left (:func:`contained_pairs`);
  both sides must still have the needed weight from the shared token on, which is checked in the join, and the exact
  weight after it. Containment is the case without a rest.
* All characters align: the shorter common subsequence of both sorted strings, or of their rests, leaves at most
  (1 - t / 100) of the characters. Then at least t / 200 * (|x| + |y|) numbered characters (the second "a" is one of
  its own) are shared. The rarest of each side meet; in the join, lengths, what is left behind the shared character, and a
  bitmap of all numbered characters (different bits are different characters) must allow it
  (:func:`aligned_pairs`).

A technical conflict needs stems of one family on both sides, not the same ones, and two shared tokens that say something.
Only texts with such stems are indexed, by family and by each token but their commonest (the rarer of two shared tokens
is no text's commonest); :func:`opposed_pairs`.

All three return every pair that the rule holds for, as (l, r) with l < r by id, each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from concordat.functions import similarity as sim
from concordat.stages import written

WORDS = 16  # of the bitmap, 64 bits each: a few hundred numbered characters are in use, so few share a bit
EPS = 1e-9


def _tokens(column: str) -> Column:
    return F.filter(F.array_distinct(F.split(column, " ")), lambda t: t != "")


def _ordered(rows: DataFrame, item: str) -> DataFrame:
    """``rows`` (id, item and others) with df, the number of ids that have the item."""
    return rows.join(rows.groupBy(item).agg(F.count("*").alias("df")), item)


def _each_once(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct()


def contained_pairs(texts: DataFrame, column: str, least: float) -> DataFrame:
    """Pairs of ``texts`` (id, column) of which one's weight is shared to the share that ``least`` percent needs."""
    part = least / (200 - least)
    tokens = texts.select("id", F.explode(_tokens(column)).alias("token")).withColumn("weight", F.length("token") + 1)
    own = Window.partitionBy("id")
    rows = _ordered(tokens, "token").withColumns({
        "rest": F.sum("weight").over(own.orderBy(F.desc("df"), F.desc("token"))),  # of this token and all that are commoner
        "needed": 1 + part * (F.sum("weight").over(own) - 1),
    })
    rows = written(rows.select("id", "token", "rest", "needed"), "weighted-tokens")
    left = rows.where(F.col("rest") >= F.col("needed") - EPS).select(F.col("id").alias("l"), "token", "needed")
    right = rows.select(F.col("id").alias("r"), "token", F.col("rest").alias("behind"))
    met = left.join(right, "token").where((F.col("l") != F.col("r")) & (F.col("behind") >= F.col("needed") - EPS))
    pairs = _each_once(met)
    for side in ("l", "r"):
        lists = texts.select(F.col("id").alias(side), _tokens(column).alias(f"{side}t"))
        pairs = pairs.join(lists, side)
    weight = lambda tokens: F.aggregate(tokens, F.lit(0), lambda n, t: n + F.length(t) + 1)
    lighter = F.least(weight(F.col("lt")), weight(F.col("rt")))
    shared = weight(F.array_intersect("lt", "rt"))
    return pairs.where(shared >= 1 + part * (lighter - 1) - EPS).select("l", "r")


def aligned_pairs(texts: DataFrame, column: str, least: float) -> DataFrame:
    """Pairs whose numbered characters can align to ``least`` percent, up to what the bitmap can't tell."""
    t = least / 100
    joined = F.array_join(F.array_sort(_tokens(column)), " ")
    chars = texts.select("id", joined.alias("s")).where("s <> ''").select("id", F.length("s").alias("n"), F.explode(F.filter(F.split("s", ""), lambda c: c != "")).alias("c"))
    counted = chars.groupBy("id", "n", "c").agg(F.count("*").cast("int").alias("k"))
    items = counted.select("id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.xxhash64("c", i))).alias("item"))
    own = Window.partitionBy("id")
    bit = lambda w: F.bit_or(F.when(F.pmod(F.shiftright("item", 8), F.lit(WORDS)) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("item", F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))).over(own)
    rows = _ordered(items, "item").withColumns({f"b{w}": bit(w) for w in range(WORDS)} | {"at": F.row_number().over(own.orderBy("df", "item"))})
    fewest = F.ceil(t / (2 - t) * F.col("n") - EPS)  # shared with the shortest partner that can do
    rows = written(rows.where(F.col("at") <= F.col("n") - fewest + 1).select("id", "n", "item", "at", *(f"b{w}" for w in range(WORDS))), "rare-characters")
    left, right = (rows.select("item", *(F.col(c).alias(f"{s}_{c}") for c in rows.columns if c != "item")) for s in ("l", "r"))
    shared = t / 2 * (F.col("l_n") + F.col("r_n")) - EPS
    left_over = lambda s: F.col(f"{s}_n") - F.col(f"{s}_at") + 1
    differ = sum((F.bit_count(F.col(f"l_b{w}").bitwiseXOR(F.col(f"r_b{w}"))) for w in range(WORDS)), F.lit(0))
    met = left.join(right, "item").where((F.col("l_id") < F.col("r_id")) & (F.least(left_over("l"), left_over("r")) >= shared) & (differ <= F.col("l_n") + F.col("r_n") - 2 * shared))
    return met.select(F.col("l_id").alias("l"), F.col("r_id").alias("r")).distinct()


def opposed_pairs(texts: DataFrame, raw: DataFrame, column: str, families: list[tuple[str, ...]] = sim.QUALIFIERS) -> DataFrame:
    """Pairs of ``texts`` (id, column) with two meaningful tokens in common whose raw texts (``raw``: id, text) hold different stems of a family."""
    low = F.lower("text")
    held = F.array(*(F.struct(F.lit(k).alias("family"), F.array_join(F.filter(F.array(*(F.lit(s) for s in family)), lambda s: F.contains(low, s)), "|").alias("stems")) for k, family in enumerate(families)))
    stems = raw.select("id", F.explode(held).alias("h")).select("id", "h.*").where("stems <> ''").distinct()
    said = F.array_except(_tokens(column), F.array(*(F.lit(w) for w in sim.STOPWORDS)))
    lists = texts.join(stems.select("id").distinct(), "id", "left_semi").select("id", said.alias("said"))
    tokens = lists.select("id", F.explode("said").alias("token"))
    commonest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("df"), F.desc("token")))
    rows = _ordered(tokens, "token").withColumn("nth", commonest).where("nth > 1").select("id", "token")
    rows = written(rows.join(stems, "id"), "stem-tokens")
    left, right = (rows.select("family", "token", F.col("id").alias(s), F.col("stems").alias(f"{s}_stems")) for s in ("l", "r"))
    pairs = left.join(right, ["family", "token"]).where("l < r AND l_stems <> r_stems").select("l", "r").distinct()
    for side in ("l", "r"):
        pairs = pairs.join(lists.select(F.col("id").alias(side), F.col("said").alias(f"{side}_said")), side)
    return pairs.where(F.size(F.array_intersect("l_said", "r_said")) >= 2).select("l", "r")
