"""String and set similarity. Longest common subsequences run bit-parallel in Arrow batches; the rest are expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from concordat.functions.text import normalize, once, tokens

# Stems of which two may not both describe one position, stop words, and opposed parts of words.
QUALIFIERS = [("силов", "оптическ", "слаботочн"), ("холодн", "горяч"), ("металлическ", "деревянн"), ("газоблок", "кирпичн"), ("прямоугольн", "кругл")]
STOPWORDS = ("в", "на", "по", "из", "для", "и", "внутри", "внутренний")
TRAPS = [("силовой", "оптический"), ("горяч", "холод"), ("внутрен", "наруж"), ("демонтаж", "монтаж"), ("подающ", "обратн"), ("лев", "прав"), ("ручн", "механиз"), ("нов", "ремонт")]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest one, with a bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    free = (1 << len(a)) - 1
    full = free
    for ch in b:
        hit = free & where.get(ch, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / total if total else 100.0


def token_set(a: str, b: str) -> float:
    """The best of comparing what is shared, what is shared plus one rest each, and both; 0 if a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    if not both:
        return indel_ratio(left, right)
    n = len(both) + 1  # and the space that joins a rest to it
    full = 2 * n + len(left) + len(right)
    best = 100.0 * (1 - (len(left) + len(right) - 2 * common_subsequence(left, right)) / full)
    return max(best, *(100.0 * (1 - (1 + len(rest)) / (2 * len(both) + 1 + len(rest))) for rest in (left, right)))


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x or "", y or "") for x, y in zip(a, b, strict=True)])


def _held(stems: Column, text: Column) -> Column:
    return F.filter(stems, lambda s: F.contains(text, s))


def technical_conflict(a: Column, b: Column, families: list[tuple[str, ...]] = QUALIFIERS) -> Column:
    """Why two raw texts can't be one position, or null: both name stems of a family, but not the same ones."""
    a, b = F.lower(a), F.lower(b)
    found = []  # the message below is a fixed value
    for family in families:
        stems = F.array(*(F.lit(s) for s in sorted(family)))
        x, y = _held(stems, a), _held(stems, b)
        joint = F.array_join(F.array_sort(F.array_union(x, y)), ", ")
        found.append(F.when((F.size(x) > 0) & (F.size(y) > 0) & (x != y), F.concat(F.lit("несовместимые технические признаки: "), joint)))
    return F.coalesce(*found)


def meaningful_overlap(a: Column, b: Column) -> Column:
    shared = F.array_intersect(F.split(a, " "), F.split(b, " "))
    return F.size(F.array_except(shared, F.array(*(F.lit(w) for w in (*STOPWORDS, "")))))


def has_trap(a: Column, b: Column, traps: list[tuple[str, str]] = TRAPS) -> Column:
    out = F.lit(False)
    for x, y in traps:
        out = out | (F.contains(a, F.lit(x)) & F.contains(b, F.lit(y))) | (F.contains(a, F.lit(y)) & F.contains(b, F.lit(x)))
    return out


def name_tokens(c: Column) -> Column:
    """Web: the name without Latin legal forms (``plain``), and its token set (``words``), as a struct."""
    border = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    forms = "(?:тоо|ао|ип|llp|ltd)"
    plain = once(normalize(c), lambda n: F.trim(F.when(n.rlike(forms), F.regexp_replace(n, f"{border}{forms}{border}", "")).otherwise(n)))
    return once(plain, lambda p: F.struct(p.alias("plain"), F.array_distinct(tokens(normalize(p))).alias("words")))


def token_similarity(a: Column, b: Column) -> Column:
    """Web: of two names as from :func:`name_tokens`."""
    s, t = a["words"], b["words"]
    return F.when(a["plain"] == b["plain"], F.lit(1.0)).otherwise(F.size(F.array_intersect(s, t)) / F.greatest(F.size(F.array_union(s, t)), F.lit(1)))


def name_similarity(a: Column, b: Column) -> Column:
    return once(F.struct(name_tokens(a).alias("a"), name_tokens(b).alias("b")), lambda n: token_similarity(n["a"], n["b"]))
