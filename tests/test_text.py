from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from concordat.functions import numbers, similarity as sim, text as tx


def one(spark, value, *exprs):
    df = spark.createDataFrame([(value,)], "v string")
    row = df.select(*(e(F.col("v")).alias(f"c{i}") for i, e in enumerate(exprs))).first()
    return row[0] if len(exprs) == 1 else tuple(row)


@pytest.mark.parametrize(("raw", "expected"), [
    ("Установка  Светодиодных светильников", "монтаж led светильник"),
    ("Установка светодиодных светильников LED", "монтаж led светильник led"),
    ("Ёмкость, м²", "емкость м2"),
    ("ﬁлм", "fiлм"),
    (None, ""),
    ("—", ""),
])
def test_normalize_text(spark, raw, expected):
    assert one(spark, raw, tx.normalize_text) == expected


@pytest.mark.parametrize(("raw", "category", "canonical"), [("кв.м", "area", "м2"), ("м²", "area", "м2"), ("п.м", "length", "м"), ("дана.", "count", "шт"), ("метров", "length", "м"), ("т", "unknown", "т"), ("", "unknown", "—"), ("KG", "weight", "кг")])
def test_normalize_unit(spark, raw, category, canonical):
    assert one(spark, raw, lambda c: tx.normalize_unit(c)[0], lambda c: tx.normalize_unit(c)[1]) == (category, canonical)


def test_names_and_words(spark):
    assert one(spark, "ТОО «Құрылыс-Сервис»", tx.normalize_name) == "курылыссервис"
    assert one(spark, "KZ 12–34 a", tx.normalize_compact) == "KZ1234A"
    assert one(spark, "г. Алматы,  ул.Абая", tx.normalize_words) == "г алматы ул абая"


def test_web_rules_keep_cyrillic_words_beside_ascii_borders(spark):
    assert one(spark, "Монтаж бордюрного камня", tx.normalize) == "монтаж бортовой камень"
    assert one(spark, "работа", tx.normalize) == "работа"
    assert one(spark, "Бетонное основание / окраска", tx.normalize) == "бетон основание покраска"
    assert one(spark, "п.м", tx.unit_category) == "length" and one(spark, "т", tx.unit_category) == "weight"
    assert one(spark, "метров", tx.unit_category) == "метров" and one(spark, "", tx.unit_category) == "unknown"


def test_features(spark):
    assert one(spark, "ab c de", tx.tokens) == ["ab", "de", "ab_de"]
    assert one(spark, "ab", tx.grams) == [" ab", "ab ", " ab "]
    assert one(spark, "ab c de", tx.word_features) == ["ab", "de", "ab de"]
    assert one(spark, "ab c", tx.char_features) == [" ab", "ab ", " ab ", " c "]
    assert one(spark, "", tx.char_features) == [] == one(spark, "", tx.word_features)


@pytest.mark.parametrize(("raw", "strict", "lenient"), [("1 234,5", 1234.5, 1234.5), ("5d", None, 5.0), ("1.234,5", None, 0.0), ("", None, 0.0), ("1e5", 100000.0, 15.0), ("12-5", None, 0.0), ("-3", -3.0, -3.0), ("7 ₸", None, 7.0)])
def test_numbers(spark, raw, strict, lenient):
    assert one(spark, raw, numbers.parse_strict, numbers.parse_lenient) == (strict, lenient)


def test_number_format_and_ids(spark):
    assert spark.range(1).select(numbers.format_number(F.lit(1234567.5))).first()[0] == "1 234 567,5"
    assert spark.range(1).select(numbers.pct(F.lit(0.2593))).first()[0] == "25,9%"

    def fnv(text):
        h = 2166136261
        raw = text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619 & 0xFFFFFFFF
        out = ""
        while h:
            h, d = divmod(h, 36)
            out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d] + out
        return out

    for text in ("EST-01|1|2", "Смета", "a😀"):
        assert one(spark, text, numbers.fnv_id) == fnv(text)


def test_percent(spark):
    row = spark.range(1).select(numbers.percent_difference(F.lit(0.0), F.lit(3.0)), numbers.percent(F.lit(0.0), F.lit(3.0)), numbers.percent_difference(F.lit(0.0), F.lit(0.0)), numbers.percent(F.lit(100.0), F.lit(84.0))).first()
    assert list(row) == [1.0, 0.0, 0.0, pytest.approx(0.16)]


def test_string_similarity():
    assert sim.indel_ratio("", "") == 100 and sim.indel_ratio("abc", "abd") == pytest.approx(66.6666667)
    assert sim.indel_ratio("a" * 100 + "b", "a" * 100) == pytest.approx(20000 / 201)
    assert sim.token_set("a b", "b a c") == 100 and sim.token_set("", "a") == 0
    assert sim.token_set("решетка вентиляционная монтаж", "воздуховод вентиляционная монтаж") > 60


def test_conflict_and_overlap(spark):
    df = spark.createDataFrame([("Силовой кабель в лотке", "Оптический кабель в лотке"), ("кабель", "оптический"), ("силовой", "силовой")], "a string, b string")
    rows = df.select(sim.technical_conflict(F.col("a"), F.col("b")), sim.meaningful_overlap(F.lower("a"), F.lower("b")), sim.has_trap(F.lower("a"), F.lower("b"))).collect()
    assert tuple(rows[0]) == ("несовместимые технические признаки: оптическ, силов", 2, True) and rows[1][0] is None and rows[2][0] is None
    assert spark.range(1).select(sim.has_trap(F.lit("демонтаж стен"), F.lit("демонтаж окон"))).first()[0]
