"""Text normalisation of both rule sets. "classic" and "web" rules share schemas, not results."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The phrase and word synonyms of the classic rules.
PHRASES = {
    "укладка кабельной силовой линии по лоткам": "монтаж силовой кабель лоток",
    "прокладка силового кабеля в лотке": "монтаж силовой кабель лоток",
    "монтаж оптического кабеля внутри здания": "монтаж оптический кабель помещение",
    "прокладка волоконно оптической линии в помещении": "монтаж оптический кабель помещение",
    "устройство бетонной стяжки пола": "бетон стяжка пол устройство",
    "еденге бетон тегістеу қабатын жасау": "бетон стяжка пол устройство",
    "окраска металлических конструкций": "окраска металл конструкция",
    "металл құрылымдарды сырлау": "окраска металл конструкция",
    "монтаж стальных радиаторов отопления": "монтаж радиатор отопление",
    "жылыту радиаторларын орнату": "монтаж радиатор отопление",
    "установка светодиодных светильников": "монтаж led светильник",
    "монтаж led светильников потолочных": "монтаж led светильник",
}
SYNONYMS = {"установка": "монтаж", "устройство": "монтаж", "укладка": "монтаж", "прокладка": "монтаж", "светодиодных": "led", "светильников": "светильник", "конструкций": "конструкция"}
# Unit categories, their canonical unit and their spellings, classic rules.
UNITS = {
    "length": ("м", ("м", "метр", "метра", "метров", "m", "п.м", "пог.м")),
    "weight": ("кг", ("кг", "килограмм", "килограмма", "килограммов", "kg")),
    "count": ("шт", ("шт", "штука", "штуки", "штук", "дана", "дана.")),
    "area": ("м2", ("м2", "м²", "кв.м", "кв м", "квадратный метр", "m2")),
    "volume": ("м3", ("м3", "м³", "куб.м", "куб м", "кубический метр", "m3")),
}
# The ordered substitutions of the web rules. The first two of its rules stand between ASCII word borders,
# which Cyrillic letters never make, except beside ASCII letters, digits or underscores.
_BORDER = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
SUBSTITUTIONS = [
    (f"{_BORDER}(?:устройство|установка|монтаж|выполнение|работы|работа){_BORDER}", " "),
    (f"{_BORDER}(?:орнату|монтаждау|жұмыстары|жұмыс|құрылғы){_BORDER}", " "),
    (r"бордюрн\S*|бортов\S*", " бортовой "),
    (r"бордюр\s+тас\S*|бортовой\s+кам\S*", " бортовой камень "),
    (r"бетонн\S*\s+основан\S*|бетон\s+негіз\S*", " бетон основание "),
    (r"песчан\S*\s+основан\S*|құм\s+негіз\S*", " песок основание "),
    (r"металл\S*\s+конструкц\S*|металл\s+конструкцияларын", " металлоконструкция "),
    (r"окраск\S*|бояу", " покраска "),
    (r"трубопровод\S*|құбыр\S*", " трубопровод "),
    (r"кабельн\S*|кабель", " кабель "),
    ("оптикалық", " оптический "),
    ("күштік", " силовой "),
    ("дайындау", " "),
]
# How the web rules tell categories of units.
UNIT_PATTERNS = [("length", r"^(м|пм|п\.м|метр|мп)$"), ("area", "^(м2|м²|квм|квадратныйметр)$"), ("volume", "^(м3|м³|кубм|кубическийметр)$"), ("weight", "^(кг|т|тонна|г)$"), ("count", "^(шт|ед|компл|комплект)$")]
_SPACES = r"(?U)\s+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it; a column that is named twice is computed twice."""
    return F.transform(F.array(value), use)[0]


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in entries.items() for x in kv))


@pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(c: Column) -> Column:
    """Compatibility composition. Spark has none; Latin, Cyrillic and common punctuation are stable and stay in the JVM."""
    odd = c.rlike(r"[^\u0000-\u009F¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-žƀ-ǃǝ-ǰǴ-ʯЀ-ӿ–-‟№]")
    return F.coalesce(_nfkc(F.when(odd, c)), c)  # other rows go to Python as nulls


def folded(c: Column) -> Column:
    """Composed, in lower case, ё as е. The classic rules below begin with it, unless told that it is ``done``."""
    return F.replace(F.lower(nfkc(F.coalesce(c, F.lit("")))), F.lit("ё"), F.lit("е"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _classes(c: Column, letters: str) -> Column:
    return F.trim(F.regexp_replace(c, f"[^{letters}]+", " "))


def normalize_text(c: Column, done: bool = False) -> Column:
    """Classic: folded letters and digits; a known phrase becomes its synonym, else each known word does."""

    def known(plain: Column) -> Column:
        words = F.transform(F.split(plain, " "), lambda w: F.coalesce(_map(SYNONYMS)[w], w))
        replaced = F.when(plain.rlike(f"(?:^| )(?:{'|'.join(SYNONYMS)})(?: |$)"), F.array_join(words, " ")).otherwise(plain)
        return F.coalesce(_map(PHRASES)[plain], replaced)

    return once(_classes(c if done else folded(c), "0-9a-zа-яәіңғүұқөһ²³"), known)  # fixed value: the letters that stay


def unit_aliases() -> dict[str, tuple[str, str]]:
    """Spelling without spaces to (category, canonical unit)."""
    folded = lambda s: "".join(ch for ch in unicodedata.normalize("NFKC", s).lower() if ch.isalnum())
    out: dict[str, tuple[str, str]] = {}
    for category, (canonical, spellings) in UNITS.items():
        for s in spellings:
            out.setdefault(folded(s), (category, canonical))
    return out


def normalize_unit(c: Column) -> tuple[Column, Column]:
    """Classic (category, canonical unit); what isn't known is ``unknown`` and its own unit."""
    unit = F.replace(normalize_text(c), F.lit(" "), F.lit(""))
    known = unit_aliases()
    category = F.coalesce(_map({k: v[0] for k, v in known.items()})[unit], F.lit("unknown"))
    own = F.when(unit == "", "—").otherwise(unit)
    return category, F.coalesce(_map({k: v[1] for k, v in known.items()})[unit], own)


def normalize_name(c: Column, done: bool = False) -> Column:
    """Classic: Kazakh letters as Russian ones, legal forms dropped, letters and digits only."""
    # The letters that are replaced, and the legal forms.
    text = F.translate(c if done else folded(c), "құүөғәің", "кууогаин")
    forms = "тоо|too|ао|ao|ип|жшс"
    formless = lambda t: F.when(t.rlike(forms), F.regexp_replace(t, rf"(?U)\b(?:{forms})\b", " ")).otherwise(t)
    return F.regexp_replace(once(text, formless), "[^0-9a-zа-я]+", "")


def normalize_compact(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\-–—]+", ""))


def normalize_words(c: Column, done: bool = False) -> Column:
    return _classes(c if done else folded(c), "0-9a-zа-яәіңғүұқөһ")  # fixed value: the letters that stay


def text(c: Column, most: int = 500) -> Column:
    """Web: trimmed and cut."""
    return F.substring(strip(F.coalesce(c.cast("string"), F.lit(""))), 1, most)


def normalize(c: Column) -> Column:
    out = F.regexp_replace(F.replace(F.lower(text(c)), F.lit("ё"), F.lit("е")), r"[«»“”'\"()\[\],.;:/\\_-]+", " ")

    def substituted(t: Column) -> Column:
        for pattern, put in SUBSTITUTIONS:
            t = F.regexp_replace(t, pattern.replace(r"\s", r"[\s ]").replace(r"\S", r"[^\s ]"), put)
        return t

    out = once(out, lambda t: F.when(t.rlike(r"[\u0400-\u04FF]"), substituted(t)).otherwise(t))  # each pattern has a Cyrillic letter
    return strip(F.regexp_replace(out, _SPACES, " "))


def unit_category(c: Column) -> Column:
    unit = F.regexp_replace(normalize(c), _SPACES, "")
    out = F.when(unit == "", "unknown")
    for name, pattern in UNIT_PATTERNS:
        out = out.when(unit.rlike(pattern), name)
    return out.otherwise(unit)


def word_bigrams(words: Column, joint: str) -> Column:
    """Neighbouring words joined; needs the array as a column."""
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat(a, F.lit(joint), b))).otherwise(F.array().cast("array<string>"))


def tokens(normalized: Column) -> Column:
    words = F.filter(F.split(normalized, " "), lambda w: F.length(w) > 1)
    return once(words, lambda w: F.concat(w, word_bigrams(w, "_")))


def _substrings(s: Column, n: int) -> Column:
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def grams(normalized: Column) -> Column:
    return once(F.concat(F.lit(" "), normalized, F.lit(" ")), lambda padded: F.concat(_substrings(padded, 3), _substrings(padded, 4)))


def word_features(c: Column) -> Column:
    """Classic: words of two characters or more, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1))
    return once(words, lambda w: F.concat(w, word_bigrams(w, " ")))


def char_features(c: Column) -> Column:
    """Classic: 3 to 5 characters inside each padded word; a word no longer than n is taken whole, and no longer n after it."""

    def of_word(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        empty = F.array().cast("array<string>")
        sizes = [F.when(F.length(p) > n, _substrings(p, n)).when(F.length(p) > n - 1 if n > 3 else F.lit(True), F.array(p)).otherwise(empty) for n in (3, 4, 5)]
        return F.concat(*sizes)

    words = F.filter(F.split(F.lower(c), _SPACES), lambda w: w != "")
    return F.flatten(F.transform(words, of_word))
