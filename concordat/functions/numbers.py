"""Numbers, ids and conflict measures of both rule sets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from concordat.functions.text import strip, text

NUMERIC_THRESHOLD = 0.15
_NUMBER = r"^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$"


def parse_strict(c: Column) -> Column:
    """A number after removing spaces and with a comma for a point; null if it isn't one."""
    plain = F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double"))


def parse_lenient(c: Column) -> Column:
    """Web: the digits, signs and points of the text; 0 if they are no number."""
    plain = F.regexp_replace(text(c), r"(?U)\s", "")
    plain = F.regexp_replace(F.regexp_replace(plain, "^([^,]*),", "$1."), "[^0-9.+-]", "")
    return F.when(plain.rlike(r"^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"), plain.try_cast("double")).otherwise(F.lit(0.0))


def percent_difference(a: Column, b: Column) -> Column:
    """Classic: relative to the larger; 1 between zero and anything else."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))


def percent(a: Column, b: Column) -> Column:
    """Web: 0 if either side is 0."""
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)))


def numeric_conflict(left: dict[str, Column], right: dict[str, Column]) -> dict[str, Column]:
    """Classic comparison of unit category, quantity and price."""
    mismatch = (left["unit_category"] != right["unit_category"]) | (left["unit_category"] == "unknown") | (right["unit_category"] == "unknown")
    quantity, price = (percent_difference(left[c], right[c]) for c in ("quantity", "unit_price"))
    return {"unit_mismatch": mismatch, "quantity_diff_pct": quantity, "price_diff_pct": price, "has_numeric_conflict": mismatch | (quantity > NUMERIC_THRESHOLD) | (price > NUMERIC_THRESHOLD)}


def _plain(c: Column, digits: int) -> Column:
    """Whether a number is in a range, and far enough from the middle between two roundings, for whole-number arithmetic."""
    scaled = c * 10**digits
    return (c >= 0) & (c < 1e6) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6)


def fixed(c: Column, digits: int) -> Column:
    """``format_string("%.<digits>f", c)`` of a double, null for null, without the sign of a negative zero; a fraction of its cost."""
    whole = F.floor(c * 10**digits + 0.5)
    rest = (whole % 10**digits).cast("string")
    shown = F.concat(F.floor(whole / 10**digits).cast("string"), F.lit("."), rest if digits == 1 else F.lpad(rest, digits, "0"))
    return F.when(_plain(c, digits), shown).when(c.isNotNull(), F.format_string(f"%.{digits}f", c))


def rounded(c: Column, digits: int) -> Column:
    """``round(c, digits)`` of a double; a fraction of its cost."""
    return F.when(_plain(c, digits), F.floor(c * 10**digits + 0.5) / 10**digits).otherwise(F.round(c, digits))


def pct(c: Column) -> Column:
    return F.concat(F.replace(F.format_string("%.1f", c * 100), F.lit("."), F.lit(",")), F.lit("%"))


def format_number(c: Column) -> Column:
    """Groups of three set off by no-break spaces, a decimal comma, three decimals at most."""
    shown = F.translate(F.format_number(c, 3), ",.", " ,")
    return F.regexp_replace(F.regexp_replace(shown, "0+$", ""), ",$", "")


def fnv_id(c: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units, in base 36."""
    unit = lambda ch: F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("long")
    high = lambda u: F.when(u > 65535, F.array(F.shiftright(u, 16), u.bitwiseAND(65535))).otherwise(F.array(u))
    units = F.flatten(F.transform(F.filter(F.split(c, ""), lambda s: s != ""), lambda s: high(unit(s))))
    folded = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.conv(folded.cast("string"), 10, 36)


def stripped(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))
