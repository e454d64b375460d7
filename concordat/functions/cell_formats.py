"""Numbers of spreadsheet cells as their format code shows them, and as plain values.

A code has up to four sections (positive, negative, zero, text), of which each is digits to fill, parts of a date, or
literals. Colours, fill and padding are dropped; a currency in brackets stays. Dates outside the calendar are empty.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction
from functools import lru_cache

# The codes of format numbers that workbooks don't spell out (ECMA-376, 18.8.30).
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
LAST_DAY = 2958465  # 31 December 9999
_TOKEN = re.compile(
    r'"(?P<quoted>[^"]*)"?|\\(?P<escaped>.)|_(?P<space>.)|\*(?P<fill>.)|\[(?P<elapsed>[hH]+|[mM]+|[sS]+)\]|\[(?P<bracket>[^\]]*)\]'
    r"|(?P<general>[Gg]eneral)|(?P<half>AM/PM|am/pm|A/P|a/p)|(?P<exponent>[Ee][+-])|(?P<date>[yY]+|[mM]+|[dD]+|[hH]+|[sS]+)|(?P<digit>[0#?.,])|(?P<percent>%)|(?P<at>@)|(?P<other>.)",
    re.DOTALL,
)
_CONDITION = re.compile(r"(<=|>=|<>|=|<|>)(-?[0-9.]+)")
_HOLDS = {"<=": float.__le__, ">=": float.__ge__, "<>": float.__ne__, "=": float.__eq__, "<": float.__lt__, ">": float.__gt__}


@lru_cache(maxsize=4096)
def sections(code: str) -> list[tuple[tuple[str, float] | None, list[tuple[str, str]], bool]]:
    """Of every section its condition, its tokens (kind, text), and whether it is a date."""
    out = []
    for part in re.findall(r'((?:"[^"]*"?|\\.|\[[^\]]*\]|[^;])*)(?:;|\Z)', code, re.DOTALL)[:4]:
        condition, tokens = None, []
        for m in _TOKEN.finditer(part):
            kind, text = m.lastgroup, m[m.lastgroup]
            if kind == "bracket":
                if found := _CONDITION.match(text):
                    condition = (found[1], float(found[2]))
                elif text.startswith("$"):
                    tokens.append(("literal", text[1:].rsplit("-", 1)[0]))
            elif kind in ("quoted", "escaped", "other"):
                tokens.append(("literal", text))
            elif kind == "space":
                tokens.append(("literal", " "))
            elif kind != "fill":
                tokens.append((kind, text.lower() if kind in ("date", "elapsed") else text))
        out.append((condition, tokens, any(k in ("date", "elapsed") for k, _ in tokens)))
    return out if len(out) == 1 or out[-1][1] or code.endswith(";") else out[:-1]


@lru_cache(maxsize=4096)
def fixed_point(code: str) -> tuple[Decimal, str] | None:
    """For the plainest codes, the unit to round to and how Python writes that."""
    found = re.fullmatch(r"(#,##)?0(?:\.(0+))?", code)
    return (Decimal(1).scaleb(-len(found[2] or "")), ",f" if found[1] else "f") if found else None


def is_date(code: str) -> bool:
    return sections(code)[0][2]


def general(v: float) -> str:
    """At most eleven characters: whole, rounded, or with an exponent."""
    size = abs(v)
    if v == 0:
        return "0"
    if 1e-4 <= size < 99999999999.5:
        text = f"{Decimal(repr(v)).quantize(Decimal(1).scaleb(-max(0, 10 - len(str(int(size))))), ROUND_HALF_UP):f}"
        return text.rstrip("0").rstrip(".") if "." in text else text
    mantissa, exponent = f"{v:.5E}".split("E")
    return f"{mantissa.rstrip('0').rstrip('.')}E{exponent}"


def moment(serial: float, since_1904: bool = False) -> datetime:
    """The time of a serial number; days before March 1900 count from the next one on, as 1900 has a 29 February there (day 60 is the 28th, too)."""
    if since_1904:
        return datetime(1904, 1, 1) + timedelta(days=serial)
    return datetime(1899, 12, 31 if serial < 60 else 30) + timedelta(days=serial)


def shown(v: float, code: str, since_1904: bool = False) -> str:
    """The text that a cell with this number and format shows."""
    if fixed := fixed_point(code):
        rounded = Decimal(repr(float(v))).quantize(fixed[0], ROUND_HALF_UP)
        return format(rounded if rounded else abs(rounded), fixed[1])
    parts = sections(code)
    if v == int(v) and abs(v) < 99999999999.5 and code == "General":
        return str(int(v))
    numeric = parts[:3]
    at, minus = 0, v < 0
    if any(c for c, _, _ in numeric):
        at = next((i for i, (c, _, _) in enumerate(numeric) if c is None or _HOLDS[c[0]](float(v), c[1])), len(numeric) - 1)
    elif v < 0 and len(numeric) > 1:
        at, minus = 1, False
    elif v == 0 and len(numeric) > 2:
        at = 2
    _, tokens, date = parts[at]
    if date:
        return _date(v, tokens, since_1904)
    if any(k == "general" for k, _ in tokens) or all(k == "at" for k, _ in tokens) and tokens:
        body = "".join(general(abs(v)) if k in ("general", "at") else t for k, t in tokens)
    else:
        body = _number(abs(v), tokens)
    return f"-{body}" if minus and re.search("[1-9]", body) else body


def _number(v: float, tokens: list[tuple[str, str]]) -> str:
    digits = [i for i, (k, _) in enumerate(tokens) if k == "digit"]
    if not digits:
        return "".join("" if k == "at" else t for k, t in tokens)
    value = Decimal(repr(float(v))) * 100 ** sum(k == "percent" for k, _ in tokens)
    places = [i for i in digits if tokens[i][1] in "0#?"]
    exponent = next((i for i, (k, _) in enumerate(tokens) if k == "exponent"), None)
    body = [i for i in digits if exponent is None or i < exponent]
    point = next((i for i in body if tokens[i][1] == "."), None)
    whole = [i for i in places if i in body and (point is None or i < point)]
    decimals = [i for i in places if i in body and point is not None and i > point]
    slash = next((i for i, t in enumerate(tokens) if t == ("literal", "/") and places and places[0] < i), None)
    if slash is not None and point is None:
        return _fraction(value, tokens, whole, slash)
    commas = [i for i in body if tokens[i][1] == ","]
    grouped = any(whole and whole[0] < i < whole[-1] for i in commas)
    value /= 1000 ** sum(bool(whole) and i > whole[-1] and (point is None or i < point) for i in commas)
    power = 0
    if exponent is not None and value:
        power = value.adjusted() - (value.adjusted() % len(whole) if len(whole) > 1 else 0)
        value = value.scaleb(-power)
        if value.quantize(Decimal(1).scaleb(-len(decimals)), ROUND_HALF_UP) >= 10 ** max(1, len(whole)):
            step = max(1, len(whole))
            value, power = value.scaleb(-step), power + step
    left, _, right = f"{value.quantize(Decimal(1).scaleb(-len(decimals)), ROUND_HALF_UP):f}".partition(".")
    left = left.lstrip("0")
    fill = _filled(tokens, whole, left, grouped)
    kept = len(right.rstrip("0"))
    for n, i in enumerate(decimals):
        fill[i] = right[n] if n < kept or tokens[i][1] == "0" else " " if tokens[i][1] == "?" else ""
    if exponent is not None:
        after = [i for i in places if i > exponent]
        fill |= _filled(tokens, after, str(abs(power)), False)
        fill[exponent] = "E" + ("-" if power < 0 else "+" if tokens[exponent][1][1] == "+" else "")
    if point is not None:
        fill[point] = "."
    return "".join(fill.get(i, "") if k in ("digit", "exponent") else "" if k == "at" else t for i, (k, t) in enumerate(tokens))


def _filled(tokens: list[tuple[str, str]], places: list[int], digits: str, grouped: bool) -> dict[int, str]:
    """Digits over places from the right; the first place takes all that is left, empty places show what their sign says."""
    out = {i: "" for i in places}
    count = 0
    for n, i in enumerate(reversed(places)):
        last = n == len(places) - 1
        while True:
            digit, digits = (digits[-1], digits[:-1]) if digits else ({"0": "0", "?": " "}.get(tokens[i][1], ""), "")
            if digit:
                out[i] = digit + ("," if grouped and count and count % 3 == 0 and digit != " " else "") + out[i]
                count += 1
            if not (last and digits):
                break
    return out


def _fraction(value: Decimal, tokens: list[tuple[str, str]], places: list[int], slash: int) -> str:
    below = "".join(t for _, t in tokens[slash + 1 :] if t in "0123456789?#")
    own = sum(1 for i in places if i < slash)
    mixed = own > 1 and any(t == ("literal", " ") for t in tokens[:slash])
    whole = int(value) if mixed else 0
    rest = Fraction(value) - whole
    part = Fraction(round(rest * int(below)), int(below)) if below.isdigit() and int(below) else rest.limit_denominator(10 ** max(1, len(below)) - 1)
    if part == 1 and mixed:
        whole, part = whole + 1, Fraction(0)
    if not part:
        return str(whole)
    lower = int(below) if below.isdigit() and int(below) else part.denominator
    return (f"{whole} " if whole else "") + f"{part.numerator * lower // part.denominator}/{lower}"


def _date(serial: float, tokens: list[tuple[str, str]], since_1904: bool) -> str:
    if not 0 <= serial < LAST_DAY + 1:
        return ""
    units = [(i, t[0]) for i, (k, t) in enumerate(tokens) if k in ("date", "elapsed")]
    minutes = {i for n, (i, u) in enumerate(units) if u == "m" and ((n and units[n - 1][1] == "h") or (n + 1 < len(units) and units[n + 1][1] == "s"))}
    finest = 0  # decimals of seconds: placeholders behind the seconds' point
    for i, (k, t) in enumerate(tokens[:-1]):
        if k in ("date", "elapsed") and t[0] == "s" and tokens[i + 1] == ("digit", "."):
            finest = sum(1 for _ in _zeros(tokens, i + 2))
    seconds = round(serial * 86400 * 10**finest) / 10**finest
    at = moment(seconds // 86400, since_1904) + timedelta(seconds=seconds % 86400)
    half = any(k == "half" for k, _ in tokens)
    out, skip = [], 0
    for i, (k, t) in enumerate(tokens):
        if skip:
            skip -= 1
        elif k == "elapsed":
            out.append(str(int(seconds // {"h": 3600, "m": 60, "s": 1}[t[0]])).zfill(len(t)))
        elif k == "half":
            name = "PM" if at.hour >= 12 else "AM"
            out.append(name if "/" in t and len(t) > 3 else name[0])
        elif k == "date":
            out.append(_unit(at, t, i in minutes, half))
        elif k == "digit" and t == "." and i and tokens[i - 1][1][:1] == "s":
            skip = sum(1 for _ in _zeros(tokens, i + 1))
            out.append(f"{seconds % 1:.{skip}f}"[1:] if skip else ".")
        else:
            out.append(t)
    return "".join(out)


def _zeros(tokens: list[tuple[str, str]], start: int):  # noqa: ANN202
    for token in tokens[start:]:
        if token != ("digit", "0"):
            return
        yield token


def _unit(at: datetime, token: str, minute: bool, half: bool) -> str:
    kind, n = token[0], len(token)
    if kind == "y":
        return f"{at.year % 100:02}" if n < 3 else f"{at.year:04}"
    if kind == "m" and not minute and n > 2:
        return MONTHS[at.month - 1] if n == 4 else MONTHS[at.month - 1][: 1 if n > 4 else 3]
    if kind == "d" and n > 2:
        return DAYS[at.weekday()] if n > 3 else DAYS[at.weekday()][:3]
    hour = (at.hour + 11) % 12 + 1 if half else at.hour
    value = {"m": at.minute if minute else at.month, "d": at.day, "h": hour, "s": at.second}[kind]
    return str(value).zfill(min(n, 2))


def plain(v: float, code: str, since_1904: bool = False) -> str:
    """The value itself: whole numbers without a point, dates as ISO texts, spans of hours as hours, minutes and seconds."""
    if not is_date(code) or not 0 <= v < LAST_DAY + 1:
        return str(int(v)) if v == int(v) else repr(v)
    if any(k == "elapsed" for k, _ in sections(code)[0][1]):
        return str(timedelta(seconds=round(v * 86400, 6)))
    at = moment(v, since_1904) + timedelta(microseconds=500)
    at = at.replace(microsecond=at.microsecond // 1000 * 1000)
    return str(at.time()) if v < 1 and not since_1904 else str(at)
