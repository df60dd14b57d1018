"""Numbers, units and parameters read out of Polish text, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions import once


def parse_number(text: Column, to_line_end: bool = True) -> Column:
    """The first number of a text as a double; spaces part thousands, a comma the decimals. A line break behind the number is passed
    over; without ``to_line_end`` it makes the number none, as in the SQL twin."""
    space, end = (r"\s", "$") if to_line_end else (r"\t\n\f\r", r"\z")  # Java's $ also fits before a last line break, and its \s is wider than DuckDB's

    def read(raw: Column) -> Column:
        commas, dots = F.length(raw) - F.length(F.replace(raw, F.lit(","), F.lit(""))), F.length(raw) - F.length(F.replace(raw, F.lit("."), F.lit("")))
        no_dots, no_commas = F.replace(raw, F.lit("."), F.lit("")), F.replace(raw, F.lit(","), F.lit(""))
        return (
            F.when((commas > 0) & (dots > 0), F.replace(no_dots, F.lit(","), F.lit(".")))
            .when(commas > 1, no_commas)
            .when(commas == 1, F.replace(raw, F.lit(","), F.lit(".")))
            .when((dots == 1) & raw.rlike(rf"^\d{{0,3}}\.\d{{3}}{end}"), no_dots)
            .when(dots > 1, no_dots)
            .otherwise(raw)
        )

    raw = F.trim(F.regexp_replace(F.regexp_extract(F.translate(text, "\u00a0", " "), rf"(\d[\d{space} .,]*)", 1), " ", ""))
    return once(once(raw, read), lambda x: F.when(x.rlike(rf"^\d+\.?\d*{end}"), x.cast("double")))


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return once(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), lambda x: F.nullif(x, F.lit("")))


def area(text: Column) -> Column:
    return parse_number(_group(text, C.AREA))


def square_metres(value: Column, unit: Column) -> Column:
    """Ares and hectares in square metres; other units as they are."""
    key = F.lower(F.coalesce(unit, F.lit("m2")))
    factor = F.when(key.rlike("^(ha|hektar)"), 10000.0).when(key.rlike("^a"), 100.0).otherwise(1.0)
    return F.round(value * factor, 2)


def plot_area(text: Column) -> Column:
    return square_metres(parse_number(_group(text, C.PLOT, 1)), _group(text, C.PLOT, 2))


def rooms(text: Column) -> Column:
    return _group(text, C.ROOMS).cast("int")


def _level(word: Column) -> Column:
    return F.when(F.lower(word).startswith("parter"), F.lit(0)).when(word.rlike(r"^\d{1,9}$"), word.cast("int"))


def floor(text: Column) -> tuple[Column, Column]:
    """Floor and number of floors; the ground floor is 0."""
    of, single = _group(text, C.FLOOR_OF, 1), _group(text, C.FLOOR, 1)
    ground = F.coalesce(text, F.lit("")).rlike(C.GROUND_FLOOR)
    level = F.when(of.isNotNull(), _level(of)).when(single.isNotNull(), _level(single)).when(ground, F.lit(0))
    return level, F.when(of.isNotNull(), _group(text, C.FLOOR_OF, 2).cast("int"))


def year(text: Column) -> Column:
    return _group(text, C.YEAR).cast("int")


def case_number(text: Column) -> Column:
    return F.coalesce(_group(text, C.CASE_NUMBER), _group(text, C.COURT_SIGN))


def plausible_price(price: Column) -> Column:
    """True for a null price; false for what nobody asks: nothing, too much, or a placeholder."""
    whole = price == F.floor(price)
    placeholder = whole & price.cast("decimal(20,0)").cast("string").rlike(C.PLACEHOLDER_PRICE)
    return F.coalesce((price > 0) & (price <= C.MAX_PRICE) & ~placeholder, F.lit(True))


def plausible_area(size: Column, kind: Column) -> Column:
    low, high = (F.lit(v) for v in map(float, C.OTHER_AREA_LIMITS))
    for name, (a, b) in C.AREA_LIMITS.items():
        low, high = F.when(kind == name, float(a)).otherwise(low), F.when(kind == name, float(b)).otherwise(high)
    return F.coalesce(size.between(low, high), F.lit(True))


def half_up(value: Column, places: int) -> Column:
    """Rounding by plain arithmetic, which every engine does alike."""
    scale = 10.0**places
    return F.floor(value * scale + 0.5) / scale


def price_per_m2(price: Column, size: Column) -> Column:
    """Two decimals, four below 1; null where there is nothing to divide or the result is nothing."""
    rate = price / F.nullif(size, F.lit(0.0))
    return F.nullif(F.when(rate >= 1, half_up(rate, 2)).otherwise(half_up(rate, 4)), F.lit(0.0))


def price_from_text(text: Column) -> Column:
    """The first amount in złoty between 1,000 and 50 million."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?iu)(\d{1,3}(?:[ \u00a0.]\d{3})+|\d{4,9})(?:,\d{2})?\s*(?:zł|pln)"), 1)
    amounts = F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"[^\d]", "").cast("double")), lambda x: x.between(1000, 50_000_000))
    return F.get(amounts, 0)


def parcel_numbers(text: Column) -> Column:
    found = _group(text, r"(?iU)(?:dzia[łl]k\w*|dz\.?\s*(?:ew\.?|ewid\w*)?)\s*(?:nr|numer|o\s+numerze)?\s*(\d{1,5}(?:/\d{1,5})?(?:\s*,\s*\d{1,5}(?:/\d{1,5})?){0,4})")
    return F.slice(F.split(F.regexp_replace(found, r"\s", ""), ","), 1, 5)
