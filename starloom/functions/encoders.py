"""Encoders of business attributes, opening hours, categories and check-in maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.parsing import int_text, strip
from starloom.schema import TOP_CATEGORIES

# Ordinal codes of two attributes, and the words that mean "none".
NOISE_CODES = {"quiet": 0, "average": 1, "loud": 2, "very_loud": 3}
ATTIRE_CODES = {"casual": 0, "dressy": 1, "formal": 2}
NO_ALCOHOL = ["", "none", "False", "None"]
NO_WIFI = ["", "no", "False", "None"]
WEEKEND_DAYS = ["Saturday", "Sunday"]
WEEKEND_DAYS_SHORT = ["Sat", "Sun"]
EVENING_FROM_HOUR = 17

_HOURS_TEXT = r"^\s*\+?[0-9]+\s*:\s*\+?[0-9]+\s*-\s*\+?[0-9]+\s*:\s*\+?[0-9]+\s*$"
_DAY_HOUR = r"^[^-]*-\s*\+?[0-9]+(_[0-9]+)*\s*$"


def code(x: Column, codes: dict[str, int], default: int) -> Column:
    """Ordinal code of a word, ``default`` for NULL and unknown words."""
    encoded = F.lit(default)
    for word, value in codes.items():
        encoded = F.when(x == word, F.lit(value)).otherwise(encoded)
    return encoded.cast("int")


def true_flag(x: Column, default: int = 0) -> Column:
    """1 / 0 for the texts 'True' / 'False', else ``default``."""
    return code(x, {"True": 1, "False": 0}, default)


def noise_code(x: Column) -> Column:
    return code(x, NOISE_CODES, -1)


def attire_code(x: Column) -> Column:
    return code(x, ATTIRE_CODES, 0)


def present_flag(x: Column, none_words: list[str]) -> Column:
    """0 when missing or one of ``none_words``, else 1."""
    return F.when(x.isNull() | x.isin(none_words), F.lit(0)).otherwise(F.lit(1)).cast("int")


def alcohol_flag(x: Column) -> Column:
    return present_flag(x, NO_ALCOHOL)


def wifi_flag(x: Column) -> Column:
    return present_flag(x, NO_WIFI)


def category_count(categories: Column) -> Column:
    """Comma-separated pieces, empty ones included; 0 for NULL and ''."""
    missing = categories.isNull() | (categories == "")
    return F.when(missing, F.lit(0)).otherwise(F.size(F.split(categories, ","))).cast("bigint")


def category_flags(categories: Column, names: list[str] | None = None) -> list[Column]:
    """One 0/1 column per name (``cat_01`` ...), by trimmed lower-case membership."""
    pieces = F.transform(F.split(F.coalesce(categories, F.lit("")), ","), lambda c: F.lower(strip(c)))
    return [
        F.array_contains(pieces, name).cast("int").alias(f"cat_{i:02d}")
        for i, name in enumerate(names or TOP_CATEGORIES, start=1)
    ]


def opening_span(text: Column) -> Column:
    """Hours between 'H:M' and 'H:M'; a negative span runs overnight; 0.0 for malformed text."""
    numbers = F.transform(F.split(text, "[:-]"), lambda x: int_text(x, None).cast("double"))
    opens = F.element_at(numbers, 1) + F.element_at(numbers, 2) / 60.0
    closes = F.element_at(numbers, 3) + F.element_at(numbers, 4) / 60.0
    span = closes - opens
    return F.when(
        F.coalesce(text.rlike(_HOURS_TEXT), F.lit(False)),
        F.when(span < 0, span + 24.0).otherwise(span),
    ).otherwise(F.lit(0.0))


def weekly_hours(hours: Column) -> Column:
    """Sum of the daily spans of a ``MAP<day, 'H:M-H:M'>``; 0.0 for a missing map."""
    spans = F.transform(F.map_values(hours), opening_span)
    return F.coalesce(F.aggregate(spans, F.lit(0.0), lambda total, x: total + x), F.lit(0.0))


def weekend_flag(hours: Column) -> Column:
    """1 when the map has a Saturday or Sunday, whatever its text."""
    named = F.exists(F.map_keys(hours), lambda day: day.isin(WEEKEND_DAYS))
    return F.coalesce(named, F.lit(False)).cast("int")


def map_total(counts: Column) -> Column:
    """Sum of all values of a ``MAP<STRING, DOUBLE>``; 0.0 for a missing map."""
    total = F.aggregate(F.map_values(counts), F.lit(0.0), lambda acc, x: acc + x)
    return F.coalesce(total, F.lit(0.0))


def valid_day_hours(counts: Column) -> Column:
    """Entries whose key is exactly 'Day-hour' with an integer hour."""
    return F.map_filter(counts, lambda key, _: key.rlike(_DAY_HOUR))


def checkin_ratios(counts: Column) -> tuple[Column, Column, Column]:
    """(evening ratio, weekend ratio, total) of a ``MAP<'Day-hour', DOUBLE>``."""
    valid = valid_day_hours(counts)
    hour_of = lambda key: int_text(F.element_at(F.split(key, "-"), 2), None)
    day_of = lambda key: F.element_at(F.split(key, "-"), 1)
    total = map_total(valid)
    evening = map_total(F.map_filter(valid, lambda key, _: hour_of(key) >= EVENING_FROM_HOUR))
    weekend = map_total(F.map_filter(valid, lambda key, _: day_of(key).isin(WEEKEND_DAYS_SHORT)))
    nonzero = total != 0
    safe = lambda part: F.when(nonzero, part / total).otherwise(F.lit(0.0))
    return safe(evening), safe(weekend), total


