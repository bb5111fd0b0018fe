"""Scalar value functions: tokens, numbers, blanks, durations, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no value".
BLANKS = ("", "-", "nan", "NaN", "None", "none", "null", "NULL")
ZERO_BLANKS = ("", "-", "nan", "NaN", "None", "null")
NUMBER_BLANKS = ("", "nan", "none", "null", "-")
#: Decimal grammar that is accepted as a number.
NUMBER_PATTERN = r"^[+-]?([0-9]+(_[0-9]+)*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MAX_NUMBER = 1_000_000_000_000
#: Timestamp formats, tried in this order.
TIME_FORMATS = (
    "d-MMM-yy HH:mm:ss",
    "d-MMM-yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "d/M/yyyy HH:mm:ss",
    "M/d/yyyy HH:mm:ss",
    "yy-MM-dd'T'HH:mm:ss'Z'",
    "yy-MM-dd'T'HH:mm:ssXX",
    "yy-MM-dd HH:mm:ss",
)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_token(text: Column) -> Column:
    """Lower case with every run of other characters as one underscore; none at the ends. Null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_token_40(text: Column) -> Column:
    """The first 40 characters of the token; ``unknown`` if there are none."""
    short = F.left(normalize_token(text), F.lit(40))
    return F.when(short == "", F.lit("unknown")).otherwise(short)


def coerce_number(text: Column) -> Column:
    """Number of a text by the accepted grammar; null for blanks, other texts and magnitudes over 10**12."""
    trimmed = strip(text)
    known = F.when(F.lower(trimmed).isin(*NUMBER_BLANKS), None).when(trimmed.rlike(NUMBER_PATTERN), F.replace(trimmed, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.abs(known) <= MAX_NUMBER, known)


def normalize_int(text: Column) -> Column:
    """Whole number of a text with thousands commas; a fraction of zeros is allowed, exponents are not."""
    cleaned = F.replace(strip(text), F.lit(","), F.lit(""))
    whole = F.regexp_replace(cleaned, r"\.0+$", "")
    return F.when(~is_blank(text) & cleaned.rlike(r"^[-+]?[0-9]+(\.0+)?$"), whole.try_cast("bigint"))


def normalize_float(text: Column) -> Column:
    """Decimal number of a text with thousands commas; exponents are not allowed."""
    cleaned = F.replace(strip(text), F.lit(","), F.lit(""))
    return F.when(~is_blank(text) & cleaned.rlike(r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), cleaned.try_cast("double"))


def is_blank(text: Column) -> Column:
    return text.isNull() | strip(text).isin(*BLANKS)


def is_empty_or_zero(text: Column) -> Column:
    """Blank, or a number that is zero."""
    trimmed = strip(text)
    zero = F.when(trimmed.rlike(NUMBER_PATTERN), F.replace(trimmed, F.lit("_"), F.lit("")).try_cast("double") == 0.0)
    return text.isNull() | trimmed.isin(*ZERO_BLANKS) | F.coalesce(zero, F.lit(False))


def compact_category(text: Column) -> Column:
    """Short token of a category value; null for blanks, long texts and texts with an address."""
    trimmed = F.lower(strip(F.coalesce(text, F.lit(""))))
    unfit = trimmed.isin(*NUMBER_BLANKS) | (F.length(trimmed) > 80) | trimmed.rlike(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
    return F.when(~unfit, normalize_token_40(trimmed))


def value_preview(text: Column, width: int = 80) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("..."))).otherwise(text)


def duration_seconds(text: Column) -> Column:
    """Seconds of texts such as ``1h2m3.5s`` or ``250ms``; null if nothing fits."""
    total = F.lit(0.0)
    for unit, factor in (("ms", 0.001), ("s", 1.0), ("m", 60.0), ("h", 3600.0)):
        pattern = rf"([0-9]+(?:\.[0-9]+)?){unit}(?![a-z])"
        total = total + F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("double") * factor, F.lit(0.0))
    return F.when(text.rlike(r"^([0-9]+(\.[0-9]+)?(ms|s|m|h)(?![a-z]))+$"), total).otherwise(text.try_cast("double"))


def parse_timestamp(text: Column) -> Column:
    """Timestamp of a text: epoch seconds over 10**9, ISO, the listed formats, or a year with a time."""
    cleaned = F.regexp_replace(strip(text), r"\s+", " ")
    numeric = F.when(cleaned.rlike(NUMBER_PATTERN), cleaned.try_cast("double"))
    tries = [F.when(numeric > 1_000_000_000, F.timestamp_seconds(numeric))]
    tries.append(F.when(cleaned.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"), cleaned.try_cast("timestamp")))
    tries += [F.try_to_timestamp(cleaned, F.lit(fmt)) for fmt in TIME_FORMATS]
    year_time = F.regexp_replace(cleaned, r"^([0-9]{4})[\s-]+([0-9]{1,2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?)[0-9]*$", "$1-01-01 $2")
    tries.append(F.when(cleaned.rlike(r"^[0-9]{4}[\s-]+[0-9]{1,2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?$"), year_time.try_cast("timestamp")))
    return F.when(~is_blank(text), F.coalesce(*tries))


def ordered_distinct(values: Column) -> Column:
    """A list without repeats, each value at its first place."""
    return F.array_distinct(values)


def pick(row: Column, *names: str) -> Column:
    """The first value of a map that isn't blank under one of some names, whatever their case; null if there is none."""
    lowered = F.transform(F.map_entries(row), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    under = lambda name: F.try_element_at(F.filter(lowered, lambda e: (e["key"] == name) & ~is_blank(e["value"])), F.lit(1))["value"]
    return F.coalesce(*(under(n.lower()) for n in names))
