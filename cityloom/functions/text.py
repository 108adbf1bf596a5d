"""Names, identifiers, numbers and durations written as text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename every column to snake_case."""
    return df.toDF(*[snake(c) for c in df.columns])


def clean_id(col: Column) -> Column:
    """Identifier as digits only: trimmed, a trailing ``.0`` dropped, anything else NULL."""
    text = F.regexp_replace(F.trim(col.cast("string")), r"\.0$", "")
    return F.when(text.rlike(r"^[0-9]+$"), text)


def bin_key(col: Column) -> Column:
    """Building number; the per-borough placeholder (a multiple of one million) identifies nothing."""
    key = clean_id(col)
    return F.when(key.try_cast("decimal(38,0)") % 1000000 != 0, key)


def footprint_key(col: Column) -> Column:
    """Footprint number; ``0`` identifies nothing."""
    key = clean_id(col)
    return F.when(key != "0", key)


def identity_keys(df: DataFrame, bin_col: str = "bin", id_col: str = "doitt_id") -> DataFrame:
    return df.withColumn("bin_key", bin_key(F.col(bin_col))).withColumn("id_key", footprint_key(F.col(id_col)))


def to_number(col: Column) -> Column:
    """Number or NULL."""
    return col.try_cast("double")


def display_name(col: Column, fallback: str) -> Column:
    """Published name, or the fallback where it is missing, blank or ``unset``."""
    return F.when((F.trim(col) != "") & (col != "unset"), col).otherwise(F.lit(fallback))


# Seconds per duration unit.
DURATION_SECONDS = {"d": 86400, "h": 3600, "m": 60, "s": 1}


def parse_duration(col: Column) -> Column:
    """Seconds in a text such as ``1d 2h 3m 4.5s``; NULL when nothing in it reads as a duration."""
    pattern = F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*([dhms])")
    numbers = F.regexp_extract_all(col, pattern, F.lit(1))
    units = F.regexp_extract_all(col, pattern, F.lit(2))

    def seconds(number: Column, unit: Column) -> Column:
        scale = F.lit(0)
        for name, value in DURATION_SECONDS.items():
            scale = F.when(unit == name, F.lit(value)).otherwise(scale)
        return number.cast("double") * scale

    parts = F.zip_with(numbers, units, seconds)
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))


def require_duration(col: Column) -> Column:
    """As ``parse_duration`` but a text without a duration stops the job."""
    value = parse_duration(col)
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit("unreadable duration: "), col))).otherwise(value)


def _two(col: Column) -> Column:
    return F.lpad(col.cast("string"), 2, "0")


def format_duration(seconds: Column) -> Column:
    """``2d 03h 04m``, ``3h 04m`` or ``4m 05s``, whichever is the largest unit present."""
    total = F.rint(seconds).cast("bigint")
    days, hours = F.floor(total / 86400), F.floor(total / 3600)
    minutes = F.floor(total % 3600 / 60)
    return (
        F.when(days > 0, F.concat(days.cast("string"), F.lit("d "), _two(hours % 24), F.lit("h "), _two(minutes), F.lit("m")))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), _two(minutes), F.lit("m")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m "), _two(total % 60), F.lit("s")))
    )


def format_clock(seconds: Column) -> Column:
    """``h:mm:ss``, or ``m:ss`` below one hour; a fraction of a second is dropped."""
    total = F.when(seconds > 0, seconds.cast("bigint")).when(seconds.isNotNull(), F.lit(0))
    hours, minutes = F.floor(total / 3600), F.floor(total % 3600 / 60)
    return F.when(
        hours > 0, F.concat(hours.cast("string"), F.lit(":"), _two(minutes), F.lit(":"), _two(total % 60))
    ).otherwise(F.concat(minutes.cast("string"), F.lit(":"), _two(total % 60)))


# Letters-only aliases of each borough; the first borough with an alias in the name wins.
BOROUGH_ALIASES = {
    "Bronx": ["bronx"],
    "Brooklyn": ["brooklyn", "kings"],
    "Manhattan": ["manhattan", "newyork"],
    "Queens": ["queens", "qn"],
    "Staten Island": ["staten", "richmond"],
}


def borough_for(name: Column) -> Column:
    """Borough a file or layer name belongs to: the first alias its letters contain."""
    letters = F.regexp_replace(F.lower(name), r"[^a-z]", "")
    out = F.lit(None).cast("string")
    for borough, aliases in reversed(BOROUGH_ALIASES.items()):
        out = F.when(letters.rlike("|".join(aliases)), F.lit(borough)).otherwise(out)
    return out


def config_key(*cols: Column) -> Column:
    """First 24 hex digits of the SHA-256 of the given named columns as sorted-key JSON.

    Callers pass the columns already aliased; the JSON keeps the order they are given in, so pass them sorted.
    """
    return F.substring(F.sha2(F.to_json(F.struct(*cols)), 256), 1, 24)


def slug_digest(name: Column) -> Column:
    """File stem plus eight hex digits of the SHA-1 of the whole name, so equal stems stay apart."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(.)\.[^.]*$", "$1")
    return F.concat(F.replace(stem, F.lit(" "), F.lit("_")), F.lit("-"), F.substring(F.sha1(name), 1, 8))
