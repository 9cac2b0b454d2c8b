"""Rendering to text, parsing from text, and the few text rules of the registry."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import (
    BooleanType, DataType, DoubleType, FloatType, NumericType, StringType, TimestampNTZType,
    TimestampType,
)

# Identifier shapes and names that collide with files of an export bundle.
TABLE_NAME_PATTERN = "^[a-z][a-z0-9_]{0,31}$"
FIELD_NAME_PATTERN = "^[a-z][a-z0-9_]{0,39}$"
RESERVED_TABLE_NAMES = ["manifest", "schema"]

# Characters that render as nothing and do not count in a name.
INVISIBLE_RANGES = [
    (0x00AD, 0x00AD),  # soft hyphen
    (0x180E, 0x180E),  # Mongolian vowel separator
    (0x200B, 0x200F),  # zero-width space and joiners, direction marks
    (0x202A, 0x202E),  # bidi embedding and override
    (0x2060, 0x2064),  # word joiner, invisible operators
    (0x2066, 0x2069),  # bidi isolates
    (0xFEFF, 0xFEFF),  # byte-order mark
]


# ------------------------------------------------------------------ timestamps
def epoch() -> Column:
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))


def micros_of(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", epoch(), ts)


def wall_time(micros: Column) -> Column:
    """The zone-less timestamp of a microsecond count."""
    return F.timestamp_add("MICROSECOND", micros, epoch())


def iso_text(ts: Column, sep: str = "T") -> Column:
    """ISO-8601 with microseconds only when there are any."""
    shown = ts.cast("timestamp_ntz").cast("string")
    whole = F.concat(F.substring(shown, 1, 10), F.lit(sep), F.substring(shown, 12, 8))
    fraction = F.substring(shown, 21, 6)
    return F.when(fraction == "", whole).otherwise(
        F.concat(whole, F.lit("."), F.rpad(fraction, 6, "0")))


# ISO 8601: calendar or week date, then maybe a clock reading and an offset, each in the extended form
# (with dashes or colons) or the basic one
_DAY = r"^(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2})|-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)"
_CLOCK = r"(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?|(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?"
_OFFSET = r"(?:Z|([+-])(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?)?)?)?$"
_ISO = _DAY + _CLOCK + _OFFSET


def _iso_part(text: Column, *groups: int, missing: str = "00") -> Column:
    """The first of the groups that is there."""
    found = [F.nullif(F.regexp_extract(text, _ISO, g), F.lit("")) for g in groups]
    return F.coalesce(*found, F.lit(missing))


def _wall(text: Column) -> Column:
    """The clock reading of ISO text, its offset set aside; NULL for impossible dates. Fractions are cut
    to microseconds."""
    year, week = _iso_part(text, 1), F.regexp_extract(text, _ISO, 6)
    week = F.when(week != "", week).otherwise(F.regexp_extract(text, _ISO, 8))
    first = F.date_trunc("week", F.to_timestamp_ntz(F.concat(year, F.lit("-01-04")))).try_cast("date")
    monday = F.date_add(first, (week.try_cast("int") - 1) * 7)
    weekday = _iso_part(text, 7, 9, missing="1")
    in_year = (F.weekofyear(monday) == week.try_cast("int")) & weekday.between("1", "7")
    week_day = F.when(in_year, F.date_add(monday, weekday.cast("int") - 1)).cast("string")
    day = F.concat_ws("-", year, _iso_part(text, 2, 4), _iso_part(text, 3, 5))
    clock = F.concat(_iso_part(text, 10), F.lit(":"), _iso_part(text, 11, 14), F.lit(":"), _iso_part(text, 12, 15), F.lit("."),
                     F.substring(_iso_part(text, 13, 16, missing="0"), 1, 6))
    return F.concat(F.when(week != "", week_day).otherwise(day), F.lit(" "), clock).try_cast("timestamp_ntz")


def _offset_seconds(text: Column) -> Column:
    part = [_iso_part(text, g).cast("int") for g in (18, 19, 20)]
    size = part[0] * 3600 + part[1] * 60 + part[2]
    return F.when(F.regexp_extract(text, _ISO, 17) == "-", -size).otherwise(size)


def is_iso(text: Column) -> Column:
    return parse_iso(text).isNotNull()


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a zone-less UTC timestamp; NULL when it is not one.

    Independent of the session time zone: an offset (of less than a day) is subtracted, ``Z`` is zero, and
    text without an offset is taken as it stands.
    """
    seconds = _offset_seconds(text)
    sound = text.rlike(_ISO) & (F.abs(seconds) < 86_400) & (_iso_part(text, 19) < "60") & (_iso_part(text, 20) < "60")
    return F.when(sound, F.timestamp_add("SECOND", -seconds, _wall(text)))


# ------------------------------------------------------------------- rendering
def number_text(value: Column, kind: DataType) -> Column:
    """The shortest exact digits; doubles without E-notation from 1e-4 up to 1e16."""
    ordinary = value.cast("string")
    if not isinstance(kind, (DoubleType, FloatType)):
        return ordinary
    size = F.abs(value)
    large = F.rtrim(value.cast("decimal(38,10)").cast("string"), F.lit("0"))
    small = F.rtrim(value.cast("decimal(38,22)").cast("string"), F.lit("0"))
    return (
        F.when((size >= 1e7) & (size < 1e16),
               F.when(large.endswith("."), F.concat(large, F.lit("0"))).otherwise(large))
        .when((size >= 1e-4) & (size < 1e-3), small)
        .otherwise(ordinary))


def csv_cell(value: Column, kind: DataType) -> Column:
    """The text of one CSV cell before quoting: NULL is empty, booleans lower-case, times ISO."""
    if isinstance(kind, BooleanType):
        shown = F.when(value, "true").otherwise("false")
    elif isinstance(kind, (TimestampNTZType, TimestampType)):
        shown = iso_text(value)
    elif isinstance(kind, NumericType):
        shown = number_text(value, kind)
    else:
        shown = value.cast("string")
    return F.when(value.isNull(), "").otherwise(shown)


def csv_quoted(cell: Column) -> Column:
    """Minimal quoting: only cells holding a comma, a quote or a line break, quotes doubled."""
    doubled = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(cell.rlike('[,"\r\n]'), doubled).otherwise(cell)


def sql_literal(value: Column, kind: DataType, dialect: str = "sqlite") -> Column:
    """A SQL literal. Booleans are TRUE/FALSE in postgresql and 1/0 in sqlite."""
    if isinstance(kind, BooleanType):
        yes, no = ("TRUE", "FALSE") if dialect == "postgresql" else ("1", "0")
        shown = F.when(value, yes).otherwise(no)
    elif isinstance(kind, (DoubleType, FloatType)):
        finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
        shown = F.when(finite, number_text(value, kind)).otherwise("NULL")
    elif isinstance(kind, NumericType):
        shown = value.cast("string")
    else:
        if isinstance(kind, (TimestampNTZType, TimestampType)):
            text = iso_text(value, " ")
        else:
            text = F.replace(value.cast("string"), F.lit("'"), F.lit("''"))
        shown = F.concat(F.lit("'"), text, F.lit("'"))
    return F.when(value.isNull(), "NULL").otherwise(shown)


# ------------------------------------------------------------------ text rules
def key_hash(secret: Column) -> Column:
    return F.sha2(secret, 256)


_INVISIBLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE_RANGES) + "]")


@F.pandas_udf(StringType())
def _folded(names: pd.Series) -> pd.Series:
    def fold(name):
        shown = _INVISIBLE.sub("", unicodedata.normalize("NFKC", name))
        return " ".join(shown.split()).casefold()

    return names.map(fold, na_action="ignore")


def name_key(name: Column) -> Column:
    """The key under which two names count as the same one.

    Plain ASCII names are folded by built-ins; Python sees a value only for the others
    (Spark has no NFKC built-in), so the Arrow batches are mostly NULL.
    """
    ascii_only = name.rlike(r"^[\x00-\x7F]*$")
    spaced = F.regexp_replace(name, r"[\s\x1c-\x1f]+", " ")
    return F.when(ascii_only, F.lower(F.trim(spaced))).otherwise(
        _folded(F.when(~ascii_only, name)))


def ascii_name_key(name: Column) -> Column:
    """``name_key`` for columns known to be ASCII: no Python at all."""
    return F.lower(F.trim(F.regexp_replace(name, r"[\s\x1c-\x1f]+", " ")))


def is_table_name(name: Column) -> Column:
    return name.rlike(TABLE_NAME_PATTERN) & ~name.isin(RESERVED_TABLE_NAMES)


def is_field_name(name: Column) -> Column:
    return name.rlike(FIELD_NAME_PATTERN)


def relabel(text: Column, labels: dict[str, str]) -> Column:
    """Replace every internal name by its label, longest name first."""
    for internal in sorted(labels, key=lambda n: (-len(n), n)):
        text = F.replace(text, F.lit(internal), F.lit(labels[internal]))
    return text
