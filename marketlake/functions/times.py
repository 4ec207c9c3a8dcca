"""Parsing and formatting of times. All results are TIMESTAMP under a UTC session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# ISO forms, from a year alone to a full date-time. A bare clock time ("12:30") would parse as today, and six digits as a year.
_ISO = r"^\d{4}(-\d{1,2}(-\d{1,2}([T ].*)?)?)?$"
# Other forms that feeds use, with the pattern that reads each.
_OTHER_FORMS = {
    r"^\d{8}$": "yyyyMMdd",
    r"^\d{8}T\d{6}$": "yyyyMMdd'T'HHmmss",
    r"^\d{8}T\d{6}(Z|[+-]\d{4})$": "yyyyMMdd'T'HHmmssXX",
    r"^\d{1,2}/\d{1,2}/\d{4}$": "M/d/yyyy",
    r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$": "M/d/yyyy H:mm",
    r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$": "M/d/yyyy H:mm:ss",
}
# A zone at the end of an ISO date-time: Z, +05, +0530, +05:30, +05:30:15.
_TRAILING_ZONE = r"(?<=\d{2})(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)$"


def utc_timestamp(c: Column) -> Column:
    """String time to UTC: a naive time is UTC, an offset is converted, a bad one is null.

    ISO forms, compact ones (``20240102``, ``20240102T103000``) and month/day/year.
    """
    bare = F.trim(c)
    read = F.when(bare.rlike(_ISO), F.try_to_timestamp(bare))
    for form, pattern in _OTHER_FORMS.items():
        read = read.when(bare.rlike(form), F.try_to_timestamp(bare, F.lit(pattern)))
    return read


def to_utc(df: DataFrame, name: str) -> Column:
    """The time column ``name`` of ``df`` as TIMESTAMP, whatever its stored type is."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return utc_timestamp(F.col(name))
    return F.col(name).cast("timestamp")


def iso_z_timestamp(c: Column) -> Column:
    """ISO time with any trailing ``Z`` removed first; naive is UTC, an offset is converted."""
    return utc_timestamp(F.regexp_replace(c, r"Z+$", ""))


def rfc2822_timestamp(c: Column) -> Column:
    """``Tue, 02 Jan 2024 14:30:00 +0000`` (weekday optional, named or numeric zone) to UTC."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9}\s*,\s*", "")
    return F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")),
    )


def as_of_timestamp(c: Column, now: Column) -> Column:
    """Snapshot time: the wall clock is taken as UTC (an offset is dropped, not applied); else ``now``."""
    wall = F.regexp_replace(F.trim(c), r"^(\d{4}-\d{2}-\d{2}[T ].*?)" + _TRAILING_ZONE, "$1")
    return F.coalesce(utc_timestamp(wall), now.cast("timestamp"))


def iso_seconds(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def iso_seconds_z(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def iso_created_at(c: Column) -> Column:
    """ISO form with the UTC offset; microseconds appear only when they are not zero."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, ".SSSSSS")
    return F.concat(whole, F.when(micros == ".000000", "").otherwise(micros), F.lit("+00:00"))
