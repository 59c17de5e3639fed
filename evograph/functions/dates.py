"""The four date readers, kept apart on purpose: each accepts its own formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats in the order in which they are tried.
FORMATS = ["yyyy-M-d", "yyyyMMdd", "yyyy/M/d", "MMMM d, yyyy", "MMM d, yyyy", "yyyy-M-d'T'HH:mm", "yyyyMMddHHmm"]
SESSION_FORMATS = ["yyyy/M/d HH:mm", "yyyy/M/d", "yyyy-M-d HH:mm", "yyyy-M-d"]
EARLIEST = "0001-01-01 00:00:00"


def _first(text: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def try_parse_date(text: Column) -> Column:
    """The first format that fits, null if none does."""
    return _first(F.trim(text), FORMATS)


def day_prefix(text: Column) -> Column:
    """The date that a text starts with (whatever follows), null if it is none."""
    m = lambda i: F.regexp_extract(text, r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})", i)
    return F.try_to_timestamp(F.concat_ws("-", m(1), m(2), m(3)), F.lit("yyyy-M-d")).cast("date")


def session_date(text: Column) -> Column:
    """A session's date without its weekday in brackets; what can't be read is the earliest date."""
    return F.coalesce(_first(F.regexp_replace(F.trim(text), r"\s*\([A-Za-z]+\)", ""), SESSION_FORMATS), F.lit(EARLIEST).cast("timestamp"))


def anchor_or(anchor: Column, session: Column) -> Column:
    return F.when(anchor.isNull() | F.lower(anchor).isin("", "unknown"), session).otherwise(anchor)


def now_stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyyMMddHHmm")
