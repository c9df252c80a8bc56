"""Timestamps and dates parsed with a literal Spark pattern. Timestamps carry no zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.columns import _column

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_FORMAT = "yyyy-MM-dd"


def parse_timestamp(text: Column | str, pattern: str = TIMESTAMP_FORMAT) -> Column:
    """Strict: malformed text fails the query."""
    return F.to_timestamp(_column(text), pattern).cast("timestamp_ntz")


def try_parse_timestamp(text: Column | str, pattern: str = TIMESTAMP_FORMAT) -> Column:
    """Null for malformed text."""
    return F.try_to_timestamp(_column(text), F.lit(pattern)).cast("timestamp_ntz")


def try_parse_date(text: Column | str, pattern: str = DATE_FORMAT) -> Column:
    """Null for malformed text. The pattern is always passed on, as without one Spark accepts looser text."""
    return F.try_to_date(_column(text), pattern)
