"""Safe access to arrays, maps and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def element_or_null(array: Column | str, index: int) -> Column:
    """The element at a 1-based index, counted from the end if negative; null out of bounds and for 0."""
    if index == 0:
        return F.get(_column(array), F.lit(-1))  # typed null
    return F.try_element_at(_column(array), F.lit(index))


def value_or_null(mapping: Column | str, key: Column | str) -> Column:
    """The value of a key, or null. A string is the key itself; a Column is evaluated for each row."""
    return F.try_element_at(_column(mapping), key if isinstance(key, Column) else F.lit(key))


def json_path(text: Column | str, path: str) -> Column:
    """The JSON value at ``path``, which starts with ``$``; null for malformed text or a missing path."""
    if not path.startswith("$"):
        raise ValueError(f"a JSON path starts with '$': {path!r}")
    return F.get_json_object(_column(text), path)


def typed_null(kind: str) -> Column:
    """A null of a type, as a bare ``lit(None)`` has none."""
    return F.lit(None).cast(kind)
