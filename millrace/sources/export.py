"""Rows as JSON-friendly Python values."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row


def plain(value: Any) -> Any:
    """NaN as None, whole floats as ints, rows and maps as dicts without null values, arrays as lists."""
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value.is_integer() else value
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def to_records(df: DataFrame) -> Iterator[dict[str, Any]]:
    """One dict per row, fetched partition by partition; top-level nulls are kept."""
    for row in df.toLocalIterator():
        yield {name: plain(value) for name, value in row.asDict().items()}


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, made on the executors."""
    return df.selectExpr("to_json(struct(*)) AS value")
