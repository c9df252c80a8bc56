"""Maps with data-dependent keys as structs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def map_keys_in_order(df: DataFrame, column: str, order_by: str, most: int = 10_000) -> list[str]:
    """The distinct keys of a map column, by the first row (after ``order_by``) and place they occur in.

    Keys become a schema, so they are collected; the aggregation sends one row for each, and more than ``most`` of them
    are an error, as no schema of that width can be planned.
    """
    if not isinstance(df.schema[column].dataType, MapType):
        raise TypeError(f"{column!r} is no map")
    keys = df.select(F.col(order_by).alias("row"), F.posexplode(F.map_keys(column)).alias("place", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("row", "place")).alias("first"))
    found = [r.key for r in first.orderBy("first", "key").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column!r} has over {most} distinct keys")
    return found


def map_to_struct(df: DataFrame, column: str, keys: Sequence[str] | None = None, order_by: str | None = None) -> DataFrame:
    """Replace a map column by a struct with a field for each key; missing keys are null."""
    if keys is None:
        if order_by is None:
            raise ValueError("give the keys, or a column to order rows by")
        keys = map_keys_in_order(df, column, order_by)
    fields = [F.try_element_at(F.col(column), F.lit(key)).alias(key) for key in keys]
    return df.withColumn(column, F.struct(*fields))
