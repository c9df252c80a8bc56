"""DataFrames from driver-side data."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, MapType, StructType


def create_frame(spark: SparkSession, data: Any, schema: StructType | DataType | str | list[str] | None = None) -> DataFrame:
    """Rows, scalars, pandas, Arrow or anything with ``to_arrow()`` as a DataFrame.

    Rows are dicts (by name; missing values are null) or sequences (by position). pandas columns are matched to a
    struct schema by name. A single type as schema gives one column ``value``. Schemas can be DDL text.
    """
    if hasattr(data, "to_arrow") and not isinstance(data, DataFrame):
        data = data.to_arrow()
    if isinstance(data, pa.Table):
        frame = spark.createDataFrame(data)
        return cast_scalars(frame, schema) if isinstance(schema, StructType) else frame
    if isinstance(data, pd.DataFrame):
        if isinstance(schema, StructType):
            data = data.reindex(columns=schema.fieldNames()).astype(object)
            whole = [isinstance(f.dataType, IntegralType) for f in schema.fields]
            rows = [tuple(map(_cell, row, whole)) for row in data.itertuples(index=False, name=None)]
            return spark.createDataFrame(rows, schema)
        return spark.createDataFrame(data) if schema is None else spark.createDataFrame(data, schema)
    if not isinstance(data, Iterable) or isinstance(data, (str, bytes)):
        raise TypeError(f"cannot make a DataFrame from {type(data).__name__}")
    rows = list(data)
    if isinstance(schema, StructType) and len(schema) == 1:
        rows = [row if isinstance(row, (dict, tuple, list)) else (row,) for row in rows]
    return spark.createDataFrame(rows, schema)


def _cell(value: Any, whole: bool) -> Any:
    """A pandas value as Spark takes it: missing ones as None, and floats that stand for integers as such."""
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    return int(value) if whole and isinstance(value, float) and value.is_integer() else value


def cast_scalars(df: DataFrame, schema: StructType) -> DataFrame:
    """Strictly cast the top-level scalar columns that the schema names; nested ones stay as they are."""
    kinds = {f.name: f.dataType for f in schema.fields if not isinstance(f.dataType, (StructType, MapType, ArrayType))}
    return df.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns))
