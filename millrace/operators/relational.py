"""Null filling and joins by rules that plain PySpark does not have."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType,
)

_FAMILIES: dict[type, tuple[type[DataType], ...]] = {
    bool: (BooleanType,),
    int: (ByteType, ShortType, IntegerType, LongType),
    float: (FloatType, DoubleType),
    str: (StringType,),
}


def fill_exact(df: DataFrame, value: bool | int | float | str, subset: Iterable[str] | None = None) -> DataFrame:
    """Fill nulls (not NaN) in the columns of the value's own type family only; unknown names are ignored."""
    family = _FAMILIES[type(value)]
    wanted = set(df.columns if subset is None else subset)
    columns = {
        f.name: F.coalesce(F.col(f"`{f.name}`"), F.lit(value).cast(f.dataType))
        for f in df.schema.fields
        if f.name in wanted and isinstance(f.dataType, family)
    }
    return df.withColumns(columns) if columns else df


def fill_known(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """``fillna`` with a value for each column, without those that ``df`` lacks."""
    known = {name: value for name, value in values.items() if name in df.columns}
    return df.fillna(known) if known else df


def rename_strict(df: DataFrame, existing: str, new: str) -> DataFrame:
    """Rename a column that must exist."""
    if existing not in df.columns:
        raise ValueError(f"no column {existing!r}")
    return df.withColumnRenamed(existing, new)


def join_suffixed(
    left: DataFrame, right: DataFrame, on: str | list[str] | None, how: str = "inner", suffix: str = "_right"
) -> DataFrame:
    """Join by name; columns of the right side that the left has too, other than keys, get a suffix."""
    keys = [on] if isinstance(on, str) else list(on or [])
    renames = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in keys}
    renamed = right.withColumnsRenamed(renames)
    return left.crossJoin(renamed) if how == "cross" else left.join(renamed, keys, how)


def join_common(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns that both sides have."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("the sides have no column in common")
    return left.join(right, common, how)


def join_outer_keep_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join that keeps the left key alone: it is null in rows of the right side only."""
    return left.join(right, left[key] == right[key], "full_outer").drop(right[key])
