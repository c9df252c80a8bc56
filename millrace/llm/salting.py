"""Joins that deal the rows of a hot key over several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(rows: DataFrame, same: Column, spread: Column, table: DataFrame, how: str = "inner", salts: int = 8) -> DataFrame:
    """``rows`` joined to ``table``, which has a row at most for each key, where ``same`` (equal keys) holds.

    A key's rows are dealt over ``salts`` by the hash of ``spread``, and the table's rows are repeated for each salt.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = table.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, same & (F.col("_salt") == F.col("_other")), how).drop("_salt", "_other")
