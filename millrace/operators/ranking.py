"""Ranks within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANKS = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}


def rank_within(
    df: DataFrame, partition: Sequence[str], order: Sequence[Column], name: str = "rank", method: str = "rank"
) -> DataFrame:
    """Add a bigint rank of each row in its partition."""
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, _RANKS[method]().over(window).cast("bigint"))


def top_k_per_group(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each partition; Spark limits groups before it moves them."""
    ranked = rank_within(df, partition, order, "_row", "row_number")
    return ranked.filter(F.col("_row") <= k).drop("_row")
