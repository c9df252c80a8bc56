"""Ranking windows and sorts.

Sorts return whole tables in order; rows that are compared as a set can't show that, so each ordering has a top-k report
too, of which the rows depend on the order, and the tests compare the rows of the sorts one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import rank_within, top_k_per_group
from millrace.registry import query
from millrace.sources.tables import load


def _register_rank(method: str, sql: str, covers: str) -> None:
    @query(
        method,
        f"SELECT o_orderkey, CAST({sql}() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS r FROM orders"
        if method != "row_number"
        else "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders",
        covers=covers,
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        order = [F.desc("o_totalprice"), F.asc("o_orderkey")] if method == "row_number" else [F.asc("o_orderpriority")]
        return rank_within(load(spark, sf_dir, "orders"), ["o_custkey"], order, "r", method).select("o_orderkey", "r")


for _method, _covers in (("rank", "W01 W02 W05 W08"), ("dense_rank", "W06 W08"), ("row_number", "W07 W08")):
    _register_rank(_method, _method, _covers)


@query(
    "rank_multi_order",
    "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_orderpriority) AS r FROM orders",
    covers="W02 W05",
)
def rank_multi_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("o_orderstatus"), F.asc("o_orderpriority")]
    return rank_within(load(spark, sf_dir, "orders"), ["o_custkey"], order, "r").select("o_orderkey", "r")


_NULLS = "(SELECT event_id, event_type, CASE WHEN event_id % 3 <> 0 THEN user_id END AS u FROM events)"


@query(
    "rank_nulls",
    "SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY v ASC NULLS FIRST) AS up, "
    "rank() OVER (PARTITION BY user_id ORDER BY v DESC NULLS LAST) AS down "
    "FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)",
    covers="W05",
)
def rank_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = load(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    ranked = rank_within(holed, ["user_id"], [F.asc("v")], "up")
    return rank_within(ranked, ["user_id"], [F.desc("v")], "down").select("event_id", "up", "down")


@query(
    "window_range_sum",
    "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY date_diff('day', DATE '1992-01-01', o_orderdate) "
    "RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM orders",
    covers="W03 W04",
)
def window_range_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))
    window = Window.partitionBy("o_custkey").orderBy(days).rangeBetween(-90, Window.currentRow)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.sum("o_orderkey").over(window).alias("total"))


@query(
    "window_unbounded",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    covers="W04",
)
def window_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.count(F.lit(1)).over(window).alias("n"))


@query(
    "topk_per_group",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2",
    covers="W07",
)
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return top_k_per_group(load(spark, sf_dir, "orders"), ["o_custkey"], order, 2).select("o_custkey", "o_orderkey")


_ORDERS = {
    "sort_asc": (F.asc, "u ASC NULLS FIRST", "O01 O05"),
    "sort_desc": (F.desc, "u DESC NULLS LAST", "O01 O07"),
    "sort_asc_nulls_first": (F.asc_nulls_first, "u ASC NULLS FIRST", "O05"),
    "sort_asc_nulls_last": (F.asc_nulls_last, "u ASC NULLS LAST", "O06"),
    "sort_desc_nulls_first": (F.desc_nulls_first, "u DESC NULLS FIRST", "O08"),
    "sort_desc_nulls_last": (F.desc_nulls_last, "u DESC NULLS LAST", "O07"),
}


#: Rows of a top-k report.
_TOP = 50


def _register_sort(name: str) -> None:
    order, sql, covers = _ORDERS[name]

    def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
        holed = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("u"))
        return holed.orderBy(order("u"), "event_id")

    oracle = f"SELECT event_id, u FROM {_NULLS} ORDER BY {sql}, event_id"
    query(name, oracle, covers=covers)(ordered)
    query(f"{name}_top", f"{oracle} LIMIT {_TOP}", covers=covers)(lambda spark, sf_dir: ordered(spark, sf_dir).limit(_TOP))


for _name in _ORDERS:
    _register_sort(_name)


def _ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey").orderBy(1, -2)


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return kept.sort("c_mktsegment", F.desc("c_acctbal"), F.col("c_custkey"))


_ORDINAL = "SELECT s_nationkey, s_suppkey FROM supplier ORDER BY 1, 2 DESC"
_MULTI = "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey"
query("sort_ordinal", _ORDINAL, covers="O03")(_ordinal)
query("sort_ordinal_top", f"{_ORDINAL} LIMIT {_TOP}", covers="O03")(lambda spark, sf_dir: _ordinal(spark, sf_dir).limit(_TOP))
query("sort_multi", _MULTI, covers="O01 O02 O04")(_multi)
query("sort_multi_top", f"{_MULTI} LIMIT {_TOP}", covers="O01 O02 O04")(lambda spark, sf_dir: _multi(spark, sf_dir).limit(_TOP))
