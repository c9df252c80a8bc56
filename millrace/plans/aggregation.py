"""Grouped aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import load


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("q"), F.col("l_linenumber").cast("bigint").alias("n"))


_Q = "(SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n FROM lineitem)"


@query("group_count", f"SELECT l_returnflag, count(*) AS count FROM {_Q} GROUP BY 1", covers="A01 A03")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantities(spark, sf_dir).groupby("l_returnflag").count()


@query("group_sum", f"SELECT l_returnflag, CAST(sum(q) AS BIGINT) AS q, CAST(sum(n) AS BIGINT) AS n FROM {_Q} GROUP BY 1", covers="A04")
def group_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantities(spark, sf_dir).groupBy("l_returnflag").sum().toDF("l_returnflag", "q", "n")


@query("group_mean", f"SELECT l_returnflag, avg(q) AS q, avg(n) AS n FROM {_Q} GROUP BY 1", covers="A05")
def group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantities(spark, sf_dir).groupBy("l_returnflag").mean().toDF("l_returnflag", "q", "n")


@query("group_max", f"SELECT l_returnflag, max(q) AS q, max(n) AS n FROM {_Q} GROUP BY 1", covers="A06")
def group_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantities(spark, sf_dir).groupBy("l_returnflag").max().toDF("l_returnflag", "q", "n")


@query("group_min", f"SELECT l_returnflag, min(q) AS q, min(n) AS n FROM {_Q} GROUP BY 1", covers="A07")
def group_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantities(spark, sf_dir).groupBy("l_returnflag").min().toDF("l_returnflag", "q", "n")


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_type", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("x"))


_H = "(SELECT event_type, user_id, CASE WHEN event_id % 7 <> 0 THEN event_id END AS x FROM events)"


@query("agg_count", f"SELECT event_type, count(x) AS n_x, count(*) AS n FROM {_H} GROUP BY 1", covers="A02 A08")
def agg_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holed(spark, sf_dir).groupBy("event_type").agg(F.count("x").alias("n_x"), F.count("*").alias("n"))


@query("agg_sum", f"SELECT event_type, CAST(sum(x) AS BIGINT) AS total FROM {_H} GROUP BY 1", covers="A09")
def agg_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holed(spark, sf_dir).groupBy("event_type").agg(F.sum("x").alias("total"))


@query("agg_mean", f"SELECT event_type, avg(x) AS mean_x FROM {_H} GROUP BY 1", covers="A10")
def agg_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holed(spark, sf_dir).groupBy("event_type").agg(F.mean("x").alias("mean_x"))


@query("agg_min", f"SELECT event_type, min(x) AS low FROM {_H} GROUP BY 1", covers="A11")
def agg_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holed(spark, sf_dir).groupBy("event_type").agg(F.min("x").alias("low"))


@query("agg_max", f"SELECT event_type, max(x) AS high FROM {_H} GROUP BY 1", covers="A12")
def agg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holed(spark, sf_dir).groupBy("event_type").agg(F.max("x").alias("high"))


@query(
    "agg_multi_key",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total, max(l_tax) AS tax "
    "FROM lineitem GROUP BY 1, 2",
    covers="A01 A02",
)
def agg_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(38,2)")
    grouped = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return grouped.agg(F.count(F.lit(1)).alias("n"), total.alias("total"), F.max("l_tax").alias("tax"))


@query(
    "agg_null_group",
    "SELECT k, count(*) AS n, CAST(sum(CASE WHEN k <> 1 THEN event_id END) AS BIGINT) AS total FROM "
    "(SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_id % 4 END AS k FROM events) GROUP BY k",
    covers="A01 A09",
)
def agg_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = load(spark, sf_dir, "events").withColumn("k", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4))
    return keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("k") != 1, F.col("event_id"))).alias("total"))


@query(
    "collect_list",
    "SELECT c_nationkey, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS keys FROM "
    "(SELECT c_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS k FROM customer) WHERE k IS NOT NULL GROUP BY 1",
    covers="A13",
)
def collect_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = load(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("k"))
    grouped = holed.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("k")).alias("ks")).filter(F.size("ks") > 0)
    return grouped.select("c_nationkey", F.array_join(F.col("ks").cast("array<string>"), ",").alias("keys"))


@query(
    "collect_list_struct",
    "SELECT n_regionkey, string_agg(n_nationkey || ':' || n_name, ';' ORDER BY n_nationkey) AS nations FROM nation GROUP BY 1",
    covers="A14 F16",
)
def collect_list_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("name")).alias("about"))
    grouped = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    texts = F.transform("entries", lambda e: F.concat_ws(":", e["id"].cast("string"), e["about"]["name"]))
    return grouped.select("n_regionkey", F.array_join(texts, ";").alias("nations"))
