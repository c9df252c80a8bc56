"""Projection, filters, column management and null filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.relational import fill_exact, fill_known, rename_strict
from millrace.registry import query
from millrace.sources.tables import load


@query("select_columns", "SELECT c_custkey, c_name FROM customer", covers="R01")
def select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name")


@query("select_list", "SELECT c_custkey, c_nationkey FROM customer", covers="R01")
def select_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(["c_custkey", "c_nationkey"])


@query("select_column_objects", "SELECT c_custkey, c_acctbal FROM customer", covers="R01")
def select_column_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_custkey"), F.col("c_acctbal"))


@query("select_alias", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer", covers="R01 C07")
def select_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))


@query("select_expr", "SELECT p_partkey, p_size * 2 + 1 AS size2 FROM part", covers="R01 C01")
def select_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 2 + 1).alias("size2"))


@query("select_dotted_struct", "SELECT c_custkey, c_name AS name, c_nationkey AS key FROM customer", covers="R02 F01")
def select_dotted_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.struct(F.col("c_nationkey").alias("key"))
    nested = load(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), inner.alias("nation")).alias("c"))
    return nested.select("c_custkey", "c.name", "c.nation.key")


@query("select_dotted_map", "SELECT c_custkey, c_name AS a, NULL::VARCHAR AS missing FROM customer", covers="R02 F01 S10")
def select_dotted_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = load(spark, sf_dir, "customer").select("c_custkey", F.create_map(F.lit("a"), "c_name", F.lit("b"), "c_mktsegment").alias("m"))
    return nested.select("c_custkey", "m.a", "m.missing")


@query(
    "global_agg",
    "SELECT count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS total, max(l_tax) AS top FROM lineitem",
    covers="R03 A08 A09 A12",
)
def global_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(38,2)")
    return load(spark, sf_dir, "lineitem").select(F.count(F.lit(1)).alias("n"), total.alias("total"), F.max("l_tax").alias("top"))


@query("with_column_add", "SELECT o_orderkey, o_custkey, o_custkey + 1 AS next_key FROM orders", covers="R04")
def with_column_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("next_key", F.col("o_custkey") + 1)


@query("with_column_replace", "SELECT o_orderkey, o_custkey * 10 AS o_custkey FROM orders", covers="R04")
def with_column_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("o_custkey", F.col("o_custkey") * 10)


@query("with_column_renamed", "SELECT n_nationkey AS id, n_name FROM nation", covers="R05")
def with_column_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename_strict(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "id")


@query("drop_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer", covers="R06")
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").drop("c_nationkey", "c_acctbal")


@query("drop_missing", "SELECT * FROM nation", covers="R06")
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").drop("no_such_column")


@query("drop_column_expr", "SELECT n_nationkey, n_name FROM nation", covers="R06")
def drop_column_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").drop(F.col("n_regionkey"))


@query(
    "alias_self_join",
    "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b "
    "ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    covers="R07 J01",
)
def alias_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation")
    pairs = nation.alias("a").join(
        nation.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    )
    return pairs.select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@query("filter_column", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000", covers="R08 C05")
def filter_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 100000).select("o_orderkey", "o_totalprice")


@query(
    "where_and_or",
    "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 50000) OR o_orderpriority = '1-URGENT'",
    covers="R08 C06",
)
def where_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 50000)
    return load(spark, sf_dir, "orders").where(dear | (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("filter_bool_column", "SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0", covers="R08")
def filter_bool_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = load(spark, sf_dir, "orders").withColumn("even", F.col("o_custkey") % 2 == 0)
    return marked.filter("even").select("o_orderkey")


@query("filter_null_condition", "SELECT event_id FROM events WHERE CASE WHEN event_id % 7 <> 0 THEN value END > 50", covers="R08")
def filter_null_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return load(spark, sf_dir, "events").filter(holed > 50).select("event_id")


@query("getitem_filter", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1", covers="R10")
def getitem_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation")
    return nation[nation["n_regionkey"] == 1].select("n_nationkey", "n_name")


@query("getitem_list", "SELECT n_name, n_regionkey FROM nation", covers="R11")
def getitem_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation")[["n_name", "n_regionkey"]]


@query("getitem_str_int", "SELECT n_nationkey AS a, n_name AS b FROM nation", covers="R09")
def getitem_str_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return nation.select(nation[0].alias("a"), nation["n_name"].alias("b"))


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with nulls in a column of each family, as the tables have none."""
    events = load(spark, sf_dir, "events")
    keep = F.col("event_id") % 7 != 0
    return events.select(
        "event_id",
        F.when(keep, F.col("user_id")).alias("user_id"),
        F.when(keep, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 3 != 0, F.col("value") > 50).alias("high"),
    )


_HOLED = """
WITH h AS (
  SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id,
         CASE WHEN event_id % 7 <> 0 THEN value END AS value,
         CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 3 <> 0 THEN value > 50 END AS high
  FROM events)
"""


@query(
    "fillna_scalar_int",
    _HOLED + "SELECT event_id, coalesce(user_id, 0) AS user_id, coalesce(value, 0) AS value, event_type, high FROM h",
    covers="R13",
)
def fillna_scalar_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holed(spark, sf_dir).fillna(0)


@query(
    "fillna_scalar_str",
    _HOLED + "SELECT event_id, user_id, value, coalesce(event_type, 'none') AS event_type, high FROM h",
    covers="R13",
)
def fillna_scalar_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holed(spark, sf_dir).fillna("none")


@query("fillna_bool", _HOLED + "SELECT event_id, user_id, value, event_type, coalesce(high, false) AS high FROM h", covers="R13")
def fillna_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holed(spark, sf_dir).fillna(False)


@query("fillna_subset", _HOLED + "SELECT event_id, coalesce(user_id, -1) AS user_id, value, event_type, high FROM h", covers="R13")
def fillna_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holed(spark, sf_dir).fillna(-1, subset=["user_id"])


@query(
    "fillna_dict",
    _HOLED + "SELECT event_id, user_id, coalesce(value, 1.5) AS value, coalesce(event_type, '?') AS event_type, high FROM h",
    covers="R14",
)
def fillna_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_known(_holed(spark, sf_dir), {"value": 1.5, "event_type": "?", "no_such_column": 1})


@query(
    "fillna_float_exact",
    _HOLED + "SELECT event_id, user_id, coalesce(value, 2.5) AS value, event_type, high FROM h",
    covers="R13",
)
def fillna_float_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_exact(_holed(spark, sf_dir), 2.5)
