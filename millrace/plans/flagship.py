"""The end-to-end query: joins, filter, projection, aggregation and ranking in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import load

ORACLE = """
SELECT n_name, CAST(revenue AS DECIMAL(28,4)) AS revenue, n_items,
       CAST(rank() OVER (ORDER BY revenue DESC) AS BIGINT) AS revenue_rank
FROM (
  SELECT n_name, count(*) AS n_items,
         sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS revenue
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  WHERE l_returnflag = 'R'
  GROUP BY n_name)
"""


@query("revenue_by_nation", ORACLE, covers="R01 R04 R08 J01 A01 A02 A08 A09 W05 C01")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned-item revenue of each nation with its rank."""
    lineitem = load(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    orders = load(spark, sf_dir, "orders")
    customer = load(spark, sf_dir, "customer")
    nation = load(spark, sf_dir, "nation")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    by_nation = (
        lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .withColumn("item_revenue", price * (F.lit(1) - discount))
        .groupBy("n_name")
        .agg(F.sum("item_revenue").alias("revenue"), F.count(F.lit(1)).alias("n_items"))
    )
    # One row for each nation reaches the unpartitioned window.
    return by_nation.select(
        "n_name",
        F.col("revenue").cast("decimal(28,4)").alias("revenue"),
        "n_items",
        F.rank().over(Window.orderBy(F.desc("revenue"))).cast("bigint").alias("revenue_rank"),
    )
