"""Column operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.registry import query
from millrace.sources.tables import load


@query(
    "arith_ops",
    "SELECT o_orderkey, o_orderkey + 3 AS plus, o_orderkey - 3 AS minus, o_orderkey * 3 AS times, o_totalprice / 4 AS part FROM orders",
    covers="C01 C02",
)
def arith_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        key, (key + 3).alias("plus"), (key - 3).alias("minus"), (key * 3).alias("times"), (F.col("o_totalprice") / 4).alias("part")
    )


@query(
    "reverse_arith",
    "SELECT o_orderkey, 10 + o_orderkey AS plus, 10 - o_orderkey AS minus, 10 * o_orderkey AS times, 1000.0::DOUBLE / o_totalprice AS part FROM orders",
    covers="C03",
)
def reverse_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        key, (10 + key).alias("plus"), (10 - key).alias("minus"), (10 * key).alias("times"), (1000.0 / F.col("o_totalprice")).alias("part")
    )


@query(
    "divide_or_null",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / (event_id % 5) END AS ratio FROM events",
    covers="C02",
)
def divide_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.try_divide("value", F.col("event_id") % 5).alias("ratio"))


@query(
    "compare_ops",
    "SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part",
    covers="C04 C05",
)
def compare_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    tests = {"eq": size == 10, "ne": size != 10, "lt": size < 10, "le": size <= 10, "gt": size > 10, "ge": size >= 10}
    return load(spark, sf_dir, "part").select("p_partkey", *(test.alias(name) for name, test in tests.items()))


@query(
    "compare_timestamp_text",
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01 00:00:00'",
    covers="C05",
)
def compare_timestamp_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= "1995-06-01 00:00:00").select("o_orderkey")


@query(
    "logical_ops",
    "SELECT event_id, a AND b AS both, a OR b AS either FROM (SELECT event_id, "
    "CASE WHEN event_id % 3 <> 0 THEN value > 50 END AS a, CASE WHEN event_id % 4 <> 0 THEN user_id % 2 = 0 END AS b FROM events)",
    covers="C06",
)
def logical_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("event_id") % 3 != 0, F.col("value") > 50)
    b = F.when(F.col("event_id") % 4 != 0, F.col("user_id") % 2 == 0)
    return load(spark, sf_dir, "events").select("event_id", (a & b).alias("both"), (a | b).alias("either"))


@query(
    "cast_numeric",
    "SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS whole, CAST(o_custkey AS DOUBLE) AS real, CAST(o_custkey % 100 AS TINYINT) AS tiny FROM orders",
    covers="C08",
)
def cast_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").cast(T.IntegerType()).alias("whole"),
        F.col("o_custkey").cast(T.DoubleType()).alias("real"),
        (F.col("o_custkey") % 100).cast(T.ByteType()).alias("tiny"),
    )


@query("cast_string", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS text, CAST(o_custkey > 5 AS VARCHAR) AS flag FROM orders", covers="C08")
def cast_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast(T.StringType()).alias("text"), (F.col("o_custkey") > 5).cast(T.StringType()).alias("flag")
    )


@query(
    "cast_date_ts",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS midnight FROM orders",
    covers="C08",
)
def cast_date_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast(T.DateType())
    return load(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), day.cast(T.TimestampNTZType()).alias("midnight"))


@query("cast_decimal", "SELECT c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS balance FROM customer", covers="C08")
def cast_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast(T.DecimalType(12, 2)).alias("balance"))


_MIXED = "CASE WHEN event_id % 3 = 0 THEN 'Bob' WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END"


def _mixed():
    return F.when(F.col("event_id") % 3 == 0, "Bob").when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string"))


@query("try_cast_obj", f"SELECT event_id, TRY_CAST({_MIXED} AS BIGINT) AS n FROM events", covers="C09")
def try_cast_obj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", _mixed().try_cast(T.LongType()).alias("n"))


@query("try_cast_name", f"SELECT event_id, TRY_CAST({_MIXED} AS DOUBLE) AS x FROM events", covers="C09 T05")
def try_cast_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", _mixed().try_cast("double").alias("x"))


@query("isin_varargs", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')", covers="C10")
def isin_varargs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey")


@query("isin_list", "SELECT o_orderkey, o_custkey IN (1, 2, 3, 40) AS picked FROM orders", covers="C10")
def isin_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").isin([1, 2, 3, 40]).alias("picked"))


@query("isin_empty", "SELECT n_nationkey, false AS picked FROM nation", covers="C10")
def isin_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").isin([]).alias("picked"))


@query("is_not_null", "SELECT event_id, event_id % 7 <> 0 AS present FROM events", covers="C11")
def is_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return load(spark, sf_dir, "events").select("event_id", holed.isNotNull().alias("present"))


@query("rlike", "SELECT p_partkey, regexp_matches(p_brand, '^Brand#[1-3]\\d+$') AS hit FROM part", covers="C12")
def rlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").rlike(r"^Brand#[1-3]\d+$").alias("hit"))


@query("contains_literal", "SELECT p_partkey, contains(p_brand, '#1') AS hit, contains(p_brand, '.') AS dot FROM part", covers="C13")
def contains_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.col("p_brand")
    return load(spark, sf_dir, "part").select("p_partkey", brand.contains("#1").alias("hit"), brand.contains(".").alias("dot"))


@query("getitem_struct", "SELECT c_custkey, c_name AS name FROM customer", covers="C14")
def getitem_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = load(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name")).alias("s"))
    return nested.select("c_custkey", F.col("s").getItem("name").alias("name"))


@query("getitem_map", "SELECT c_custkey, c_name AS name, NULL::VARCHAR AS absent FROM customer", covers="C14")
def getitem_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = load(spark, sf_dir, "customer").select("c_custkey", F.create_map(F.lit("name"), "c_name").alias("m"))
    return nested.select("c_custkey", F.col("m").getItem("name").alias("name"), F.col("m").getItem("x").alias("absent"))


@query("getitem_array", "SELECT vec_id, embedding[1] AS first, embedding[64] AS last FROM embeddings", covers="C15")
def getitem_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select("vec_id", vector.getItem(0).alias("first"), vector.getItem(63).alias("last"))
