"""Equi-joins of every kind over whole tables. Odd customers' orders get negated keys, so both sides have unmatched rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.relational import join_common, join_outer_keep_left, join_suffixed
from millrace.registry import query
from millrace.sources.tables import load


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    key = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).otherwise(-F.col("o_custkey"))
    right = load(spark, sf_dir, "orders").select(key.alias("id"), F.col("o_orderkey").alias("order_id"))
    return left, right


_L = "(SELECT c_custkey AS id, c_name AS name FROM customer)"
_R = "(SELECT CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE -o_custkey END AS id, o_orderkey AS order_id FROM orders)"


@query("join_inner", f"SELECT id, name, order_id FROM {_L} JOIN {_R} USING (id)", covers="J01")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return left.join(right, "id", "inner")


def _spellings(left: DataFrame, right: DataFrame, names: tuple[str, ...]) -> DataFrame:
    parts = [left.join(right, "id", how).withColumn("how", F.lit(how)) for how in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _each(sql: str, names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT *, '{how}' AS how FROM ({sql})" for how in names)


_LEFT, _RIGHT, _FULL = ("left", "leftouter", "left_outer"), ("right", "rightouter", "right_outer"), ("outer", "full", "fullouter", "full_outer")
_SEMI, _ANTI = ("semi", "leftsemi", "left_semi"), ("anti", "leftanti", "left_anti")


@query("join_left", _each(f"SELECT id, name, order_id FROM {_L} LEFT JOIN {_R} USING (id)", _LEFT), covers="J02")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spellings(*_sides(spark, sf_dir), _LEFT)


@query("join_right", _each(f"SELECT id, name, order_id FROM {_L} RIGHT JOIN {_R} USING (id)", _RIGHT), covers="J03")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spellings(*_sides(spark, sf_dir), _RIGHT)


@query("join_outer", f"SELECT id, name, order_id FROM {_L} FULL JOIN {_R} USING (id)", covers="J04")
def join_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return left.join(right, ["id"], "outer")


@query("join_full_aliases", _each(f"SELECT id, name, order_id FROM {_L} FULL JOIN {_R} USING (id)", _FULL), covers="J06")
def join_full_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spellings(*_sides(spark, sf_dir), _FULL)


@query("join_semi", _each(f"SELECT id, name FROM {_L} SEMI JOIN {_R} USING (id)", _SEMI), covers="J07")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spellings(*_sides(spark, sf_dir), _SEMI)


@query("join_anti", _each(f"SELECT id, name FROM {_L} ANTI JOIN {_R} USING (id)", _ANTI), covers="J08")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spellings(*_sides(spark, sf_dir), _ANTI)


@query(
    "join_null_keys",
    "SELECT a.event_id AS left_id, b.n_name FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 25 END AS k FROM events) a "
    "LEFT JOIN (SELECT n_name, CASE WHEN n_nationkey > 4 THEN n_nationkey END AS k FROM nation) b ON a.k = b.k",
    covers="J02",
)
def join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select(F.col("event_id").alias("left_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 25).alias("k"))
    nation = load(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_nationkey") > 4, F.col("n_nationkey")).cast("bigint").alias("k"))
    return events.join(nation, "k", "left").select("left_id", "n_name")


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", covers="J09")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Five regions by 25 nations: the product is the operator that is shown.
    return load(spark, sf_dir, "region").select("r_name").crossJoin(load(spark, sf_dir, "nation").select("n_name"))


@query("join_outer_column_keep_left", f"SELECT l.id, name, order_id FROM {_L} l FULL JOIN {_R} r ON l.id = r.id", covers="J05")
def outer_keep_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_outer_keep_left(*_sides(spark, sf_dir), "id")


@query(
    "join_multi_key",
    "SELECT a.conv_id, a.turn, a.role, b.role AS next_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn",
    covers="J11",
)
def join_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"))
    return turns.join(following, ["conv_id", "turn"])


@query(
    "join_suffixed",
    "SELECT a.n_regionkey, a.n_nationkey, a.n_name, b.n_nationkey AS n_nationkey_right, b.n_name AS n_name_right "
    "FROM nation a JOIN nation b USING (n_regionkey)",
    covers="J10",
)
def suffixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation")
    return join_suffixed(nation, nation, "n_regionkey")


@query(
    "join_common",
    "SELECT id, name, order_id FROM " + f"{_L} JOIN {_R} USING (id)",
    covers="J13",
)
def common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_common(*_sides(spark, sf_dir))


@query("join_column_key", f"SELECT l.id, name, order_id FROM {_L} l JOIN {_R} r ON l.id = r.id", covers="J12")
def join_column_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return left.join(right, left["id"] == right["id"]).select(left["id"], "name", "order_id")
