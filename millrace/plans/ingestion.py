"""Rows, pandas and Arrow tables as DataFrames, maps as structs, and DataFrames as rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.nested import map_keys_in_order, map_to_struct
from millrace.registry import query
from millrace.sources.export import to_json_rows, to_records
from millrace.sources.ingest import create_frame
from millrace.sources.tables import load

_XY = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.StringType())])


@query("create_from_rows", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) t(x, y)", covers="S01 S02 S08")
def create_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_name = create_frame(spark, [{"x": 1, "y": "a"}, {"x": 2}], _XY)
    return by_name.unionByName(create_frame(spark, [(3, "c")], _XY))


@query("create_from_pandas", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(x, y)", covers="S03 S05")
def create_from_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_frame(spark, pd.DataFrame({"y": ["a", "b"], "x": [1, 2]}), _XY)


@query("create_from_arrow", "SELECT * FROM (VALUES (1::BIGINT, 1.5::DOUBLE, true), (2, NULL, false)) t(id, amount, active)", covers="S06 S07")
def create_from_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_frame(spark, pa.table({"id": [1, 2], "amount": [1.5, None], "active": [True, False]}))


@query("create_from_scalars", "SELECT * FROM (VALUES (1), (2), (NULL)) t(value)", covers="S04")
def create_from_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_frame(spark, [1, 2, None], T.IntegerType())


@query("create_with_casts", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(x, y)", covers="S13")
def create_with_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_frame(spark, pa.table({"x": ["1", "2"], "y": ["a", "b"]}), _XY)


@query(
    "schema_types",
    "SELECT * FROM (VALUES ('s', 'string'), ('i', 'int'), ('l', 'bigint'), ('f', 'float'), ('d', 'double'), ('b', 'boolean'), "
    "('day', 'date'), ('ts', 'timestamp_ntz'), ('dec', 'decimal(10,2)'), ('t', 'tinyint'), ('h', 'smallint'), ('raw', 'binary'), "
    "('a', 'array<int>'), ('m', 'map<string,int>'), ('st', 'struct<x:int>')) t(name, kind)",
    covers="K06 K07 K08 T01 T02 T03 T04",
)
def schema_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ddl = (
        "s string, i int, l bigint, f float, d double, b boolean, day date, ts timestamp_ntz, dec decimal(10,2), t tinyint, "
        "h smallint, raw binary, a array<int>, m map<string,int>, st struct<x:int>"
    )
    now = dt.datetime(2024, 1, 2, 3, 4, 5)
    row = ("s", 1, 2, 1.5, 2.5, True, now.date(), now, Decimal("1.25"), 1, 2, b"x", [1], {"a": 1}, (1,))
    made = create_frame(spark, [row], ddl)
    return create_frame(spark, [(name, kind) for name, kind in made.dtypes], "name string, kind string")


@query(
    "schema_fields",
    "SELECT * FROM (VALUES ('head', 0, 'berth', false, 'dock number'), ('head', 1, 'cargo', true, NULL), ('tail', 0, 'cargo', true, NULL), "
    "('tail', 1, 'tons', true, 'metric'), ('one', 0, 'tons', true, 'metric')) t(part, place, name, nullable, note)",
    covers="K08 T02 T03",
)
def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.StructType([
        T.StructField("berth", T.IntegerType(), False, {"note": "dock number"}),
        T.StructField("cargo", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("tons", T.DoubleType(), True, {"note": "metric"}),
    ])
    schema = create_frame(spark, [(1, {"a": 1}, 2.5)], made).schema
    parts = {"head": schema[:2], "tail": schema[1:], "one": T.StructType([schema["tons"]])}
    rows = [(part, k, f.name, f.nullable, f.metadata.get("note")) for part, fields in parts.items() for k, f in enumerate(fields)]
    return create_frame(spark, rows, "part string, place int, name string, nullable boolean, note string")


@query(
    "map_to_struct",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS even, CASE WHEN event_id % 2 = 1 THEN event_id END AS odd FROM events",
    covers="S11",
)
def known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = _mapped(spark, sf_dir)
    return map_to_struct(mapped, "m", ["even", "odd"]).select("event_id", "m.*")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    return load(spark, sf_dir, "events").select(
        "event_id", F.when(even, F.create_map(F.lit("even"), "user_id")).otherwise(F.create_map(F.lit("odd"), "event_id")).alias("m")
    )


@query(
    "map_key_union",
    "SELECT key, row_number() OVER (ORDER BY first) - 1 AS place FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS key, "
    "min(event_id) AS first FROM events GROUP BY 1)",
    covers="S10 S11 S12",
)
def map_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = map_keys_in_order(_mapped(spark, sf_dir), "m", "event_id")
    return create_frame(spark, list(zip(keys, range(len(keys)), strict=True)), "key string, place bigint")


@query("to_pandas_roundtrip", "SELECT n_nationkey, n_name FROM nation", covers="K01 S05")
def to_pandas_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_frame(spark, load(spark, sf_dir, "nation").select("n_nationkey", "n_name").toPandas())


@query("to_arrow_roundtrip", "SELECT r_regionkey, r_name FROM region", covers="K02 S07")
def to_arrow_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_frame(spark, load(spark, sf_dir, "region").toArrow())


@query("to_records_roundtrip", "SELECT r_regionkey, r_name FROM region", covers="K01 K05")
def to_records_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_frame(spark, list(to_records(load(spark, sf_dir, "region"))), "r_regionkey int, r_name string")


@query(
    "to_json_rows",
    "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region",
    covers="K01",
)
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_json_rows(load(spark, sf_dir, "region"))


@query("count_action", "SELECT count(*) AS n FROM orders", covers="K04")
def count_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_frame(spark, [(load(spark, sf_dir, "orders").count(),)], "n bigint")
