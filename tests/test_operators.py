"""Helpers on small fixtures: sessions, ingestion, export, null rules and errors."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import build_session
from millrace.functions.columns import element_or_null, json_path, value_or_null
from millrace.functions.temporal import try_parse_date, try_parse_timestamp
from millrace.operators.nested import map_keys_in_order, map_to_struct
from millrace.operators.ranking import rank_within
from millrace.operators.relational import fill_exact, fill_known, join_common, join_outer_keep_left, join_suffixed, rename_strict
from millrace.sources.export import plain, to_records
from millrace.sources.ingest import create_frame

XY = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.StringType())])


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_session(spark):
    assert build_session() is spark or build_session().sparkContext is spark.sparkContext
    spark.sparkContext.setLogLevel("ERROR")
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_rows_by_name_and_position(spark):
    assert rows(create_frame(spark, [{"y": "a"}, {"x": 2, "y": None}], XY)) == [(None, "a"), (2, None)]
    assert rows(create_frame(spark, [(1, "a")], XY)) == [(1, "a")]
    with pytest.raises(Exception, match="LENGTH"):
        create_frame(spark, [(1,)], XY).collect()


def test_pandas_is_matched_by_name(spark):
    frame = pd.DataFrame({"y": ["a", None], "x": [1.0, float("nan")]})
    assert rows(create_frame(spark, frame.astype({"x": object}).where(frame.notna(), None), XY)) == [(1, "a"), (None, None)]
    assert create_frame(spark, pd.DataFrame({"a": [1]})).columns == ["a"]


def test_arrow_scalars_and_duck_typed_frames(spark):
    class Frame:
        def to_arrow(self):
            return pa.table({"x": [1, 2]})

    assert rows(create_frame(spark, Frame())) == [(1,), (2,)]
    assert rows(create_frame(spark, [1, None], T.IntegerType())) == [(1,), (None,)]
    assert rows(create_frame(spark, [1, 2], T.StructType([T.StructField("v", T.IntegerType())]))) == [(1,), (2,)]
    with pytest.raises(TypeError):
        create_frame(spark, 5)


def test_fill_rules(spark):
    frame = spark.createDataFrame([(None, None, None, None), (1, 1.5, "a", True)], "i int, f double, s string, b boolean")
    assert rows(fill_exact(frame, 7))[0] == (7, None, None, None)
    assert rows(fill_exact(frame, 2.5))[0] == (None, 2.5, None, None)
    assert rows(fill_exact(frame, "z", ["s", "nope"]))[0] == (None, None, "z", None)
    assert rows(fill_exact(frame, True))[0] == (None, None, None, True)
    assert rows(fill_known(frame, {"i": 3, "nope": 1}))[0][0] == 3


def test_strict_rename(spark):
    frame = spark.range(1)
    assert rename_strict(frame, "id", "x").columns == ["x"]
    with pytest.raises(ValueError):
        rename_strict(frame, "nope", "x")


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([(70, "oak"), (71, "elm"), (71, "ash"), (75, None)], "id bigint, v string")
    right = spark.createDataFrame([(71, "mill"), (75, "lock"), (None, "weir"), (90, "sluice")], "id bigint, v string")
    return left, right


def test_joins(sides):
    left, right = sides
    assert join_suffixed(left, right, "id").columns == ["id", "v", "v_right"]
    want = [(70, "oak", None), (71, "ash", "mill"), (71, "elm", "mill"), (75, None, "lock")]
    assert sorted(rows(join_suffixed(left, right, "id", "left")), key=str) == want
    assert join_suffixed(left, right, None, "cross").columns == ["id", "v", "id_right", "v_right"]
    assert join_common(left, right).count() == 0
    with pytest.raises(ValueError):
        join_common(left, right.toDF("a", "b"))
    kept = join_outer_keep_left(left, right.withColumnRenamed("v", "w"), "id")
    assert sorted(rows(kept), key=str) == [*want, (None, None, "sluice"), (None, None, "weir")]


def test_getitem_of_other_types_raises(sides):
    with pytest.raises(Exception):
        sides[0][1.5]


def test_safe_access(spark):
    frame = spark.createDataFrame([(["a", "b", "c"], {"x": 1.0}, "x", '{"a":{"b":[5]}}'), (None, None, None, "{bad")], "a array<string>, m map<string,double>, k string, j string")
    got = frame.select(
        *(element_or_null("a", i) for i in (1, 3, -1, 4, 0)), value_or_null("m", "x"), value_or_null("m", "q"), value_or_null("m", F.col("k")), json_path("j", "$.a.b[0]")
    )
    assert rows(got) == [("a", "c", "c", None, None, 1.0, None, 1.0, "5"), (None,) * 9]
    with pytest.raises(ValueError):
        json_path("j", "a.b")


def test_lenient_times(spark):
    frame = spark.createDataFrame([("2024-01-02 03:04:05", "2024-01-02"), ("bad", "2024-1-2"), (None, None)], "t string, d string")
    got = rows(frame.select(try_parse_timestamp("t"), try_parse_date("d")))
    assert [str(x) for x in got[0]] == ["2024-01-02 03:04:05", "2024-01-02"]
    assert got[1:] == [(None, None), (None, None)]


def test_maps_as_structs(spark):
    frame = spark.createDataFrame([(2, {"b": 2, "a": 1}), (1, {"c": 3}), (3, None)], "id int, m map<string,int>")
    keys = map_keys_in_order(frame, "m", "id")
    assert keys[0] == "c" and sorted(keys) == ["a", "b", "c"]
    assert rows(map_to_struct(frame, "m", ["a", "c"]).select("id", "m.*")) == [(2, 1, None), (1, None, 3), (3, None, None)]
    with pytest.raises(TypeError):
        map_keys_in_order(frame, "id", "id")
    with pytest.raises(ValueError):
        map_to_struct(frame, "m")
    with pytest.raises(ValueError, match="distinct keys"):
        map_keys_in_order(frame, "m", "id", most=2)


def test_schema_objects(spark):
    fields = [T.StructField("berth", T.IntegerType(), False, {"note": "dock"}), T.StructField("cargo", T.ArrayType(T.StringType()))]
    schema = T.StructType(fields)
    assert schema.fieldNames() == ["berth", "cargo"] and len(schema) == 2 and list(schema) == fields
    assert schema[0] == schema["berth"] == fields[0] and schema[1:] == T.StructType(fields[1:])
    assert schema["berth"].metadata == {"note": "dock"} and not schema[0].nullable
    assert spark.createDataFrame([(1, ["a"])], schema).schema["berth"].metadata == {"note": "dock"}
    with pytest.raises(KeyError):
        schema["mast"]
    with pytest.raises(IndexError):
        schema[2]


@pytest.mark.parametrize("name", ["string", "int", "bigint", "float", "double", "boolean", "date", "timestamp_ntz", "decimal(10,2)", "tinyint", "smallint", "binary"])
def test_type_names_cast(spark, name):
    made = spark.sql("SELECT '1' AS v").select(F.col("v").try_cast(name).alias("v"))
    assert made.dtypes == [("v", name)] and made.count() == 1


def test_ranks_place_nulls(spark):
    frame = spark.createDataFrame([("g", None), ("g", 1), ("g", 1), ("g", 2)], "g string, v int")
    assert sorted(r.rank for r in rank_within(frame, ["g"], [F.asc("v")]).collect()) == [1, 2, 2, 4]
    assert sorted(r.rank for r in rank_within(frame, ["g"], [F.desc("v")], method="dense_rank").collect()) == [1, 2, 2, 3]


def test_export(spark, capsys):
    frame = spark.createDataFrame([(1.0, {"a": 1, "b": None}, [1.5, 2.0])], "f double, m map<string,int>, a array<double>")
    assert list(to_records(frame)) == [{"f": 1, "m": {"a": 1}, "a": [1.5, 2]}]
    assert plain(math.nan) is None
    frame.show(1, truncate=True, vertical=True)
    assert "RECORD 0" in capsys.readouterr().out
