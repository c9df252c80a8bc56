"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import element_or_null, json_path, typed_null, value_or_null
from millrace.functions.temporal import parse_timestamp, try_parse_date, try_parse_timestamp
from millrace.registry import query
from millrace.sources.tables import load


@query(
    "lit_values",
    "SELECT n_nationkey, -7 AS i, 0.125::DOUBLE AS f, 'weir ' AS s, false AS b, NULL::VARCHAR AS n FROM nation",
    covers="F02",
)
def lit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"i": F.lit(-7), "f": F.lit(0.125), "s": F.lit("weir "), "b": F.lit(False), "n": typed_null("string")}
    return load(spark, sf_dir, "nation").select("n_nationkey", *(v.alias(k) for k, v in values.items()))


@query(
    "when_chain",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    covers="F03",
)
def when_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.when(price > 200000, "high").when(price > 100000, "mid").otherwise("low").alias("band"))


@query(
    "coalesce_cols",
    "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN user_id END, CASE WHEN event_id % 5 = 0 THEN event_id END) AS v FROM events",
    covers="F04",
)
def coalesce_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("event_id") % 3 == 0, F.col("user_id"))
    second = F.when(F.col("event_id") % 5 == 0, F.col("event_id"))
    return load(spark, sf_dir, "events").select("event_id", F.coalesce(first, second).alias("v"))


@query(
    "regexp_replace",
    "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '<n>', 'g') AS digits, regexp_replace(p_name, '^(\\w+) ', '\\1-', 'g') AS joined FROM part",
    covers="F05",
)
def regexp_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.regexp_replace("p_brand", r"[0-9]+", "<n>")
    return load(spark, sf_dir, "part").select("p_partkey", digits.alias("digits"), F.regexp_replace("p_name", r"^(\w+) ", "$1-").alias("joined"))


@query("length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents", covers="F06")
def length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("lower", "SELECT p_partkey, lower(p_brand) AS brand, lower(p_type) AS kind FROM part", covers="F07")
def lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("brand"), F.lower("p_type").alias("kind"))


@query(
    "concat",
    "SELECT o_orderkey, o_orderstatus || '-' || CAST(o_custkey AS VARCHAR) AS tag, "
    "o_orderstatus || CASE WHEN o_custkey % 2 = 0 THEN 'x' END AS holed FROM orders",
    covers="F08",
)
def concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat("o_orderstatus", F.lit("-"), "o_custkey").alias("tag"),
        F.concat("o_orderstatus", F.when(F.col("o_custkey") % 2 == 0, "x")).alias("holed"),
    )


@query(
    "to_timestamp",
    "SELECT o_orderkey, strptime(strftime(o_orderdate, '%d/%m/%Y %H:%M:%S'), '%d/%m/%Y %H:%M:%S') AS ts FROM orders",
    covers="F09 F12",
)
def to_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")
    return load(spark, sf_dir, "orders").select("o_orderkey", parse_timestamp(text, "dd/MM/yyyy HH:mm:ss").alias("ts"))


#: Datetime patterns and the same ones for strptime.
_PATTERNS = {
    "compact": ("yyyyMMddHHmmss", "%Y%m%d%H%M%S"),
    "slashes": ("MM/dd/yyyy HH:mm:ss", "%m/%d/%Y %H:%M:%S"),
    "dots": ("dd.MM.yyyy HH.mm.ss", "%d.%m.%Y %H.%M.%S"),
    "iso": ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    "halves": ("yyyy-MM-dd hh:mm:ss a", "%Y-%m-%d %I:%M:%S %p"),
    "minutes": ("HH:mm dd-MM-yy", "%H:%M %d-%m-%y"),
    "named": ("dd MMM yyyy HH:mm:ss", "%d %b %Y %H:%M:%S"),
}


@query(
    "to_timestamp_patterns",
    "SELECT event_id, " + ", ".join(f"strptime(strftime(ts, '{other}'), '{other}') AS {name}" for name, (_, other) in _PATTERNS.items()) + " FROM events",
    covers="F09 F12",
)
def to_timestamp_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {name: parse_timestamp(F.date_format("ts", pattern), pattern) for name, (pattern, _) in _PATTERNS.items()}
    return load(spark, sf_dir, "events").select("event_id", *(column.alias(name) for name, column in made.items()))


@query(
    "to_timestamp_fraction",
    "SELECT event_id, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S') || '.123', '%Y-%m-%d %H:%M:%S.%g') AS ms, "
    "strptime(strftime(ts, '%Y-%m-%d %H:%M:%S') || '.123456', '%Y-%m-%d %H:%M:%S.%f') AS us FROM events",
    covers="F09 F13",
)
def to_timestamp_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return load(spark, sf_dir, "events").select(
        "event_id",
        parse_timestamp(F.concat(text, F.lit(".123")), "yyyy-MM-dd HH:mm:ss.SSS").alias("ms"),
        parse_timestamp(F.concat(text, F.lit(".123456")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("us"),
    )


@query(
    "try_to_timestamp",
    "SELECT event_id, try_strptime(CASE WHEN event_id % 4 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END, '%Y-%m-%d %H:%M:%S') AS t FROM events",
    covers="F10",
)
def try_to_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 4 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return load(spark, sf_dir, "events").select("event_id", try_parse_timestamp(text).alias("t"))


@query(
    "try_to_date",
    "SELECT o_orderkey, CAST(try_strptime(CASE WHEN o_orderkey % 4 = 0 THEN '99-99-xx' ELSE strftime(o_orderdate, '%d-%m-%Y') END, '%d-%m-%Y') AS DATE) AS day FROM orders",
    covers="F11",
)
def try_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 4 == 0, "99-99-xx").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return load(spark, sf_dir, "orders").select("o_orderkey", try_parse_date(text, "dd-MM-yyyy").alias("day"))


@query("abs", "SELECT c_custkey, abs(c_acctbal) AS a, abs(5 - c_custkey) AS k FROM customer", covers="F14")
def absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", F.abs("c_acctbal").alias("a"), F.abs(5 - F.col("c_custkey")).alias("k"))


def _register_round(scale: int) -> None:
    @query(
        f"round_{scale}",
        f"SELECT c_custkey, CAST(round(CAST(c_acctbal AS DECIMAL(18,2)), {scale}) AS DOUBLE) AS r FROM customer",
        covers="F15",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return load(spark, sf_dir, "customer").select(
            "c_custkey", F.round(F.col("c_acctbal").cast("decimal(18,2)"), scale).cast("double").alias("r")
        )


for _scale in (0, 1, 2):
    _register_round(_scale)


@query(
    "struct_build",
    "SELECT o_orderkey, o_custkey AS o_custkey, o_orderstatus AS status, o_custkey + 1 AS col3 FROM orders",
    covers="F16",
)
def struct_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = F.struct("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey") + 1)
    return load(spark, sf_dir, "orders").select("o_orderkey", built.alias("s")).select("o_orderkey", "s.*")


@query("struct_nested", "SELECT o_orderkey, o_custkey AS id, o_orderstatus AS status FROM orders", covers="F16 R02")
def struct_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.struct(F.col("o_orderstatus").alias("status"))
    built = F.struct(F.col("o_custkey").alias("id"), inner.alias("about"))
    return load(spark, sf_dir, "orders").select("o_orderkey", built.alias("s")).select("o_orderkey", "s.id", "s.about.status")


_ELEMENTS = {"array": (1, "embedding[1]"), "negative": (-1, "embedding[64]"), "oob": (65, "NULL::FLOAT"), "zero": (0, "NULL::FLOAT")}


def _register_element(name: str) -> None:
    index, sql = _ELEMENTS[name]

    @query(f"try_element_at_{name}", f"SELECT vec_id, {sql} AS x FROM embeddings", covers="F17")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return load(spark, sf_dir, "embeddings").select("vec_id", element_or_null("embedding", index).alias("x"))


for _name in _ELEMENTS:
    _register_element(_name)


@query("try_element_at_map_key", "SELECT event_id, event_type AS a, NULL::VARCHAR AS z FROM events", covers="F18")
def element_map_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = load(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("a"), "event_type").alias("m"))
    return mapped.select("event_id", value_or_null("m", "a").alias("a"), value_or_null("m", "z").alias("z"))


@query(
    "try_element_at_map_dynamic",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN event_id END AS v FROM events",
    covers="F19",
)
def element_map_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = load(spark, sf_dir, "events").select(
        "event_id",
        F.create_map(F.lit("k0"), "user_id", F.lit("k1"), "event_id").alias("m"),
        F.concat(F.lit("k"), F.col("event_id") % 3).alias("k"),
    )
    return mapped.select("event_id", value_or_null("m", F.col("k")).alias("v"))


@query("get_json_object", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", covers="F20")
def get_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", json_path("props", "$.k").alias("k"))


@query(
    "get_json_nested",
    "SELECT event_id, CAST(user_id AS VARCHAR) AS who, event_type AS last, NULL::VARCHAR AS gone FROM events",
    covers="F20",
)
def get_json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"actor":{"seen":[0,0,'), "user_id", F.lit(']},"log":[{},{"step":"x"},{"step":"'), "event_type", F.lit('"}]}'))
    made = load(spark, sf_dir, "events").select("event_id", text.alias("j"))
    paths = {"who": "$.actor.seen[2]", "last": "$.log[2].step", "gone": "$.log[0].step"}
    return made.select("event_id", *(json_path("j", path).alias(name) for name, path in paths.items()))


@query("uuid_shape", "SELECT count(*) AS n, true AS all_v4, count(*) AS n_distinct FROM events", covers="F21")
def uuid_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "events").select(F.uuid().alias("u"))
    shape = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return ids.agg(F.count("u").alias("n"), F.bool_and(F.col("u").rlike(shape)).alias("all_v4"), F.count_distinct("u").alias("n_distinct"))
