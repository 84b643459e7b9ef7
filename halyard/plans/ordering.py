"""Sort queries. The position is a column, so that order shows in an unordered comparison; ties are broken by more columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions import dates as D
from halyard.operators import hanging, manifest
from halyard.registry import query

from .common import table

_LINE = "l_partkey, l_suppkey, l_linenumber, l_extendedprice"


def _ranked(df: DataFrame, within: str, *order) -> DataFrame:
    w = Window.partitionBy(within).orderBy(*order, *(F.col(c.strip()) for c in _LINE.split(",")))
    return df.withColumn("position", F.row_number().over(w).cast("long"))


def _sql(order: str, source: str = "lineitem") -> str:
    return f"SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}, {_LINE}) AS position FROM {source}"


_OUT = ["l_orderkey", "l_partkey", "l_extendedprice", "position"]


@query("hp_sort_attr_asc", _sql("l_quantity ASC NULLS LAST"))
def hp_sort_attr_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_quantity").asc_nulls_last()).select(*_OUT)


@query("hp_sort_attr_desc", _sql("CASE WHEN l_linenumber > 2 THEN l_shipdate END DESC NULLS LAST"))
def hp_sort_attr_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are missing come last in a falling order too."""
    return _ranked(table(spark, sf_dir, "lineitem"), "l_orderkey", F.when(F.col("l_linenumber") > 2, F.col("l_shipdate")).desc_nulls_last()).select(*_OUT)


@query("hp_sort_chain", _sql("l_returnflag ASC, l_discount DESC, l_quantity ASC"))
def hp_sort_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(table(spark, sf_dir, "lineitem"), "l_orderkey", F.asc("l_returnflag"), F.desc("l_discount"), F.asc("l_quantity")).select(*_OUT)


@query(
    "hp_sort_seq",
    """WITH f AS (SELECT l_orderkey, min(struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_extendedprice)) AS m FROM lineitem GROUP BY 1)
       SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY m.d ASC NULLS LAST, o_orderkey) AS position FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""",
)
def hp_sort_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By an attribute of the first item of a nested sequence."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("m"))
    o = table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    items = hanging.Dataset({}, {"lines": F.array("m")})
    key, _ = hanging.compile_sort({"sequence": "lines", "attribute": "l_extendedprice", "direction": "INCREASING"}, items)
    w = Window.partitionBy("o_custkey").orderBy(key.asc_nulls_last(), "o_orderkey")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("position"))


@query(
    "hp_sort_along_axis",
    """WITH k AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * (CAST(embedding[5] AS DOUBLE) * embedding[9] - CAST(embedding[6] AS DOUBLE) * embedding[8])
         + CAST(embedding[2] AS DOUBLE) * (CAST(embedding[6] AS DOUBLE) * embedding[7] - CAST(embedding[4] AS DOUBLE) * embedding[9])
         + CAST(embedding[3] AS DOUBLE) * (CAST(embedding[4] AS DOUBLE) * embedding[8] - CAST(embedding[5] AS DOUBLE) * embedding[7]) AS key FROM embeddings)
       SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY key, vec_id) AS position FROM k""",
)
def hp_sort_along_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the position along the normal of the image plane: position . (row x column)."""
    v = [F.element_at("embedding", k).cast("double") for k in range(1, 10)]
    key, _ = hanging.compile_sort({"category": "ALONG_AXIS", "columns": (F.array(*v[:3]), F.array(*v[3:6]), F.array(*v[6:9])), "direction": "INCREASING"}, {})
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", key.alias("key"))
    return e.select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy("key", "vec_id")).cast("long").alias("position"))


@query(
    "hp_sort_fct_group",
    """WITH k AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size WHEN p_size % 3 < 2 THEN CASE p_size % 3 WHEN 0 THEN p_size * 7 % 11 ELSE p_size * 5 % 13 END END AS key FROM part)
       SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY key DESC NULLS LAST, p_partkey) AS position FROM k""",
)
def hp_sort_fct_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By an attribute of the shared functional group, else of the frame's own; a frame beyond the last has none."""
    s = F.col("p_size")
    own = F.array(F.struct((s * 7 % 11).alias("z")), F.struct((s * 5 % 13).alias("z")))
    groups = hanging.Dataset({}, groups={"plane": (F.when(F.col("p_partkey") % 4 == 0, F.struct(s.alias("z"))), own)})
    key, _ = hanging.compile_sort({"functional_group": "plane", "attribute": "z", "direction": "DECREASING"}, groups, s % 3 + 1)
    w = Window.partitionBy("p_brand").orderBy(key.desc_nulls_last(), "p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("position"))


@query("hp_sort_acq_time", _sql("coalesce(CASE WHEN l_linenumber = 1 THEN l_shipdate END, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate - INTERVAL 1 DAY END, CASE WHEN l_linenumber < 7 THEN l_shipdate + INTERVAL 2 DAY END) NULLS LAST"))
def hp_sort_acq_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisition date and time, else acquisition date-time, else content date and time."""
    n, day, midnight = F.col("l_linenumber"), F.to_date("l_shipdate"), F.lit(0).cast("long")
    moment = F.when(n % 2 == 0, D.combine(F.date_sub(day, 1), midnight))
    columns = (F.when(n == 1, day), midnight, moment, F.when(n < 7, F.date_add(day, 2)), midnight)
    key, _ = hanging.compile_sort({"category": "BY_ACQ_TIME", "columns": columns, "direction": "INCREASING"}, {})
    return _ranked(table(spark, sf_dir, "lineitem"), "l_orderkey", key.asc_nulls_last()).select(*_OUT)


@query(
    "mf_sort_study",
    """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 10 > 0 THEN date_trunc('year', o_orderdate) END DESC NULLS LAST, o_orderstatus ASC, o_orderkey % 2 DESC, o_orderkey) AS position FROM orders""",
)
def mf_sort_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies by date, newest first and undated last, then by description as people sort it: letters first, small before large ones."""
    description = F.when(F.col("o_orderkey") % 2 == 1, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    dated = F.when(F.col("o_orderkey") % 10 > 0, F.date_trunc("year", "o_orderdate"))
    w = Window.partitionBy("o_custkey").orderBy(*manifest.study_order(dated, description), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("position"))


_NUMBER_SQL = "CASE WHEN l_suppkey % 4 = 0 THEN 'x' || l_suppkey ELSE CAST(l_suppkey % 97 AS VARCHAR) END"


@query(
    "mf_sort_series",
    f"WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey, {_NUMBER_SQL} AS number FROM lineitem) SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY TRY_CAST(number AS INT) ASC NULLS LAST, '1.2.' || l_suppkey) AS position FROM s",
)
def mf_sort_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series by number, text that is no number last, then by identifier."""
    number = F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("x"), F.col("l_suppkey"))).otherwise((F.col("l_suppkey") % 97).cast("string"))
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", number.alias("number")).distinct()
    w = Window.partitionBy("l_orderkey").orderBy(F.col("number").try_cast("int").asc_nulls_last(), F.concat(F.lit("1.2."), F.col("l_suppkey")))
    return s.select("l_orderkey", "l_suppkey", F.row_number().over(w).cast("long").alias("position"))


@query(
    "mf_sort_instance",
    """WITH i AS (SELECT DISTINCT l_orderkey, l_partkey, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS number FROM lineitem)
       SELECT l_orderkey, l_partkey, number, row_number() OVER (PARTITION BY l_orderkey ORDER BY number ASC NULLS LAST, lpad(CAST(l_partkey AS VARCHAR), 64, '0')) AS position FROM i""",
)
def mf_sort_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances by number, then by identifier with its last part as a number: 5.1 before 5.10."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("number")).distinct()
    uid = F.concat_ws(".", F.lit("1.2"), F.col("l_orderkey"), F.col("l_partkey"))
    w = Window.partitionBy("l_orderkey").orderBy(*manifest.instance_order(F.col("number"), uid))
    return i.select("l_orderkey", "l_partkey", "number", F.row_number().over(w).cast("long").alias("position"))
