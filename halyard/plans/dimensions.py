"""Dictionary and geometry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import geometry as G
from halyard.operators import dictionaries as R
from halyard.registry import query

from .common import table


@query(
    "dict_body_part",
    "SELECT p_partkey, coalesce(n_name, 'OTHER') AS region FROM part LEFT JOIN nation ON n_nationkey = p_size",
)
def dict_body_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code looked up in a dictionary, with a fallback for codes it doesn't have."""
    first = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))
    codes = table(spark, sf_dir, "part").withColumn("code", F.col("p_size").cast("string"))
    return R.look_up(codes, "code", [first], fallback="OTHER").select("p_partkey", F.col("label").alias("region"))


@query(
    "dict_fallback",
    "SELECT p_partkey, coalesce(n_name, r_name, 'OTHER') AS region FROM part LEFT JOIN nation ON n_nationkey = p_size AND n_nationkey % 2 = 0 LEFT JOIN region ON r_regionkey = p_size % 7",
)
def dict_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dictionaries in order of priority, then a fallback."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("b"), F.col("r_name").alias("y"))
    p = table(spark, sf_dir, "part").join(nation, F.col("p_size") == F.col("a"), "left").join(region, F.col("p_size") % 7 == F.col("b"), "left")
    return p.select("p_partkey", F.coalesce("x", "y", F.lit("OTHER")).alias("region"))


@query("dict_legacy", "SELECT o_orderkey, n_name AS region FROM orders JOIN nation ON n_nationkey = o_custkey % 25")
def dict_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy text, trimmed, to a dictionary entry."""
    names = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("legacy"))
    o = table(spark, sf_dir, "orders").join(names, F.col("o_custkey") % 25 == F.col("n_nationkey"))
    o = o.select("o_orderkey", F.concat(F.lit("  "), F.col("legacy"), F.lit(" ")).alias("text"))
    d = table(spark, sf_dir, "nation").select(F.col("n_name").alias("code"), F.col("n_name").alias("label"))
    return R.look_up(o.withColumn("code", F.trim("text")), "code", [d]).select("o_orderkey", F.col("label").alias("region"))


@query(
    "dict_modifiers",
    "SELECT l_orderkey, string_agg(DISTINCT r_name, ',' ORDER BY r_name) AS modifiers FROM lineitem JOIN region ON r_regionkey = l_linenumber GROUP BY 1",
)
def dict_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modifier codes to modifiers, unknown ones dropped, as a set."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("l_linenumber"), "r_name")
    got = table(spark, sf_dir, "lineitem").join(r, "l_linenumber").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("r_name")).alias("m"))
    return got.select("l_orderkey", F.array_join("m", ",").alias("modifiers"))


@query("dict_category_union", "SELECT n_nationkey AS code, n_name AS label FROM nation UNION ALL SELECT p_size, min(p_type) FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1")
def dict_category_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard entries and extensions; an extension can't override a standard entry."""
    standard = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    extra = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("code")).agg(F.min("p_type").alias("label"))
    return R.with_priority([standard, extra], "code")


@query("dict_scheme", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'DCM' WHEN 1 THEN 'SCT' WHEN 2 THEN 'FMA' END AS designator FROM part")
def dict_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding schemes by designator or identifier."""
    key = F.element_at(F.array(F.lit("DCM"), F.lit("2.16.840.1.113883.6.96"), F.lit("FMA"), F.lit("nope")), F.col("p_size") % 4 + 1)
    return R.scheme_of(table(spark, sf_dir, "part").withColumn("scheme", key), "scheme").select("p_partkey", "designator")


def _v(k: int, sql: bool = False):
    return f"CAST(embedding[{k}] AS DOUBLE)" if sql else F.element_at("embedding", k).cast("double")


def _vectors():
    """The first three values and the next three as vectors."""
    return F.array(*(_v(k) for k in (1, 2, 3))), F.array(*(_v(k) for k in (4, 5, 6)))


_a, _b = [_v(k, True) for k in (1, 2, 3)], [_v(k, True) for k in (4, 5, 6)]
_LEN = f"sqrt({_a[0]}*{_a[0]} + {_a[1]}*{_a[1]} + {_a[2]}*{_a[2]})"


@query(
    "vec_ops",
    f"SELECT vec_id, round({_a[0]} + {_b[0]}, 9) AS sx, round({_a[1]} - {_b[1]}, 9) AS dy, round({_a[2]} * 2.5, 9) AS mz, round({_a[0]}*{_b[0]} + {_a[1]}*{_b[1]} + {_a[2]}*{_b[2]}, 9) AS dot, round({_a[1]}*{_b[2]} - {_a[2]}*{_b[1]}, 9) AS cx, round({_LEN}, 9) AS length FROM embeddings",
)
def vec_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _vectors()
    r = lambda c, n: F.round(c, 9).alias(n)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", r(G.x(G.add(a, b), 0), "sx"), r(G.x(G.subtract(a, b), 1), "dy"), r(G.x(G.scale(a, 2.5), 2), "mz"), r(G.dot(a, b), "dot"), r(G.x(G.cross(a, b), 0), "cx"), r(G.magnitude(a), "length")
    )


@query("vec_normalize", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round(" + f"{_a[0]} / {_LEN}" + ", 9) END AS x, vec_id % 3 > 0 AS unit FROM embeddings")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of no length stays the zero vector."""
    a, b = _vectors()
    v = F.transform(a, lambda c: F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(c))
    e = table(spark, sf_dir, "embeddings").select("vec_id", G.normalize(v).alias("u"))
    return e.select("vec_id", F.round(G.x(F.col("u"), 0), 9).alias("x"), (F.abs(G.magnitude(F.col("u")) - 1) < 1e-9).alias("unit"))


def _dominant_sql(v: list[str]) -> str:
    p = [f"abs({c} * 8)" for c in v]
    return f"CASE WHEN {p[0]} > 0.8 AND {p[0]} > {p[1]} AND {p[0]} > {p[2]} THEN 0 WHEN {p[1]} > 0.8 AND {p[1]} > {p[0]} AND {p[1]} > {p[2]} THEN 1 WHEN {p[2]} > 0.8 AND {p[2]} > {p[0]} AND {p[2]} > {p[1]} THEN 2 END"


@query(
    "plane_class",
    f"""WITH d AS (SELECT vec_id, {_dominant_sql(_a)} AS r, {_dominant_sql(_b)} AS c FROM embeddings)
        SELECT vec_id, CASE WHEN least(r, c) = 0 AND greatest(r, c) = 1 AND r IS NOT NULL AND c IS NOT NULL THEN 'TRANSVERSE' WHEN least(r, c) = 0 AND greatest(r, c) = 2 AND r IS NOT NULL AND c IS NOT NULL THEN 'CORONAL'
          WHEN least(r, c) = 1 AND greatest(r, c) = 2 AND r IS NOT NULL AND c IS NOT NULL THEN 'SAGITTAL' ELSE 'OBLIQUE' END AS plane FROM d""",
)
def plane_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _vectors()
    return table(spark, sf_dir, "embeddings").select("vec_id", G.plane(G.scale(a, 8.0), G.scale(b, 8.0)).alias("plane"))


@query("axis_letters", f"SELECT vec_id, CASE WHEN {_a[0]} < 0 THEN 'R' ELSE 'L' END AS x, CASE WHEN {_a[1]} < 0 THEN 'P' ELSE 'A' END AS y, CASE WHEN {_a[2]} < 0 THEN 'CD' ELSE 'CR' END AS z FROM embeddings")
def axis_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of a vector's parts; the second one turned to its opposite."""
    a, b = _vectors()
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", G.axis_letter(a, 0).alias("x"), G.opposite(F.lower(G.axis_letter(a, 1))).alias("y"), G.axis_letter(a, 2, quadruped=True).alias("z"))
