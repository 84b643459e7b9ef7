"""Query/retrieve queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import find as Q
from halyard.registry import query

from .common import shared_folder, table


@query(
    "find_match_project",
    "SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND o_orderpriority IN ('1-URGENT', '3-MEDIUM')",
)
def find_match_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.find(table(spark, sf_dir, "orders"), [Q.Key("o_orderkey"), Q.Key("o_orderdate", ("19950101-19960630",)), Q.Key("o_orderpriority", ("1-URGENT", "3-MEDIUM"))])


@query("find_wildcard", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#%7_'")
def find_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.find(table(spark, sf_dir, "customer"), [Q.Key("c_custkey"), Q.Key("c_name", ("Customer#*7?",))])


@query("find_empty_keys", "SELECT s_suppkey, s_name FROM supplier")
def find_empty_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.find(table(spark, sf_dir, "supplier"), Q.merge_keys({"s_suppkey": [], "s_nationkey": []}, {"s_name": []}, allowed=["s_suppkey"]))


@query("find_limit", "SELECT count(*) AS n FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'F' LIMIT 25)")
def find_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query stopped after 25 matches: the limit is the feature."""
    return Q.find(table(spark, sf_dir, "orders"), [Q.Key("o_orderkey"), Q.Key("o_orderstatus", ("F",))], limit=25).agg(F.count(F.lit(1)).alias("n"))


@query("find_worklist_nested", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def find_worklist_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys inside a sequence: some item has the one value and some item the other."""
    keys = [Q.parse_path("l_returnflag=R"), Q.parse_path("l_linestatus=O")]
    return Q.with_children(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", keys).select("o_orderkey")


@query("find_nested_path", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R' AND l_linenumber < 3)")
def find_nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key two sequences deep in one column."""
    inner = F.array(F.struct(F.when(F.col("l_linenumber") < 3, F.col("l_returnflag")).alias("flag")))
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(inner.alias("marks"))).alias("steps"))
    return Q.find(steps, [Q.Key("l_orderkey"), Q.parse_path("steps/marks/flag=R")]).select("l_orderkey")


@query("find_tag_path", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def find_tag_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient-root query: a key of the patient level, columns of two levels."""
    df = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return Q.find(df, [Q.Key("o_orderkey"), Q.Key("c_name"), Q.parse_path("c_mktsegment=BUILDING\\MACHINERY")]).select("o_orderkey", "c_name")


@query("edit_override", "SELECT o_orderkey, 'ANON' AS o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def edit_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of editors: drop rows, then overwrite an attribute."""
    df = Q.edit(table(spark, sf_dir, "orders"), lambda d: d.where("o_orderstatus <> 'P'"), lambda d: Q.override(d, {"o_orderpriority": "ANON"}))
    return df.select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("edit_uid_suffix", "SELECT '1.2.' || o_orderkey || '.9' AS study_uid, '1.2.' || o_custkey AS patient FROM orders")
def edit_uid_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.concat(F.lit("1.2."), F.col("o_orderkey")).alias("study_uid"), F.concat(F.lit("1.2."), F.col("o_custkey")).alias("patient"))
    return Q.suffix_uids(df, ["study_uid"], ".9")


@query("ref_applicability", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem SEMI JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE [1, 2, 5] END AS frames FROM orders WHERE o_orderstatus = 'O') r ON l_orderkey = o_orderkey AND (len(frames) = 0 OR list_contains(frames, l_linenumber))")
def ref_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference applies to an instance's frame if it names the instance and no frames, or the frame."""
    frames = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(2), F.lit(5)))
    refs = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", frames.alias("frames"))
    return Q.applicable(table(spark, sf_dir, "lineitem"), refs, F.col("l_orderkey") == F.col("o_orderkey"), "frames", F.col("l_linenumber")).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "find_key_tree",
    """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '%M%' AND CAST(o_orderdate AS DATE) >= DATE '1993-01-01'
       AND o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('R', 'A') AND p_brand LIKE '%2%' AND p_size IN (7, 9, 11, 13))""",
)
def find_key_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of keys, a file's and the caller's put together, over a table and two levels of tables below it."""
    part = Q.Child(table(spark, sf_dir, "part"), "p_partkey", "l_partkey")
    items = Q.Child(table(spark, sf_dir, "lineitem"), "l_orderkey", "o_orderkey", {"Part": part})
    of_file = {"o_orderkey": [], "o_totalprice": ["1"], "o_orderpriority": ["*X*"], "Items": {"l_returnflag": ["N"], "Part": {"p_brand": ["*2*"]}}}
    own = {"o_orderpriority": ["*M*"], "o_orderdate": ["19930101-"], "Items": {"l_returnflag": ["R", "A"], "Part": {"p_size": ["7", "9", "11", "13"]}}}
    tree = Q.merge_trees(of_file, own, ["o_orderkey", "o_orderpriority", "Items"], deep=True)
    return Q.where_tree(table(spark, sf_dir, "orders"), tree, {"Items": items}).select("o_orderkey", "o_orderpriority")


@query(
    "find_study_root_series",
    "SELECT l_orderkey, l_linenumber, l_returnflag, o_orderpriority, c_mktsegment FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R' AND o_orderpriority = '1-URGENT' AND c_mktsegment LIKE 'B%'",
)
def find_study_root_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of the study root, by keys of series, studies and patients."""
    levels = {"PATIENT": Q.Level(table(spark, sf_dir, "customer")), "STUDY": Q.Level(table(spark, sf_dir, "orders"), ("o_custkey", "c_custkey")), "SERIES": Q.Level(table(spark, sf_dir, "lineitem"), ("l_orderkey", "o_orderkey"))}
    return Q.find_level("StudyRoot", levels, {"l_orderkey": [], "l_linenumber": [], "l_returnflag": ["R"], "o_orderpriority": ["1-URGENT"], "c_mktsegment": ["B*"]}, "SERIES")


@query("find_patient_root_studies", "SELECT o_orderkey, o_orderstatus, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_name LIKE '%7'")
def find_patient_root_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies of the patient root by a key of patients; the level of a query without one."""
    levels = {"PATIENT": Q.Level(table(spark, sf_dir, "customer")), "STUDY": Q.Level(table(spark, sf_dir, "orders"), ("o_custkey", "c_custkey"))}
    return Q.find_level("PatientRoot", levels, {"o_orderkey": [], "o_orderstatus": [], "c_name": ["*7"]})


@query("find_responses", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '5-LOW'")
def find_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses written as JSON files and read again."""
    place = shared_folder(spark, "responses")
    Q.write_results(Q.find(table(spark, sf_dir, "orders"), [Q.Key("o_orderkey"), Q.Key("o_orderpriority", ("5-LOW",))]), f"{place}/json")
    return spark.read.schema("o_orderkey string, o_orderpriority string").json(f"{place}/json")
