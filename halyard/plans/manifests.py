"""Manifest queries: customers as patients, orders as studies, lines as series and instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import text
from halyard.operators import manifest as M
from halyard.registry import query

from .common import partitions, table


@query(
    "mf_dedupe_last",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1""",
)
def mf_dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert: of the lines of one key the last shipped stays."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return M.last_by_struct(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])


@query(
    "mf_tree_counts",
    """SELECT c_custkey, count(DISTINCT o_orderkey) AS studies, count(DISTINCT l_orderkey * 1000000 + l_suppkey) AS series, count(l_orderkey) AS instances
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def mf_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies, series and instances of each patient; counted level by level, so that no distinct runs over joined rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    lines = lines.repartition(partitions(lines), "l_orderkey")  # one shuffle for both levels and the join
    series = lines.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    studies = series.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("series"), F.sum("n").alias("n"))
    orders = table(spark, sf_dir, "orders").join(studies, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("studies"), F.sum("series").alias("series"), F.sum("n").alias("instances"))
    c = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("studies", "series", "instances")))


@query("mf_remove_study", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def mf_remove_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.remove(table(spark, sf_dir, "orders"), doomed, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("mf_retain_accession", "SELECT o_orderkey, o_orderstatus FROM orders WHERE CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END IN ('1-URGENT', '2-HIGH', '5-LOW')")
def mf_retain_accession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed accession numbers stay, those without one go."""
    studies = table(spark, sf_dir, "orders").withColumn("accession", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")))
    numbers = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("5-LOW",)], "accession string")
    return M.retain_accession_numbers(studies, numbers, "accession").select("o_orderkey", "o_orderstatus")


@query(
    "mf_remove_series_prune",
    """WITH kept AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey % 3 <> 0), s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM kept))
       SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM s)""",
)
def mf_remove_series_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series removed, then studies without series, then patients without studies."""
    series = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 <> 0").select(F.col("l_orderkey").alias("o_orderkey"))
    studies = M.prune(table(spark, sf_dir, "orders"), series, ["o_orderkey"]).select(F.col("o_custkey").alias("c_custkey"))
    return M.prune(table(spark, sf_dir, "customer"), studies, ["c_custkey"]).select("c_custkey", "c_name")


@query(
    "mf_remove_patient_first",
    """WITH f AS (SELECT c_nationkey, min(c_custkey) AS gone FROM customer WHERE c_nationkey IN (3, 7, 11) GROUP BY 1)
       SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT gone FROM f)""",
)
def mf_remove_patient_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal by an identifier without issuer takes one matching patient only: the smallest key."""
    c = table(spark, sf_dir, "customer")
    first = c.where(F.col("c_nationkey").isin(3, 7, 11)).groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    return M.remove(c, first.select("c_custkey"), ["c_custkey"]).select("c_custkey", "c_nationkey")


@query(
    "mf_nested",
    """WITH i AS (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey FROM lineitem), s AS (SELECT l_orderkey, l_suppkey, l_suppkey || '[' || string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) || ']' AS t FROM i GROUP BY l_orderkey, l_suppkey)
       SELECT l_orderkey, string_agg(t, ';' ORDER BY l_suppkey) AS tree FROM s GROUP BY 1""",
)
def mf_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances in series in studies as nested arrays, shown as text."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").repartition("l_orderkey").distinct()
    tree = M.nested(i, [("studies", ["l_orderkey"]), ("series", ["l_suppkey"])], ["l_partkey"])
    shown = F.transform("series", lambda s: F.concat(s["l_suppkey"].cast("string"), F.lit("["), F.array_join(F.transform(s["instances"], lambda i: i["l_partkey"].cast("string")), ","), F.lit("]")))
    return tree.select("l_orderkey", F.array_join(shown, ";").alias("tree"))


@query(
    "mf_json",
    """SELECT c_custkey, '{"id":"' || c_custkey || '","name":"' || c_name || '"' || CASE WHEN c_nationkey % 4 = 0 THEN '' ELSE ',"sex":"' || CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'O' END || '"' END || '}' AS document FROM customer""",
)
def mf_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients as JSON, blank attributes left out."""
    sex = text.patient_sex(F.when(F.col("c_nationkey") % 4 == 0, None).when(F.col("c_nationkey") % 2 == 0, "male").otherwise("x"))
    doc = M.json_document(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), text.blank_to_null(sex).alias("sex"))
    return table(spark, sf_dir, "customer").select("c_custkey", doc.alias("document"))


@query(
    "mf_xml",
    """WITH s AS (SELECT o_custkey, string_agg('<Study StudyInstanceUID="1.2.' || o_orderkey || '" StudyDescription="' || replace(o_orderpriority, '-', '&amp;') || '"/>', '' ORDER BY o_orderkey) AS t FROM orders GROUP BY 1)
       SELECT c_custkey, '<Patient PatientID="' || c_custkey || '" PatientName="' || c_name || '"' || CASE WHEN t IS NULL THEN '/>' ELSE '>' || t || '</Patient>' END AS document FROM customer LEFT JOIN s ON o_custkey = c_custkey""",
)
def mf_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients with their studies as XML: attributes only, escaped, blank ones left out."""
    study = M.xml_element("Study", {"StudyInstanceUID": F.concat(F.lit("1.2."), F.col("o_orderkey")), "StudyID": F.lit(" "), "StudyDescription": F.replace("o_orderpriority", F.lit("-"), F.lit("&"))})
    studies = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", study.alias("x")).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "x"))).alias("xs"))
    c = table(spark, sf_dir, "customer").join(studies, F.col("c_custkey") == F.col("o_custkey"), "left")
    inner = F.coalesce(F.array_join(F.transform("xs", lambda x: x["x"]), ""), F.lit(""))
    return c.select("c_custkey", M.xml_element("Patient", {"PatientID": F.col("c_custkey").cast("string"), "PatientName": F.col("c_name")}, inner).alias("document"))


@query("mf_empty_rollup", "SELECT c_custkey, count(o_orderkey) = 0 OR bool_and(NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS is_empty FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def mf_empty_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patient is empty if all studies are, a study if it has no series."""
    filled = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("filled", F.lit(True))
    o = table(spark, sf_dir, "orders").join(filled, "o_orderkey", "left")
    return M.empty_rollup(table(spark, sf_dir, "customer"), "c_custkey", o, "o_custkey", F.col("filled").isNull())


@query(
    "mf_json_levels",
    """WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), t AS (SELECT l_orderkey, string_agg('{"number":' || l_suppkey || '}', ',' ORDER BY l_suppkey) AS s FROM s GROUP BY 1),
       o AS (SELECT o_custkey, string_agg('{"uid":"1.2.' || o_orderkey || '"' || CASE WHEN o_orderkey % 3 > 0 THEN ',"description":"' || o_orderpriority || '"' ELSE '' END || CASE WHEN s IS NOT NULL THEN ',"series":[' || s || ']' ELSE '' END || '}', ',' ORDER BY o_orderkey) AS t FROM orders LEFT JOIN t ON l_orderkey = o_orderkey GROUP BY 1)
       SELECT c_custkey, '{"id":"' || c_custkey || '"' || CASE WHEN t IS NOT NULL THEN ',"studies":[' || t || ']' ELSE '' END || '}' AS document FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
)
def mf_json_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients with arrays of studies with arrays of series as JSON; blank attributes and empty levels are left out."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct()
    series = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_suppkey")).alias("numbers"))
    orders = table(spark, sf_dir, "orders").join(series, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    description = text.blank_to_null(F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")))
    study = F.struct(F.concat(F.lit("1.2."), F.col("o_orderkey")).alias("uid"), description.alias("description"), M.items(F.transform("numbers", lambda n: F.struct(n.alias("number")))).alias("series"))
    studies = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", study.alias("s")))).alias("studies"))
    c = table(spark, sf_dir, "customer").join(studies, F.col("c_custkey") == F.col("o_custkey"), "left")
    document = M.json_document(F.col("c_custkey").cast("string").alias("id"), M.items(F.transform("studies", lambda x: x["s"])).alias("studies"))
    return c.select("c_custkey", document.alias("document"))


@query(
    "mf_archives",
    """WITH p AS (SELECT c_nationkey, string_agg('{"name":"' || c_name || '"}', ',' ORDER BY c_name) AS p FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1)
       SELECT n_nationkey, '{"archive":"' || n_name || '"' || CASE WHEN n_nationkey % 4 = 0 THEN ',"queryMode":"DICOM_WEB"' ELSE '' END || CASE WHEN n_nationkey % 5 = 0 THEN ',"tags":[{"key":"k","value":"v"}]' ELSE '' END
         || CASE WHEN n_nationkey % 3 = 0 THEN ',"messages":[{"title":"t","level":"WARN"}]' ELSE '' END || CASE WHEN p IS NOT NULL THEN ',"patients":[' || p || ']' ELSE '' END || '}' AS document
       FROM nation LEFT JOIN p ON c_nationkey = n_nationkey WHERE p IS NOT NULL OR n_nationkey % 3 = 0""",
)
def mf_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives with patients or messages: tags, then messages, then patients by name; the query mode only where it isn't the default."""
    patients = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("c_name").alias("name")))).alias("patients"))
    n = F.col("n_nationkey")
    item = lambda cond, **fields: F.when(cond, F.array(F.struct(*(F.lit(v).alias(k) for k, v in fields.items()))))
    a = table(spark, sf_dir, "nation").join(patients, n == F.col("c_nationkey"), "left")
    a = a.withColumn("tags", item(n % 5 == 0, key="k", value="v")).withColumn("messages", item(n % 3 == 0, title="t", level="WARN"))
    mode = M.query_mode_attribute(F.when(n % 4 == 0, "DICOM_WEB").otherwise("DICOM"))
    document = M.json_document(F.col("n_name").alias("archive"), mode.alias("queryMode"), *(M.items(F.col(c)).alias(c) for c in ("tags", "messages", "patients")))
    return M.with_content(a, "patients", "messages").select("n_nationkey", document.alias("document"))
