"""Parsing and streaming queries: multipart bodies, header fields, image headers, and a stream run to its end."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import binary
from halyard.registry import query
from halyard.sources import multipart as MP
from halyard.sources import tables
from halyard.streaming import ingest, progress

from .common import shared_folder, table


@query("multipart_parts", "SELECT page_id, part, CASE part WHEN 0 THEN 'text/html' ELSE 'text/uri-list' END AS kind, CASE part WHEN 0 THEN strlen(html) ELSE strlen(url) END AS n_bytes FROM pages, (VALUES (0), (1)) p(part)")
def multipart_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of two parts put together and taken apart again."""
    p = table(spark, sf_dir, "pages")
    body = F.concat(*(MP.assemble(F.lit(k), F.col(c).cast("binary"), "b1") for k, c in (("text/html", "html"), ("text/uri-list", "url"))), F.lit("\r\n--b1--\r\n").cast("binary"))
    mark = MP.boundary(F.lit('multipart/related; type="text/html"; boundary="b1"'))
    got = MP.parts(p.select("page_id", body.alias("body"), mark.alias("mark")), "page_id", "body", "mark")
    return got.select("page_id", "part", F.element_at("headers", "content-type").alias("kind"), F.length("content").cast("long").alias("n_bytes"))


@query("header_fields", "SELECT c_custkey, c_name AS name, c_mktsegment || ',' || c_custkey AS repeated, c_name || ';x' AS parameter, true AS flag FROM customer")
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header blocks with folded and repeated fields, and a field's parameters."""
    block = F.concat(F.lit("X-Name:  "), F.col("c_name"), F.lit("\r\nX-Seg: "), F.col("c_mktsegment"), F.lit("\r\nx-seg:\r\n "), F.col("c_custkey"))
    field = F.concat(F.lit('form; Name="'), F.col("c_name"), F.lit(';x"; inline'))
    h, p = MP.header_map(block), MP.field_parameters(field)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.element_at(h, "x-name").alias("name"), F.element_at(h, "x-seg").alias("repeated"), F.element_at(p, "name").alias("parameter"), (F.array_contains(F.map_keys(p), "inline") & F.element_at(p, "inline").isNull()).alias("flag")
    )


@query("jpeg_headers", "SELECT p_partkey, p_size AS n_rows, p_size * 2 AS n_columns, 8 AS bits, p_partkey % 2 = 0 AS lossless FROM part")
def jpeg_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image headers read out of bytes."""
    sof = F.when(F.col("p_partkey") % 2 == 0, "C3").otherwise("C0")
    size = F.lpad(F.hex(F.col("p_size")), 4, "0"), F.lpad(F.hex(F.col("p_size") * 2), 4, "0")
    data = F.unhex(F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FF"), sof, F.lit("000B08"), *size, F.lit("01011100FFDA")))
    got = table(spark, sf_dir, "part").select("p_partkey", binary.jpeg_header(data).alias("h"))
    return got.select("p_partkey", "h.n_rows", "h.n_columns", "h.bits", "h.lossless")


@query("stream_forward", "SELECT user_id, 'fwd-' || event_type AS event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL")
def stream_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, refused rows set aside, the rest edited and stored once, then counted."""
    like = table(spark, sf_dir, "events")
    place = shared_folder(spark, "stream")
    stream = ingest.arrivals(spark, sf_dir, like, "events.parquet")
    run = ingest.forward(stream, [lambda d: d.withColumn("event_type", F.concat(F.lit("fwd-"), F.col("event_type")))], progress.status(F.col("event_type")) == progress.FAILED, f"{place}/sink", f"{place}/aside", f"{place}/state")
    run.awaitTermination()
    return spark.read.schema(like.schema).option("recursiveFileLookup", True).parquet(f"{place}/sink").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "report_rows",
    """WITH r AS (SELECT p_brand AS file, CAST(p_size % 5 AS VARCHAR) AS dst_ts, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS mpps, CASE WHEN p_partkey % 7 = 0 THEN 'infinite' WHEN p_partkey % 7 > 1 THEN 'finite' END AS psnr, row_number() OVER (PARTITION BY p_brand, p_size % 5 ORDER BY p_partkey DESC) AS back FROM part)
       SELECT file, dst_ts, mpps, psnr FROM r WHERE back = 1""",
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark reports written as files and read: the last row of a file and target, blank and malformed numbers as null, infinities."""
    place = shared_folder(spark, "reports")
    k = F.col("p_partkey")
    given = {"file": F.col("p_brand"), "dst_ts": (F.col("p_size") % 5).cast("string"), "decode_mpps": F.when(k % 5 > 0, F.col("p_retailprice").cast("string")).otherwise("n/a"), "psnr_db": F.when(k % 7 == 0, "inf").when(k % 7 > 1, "40.5").otherwise(" ")}
    rows = table(spark, sf_dir, "part").repartition(4, "p_brand").sortWithinPartitions("p_partkey")
    rows.select(*(given.get(c, F.lit(None).cast("string")).alias(c) for c in tables.REPORT)).write.option("header", True).csv(place)
    got = tables.benchmark_report(spark, place)
    return got.select("file", "dst_ts", F.col("decode_mpps").alias("mpps"), F.when(F.col("psnr_db") == float("inf"), "infinite").when(F.col("psnr_db").isNotNull(), "finite").alias("psnr"))


@query(
    "class_tables",
    "SELECT '1.2.' || s_suppkey AS class, syntax FROM supplier, (VALUES (0, 's0'), (1, 's1')) v(i, syntax) WHERE i < s_suppkey % 3 UNION ALL SELECT '1.2.' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 3 = 0",
)
def class_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property tables of storage classes written as text and read: one with comments and blank lines, classes with and without a list."""
    place = shared_folder(spark, "classes")
    k = F.col("s_suppkey")
    names = F.element_at(F.array(F.lit(""), F.lit(" s0 "), F.lit("s0, s1")), (k % 3 + 1).cast("int"))
    table(spark, sf_dir, "supplier").select(F.explode(F.array(F.concat(F.lit("# "), k), F.lit(""), F.concat(F.lit("1.2."), k, F.lit(" = "), names))).alias("value")).write.text(place)
    return tables.capabilities(tables.property_table(spark, place))
