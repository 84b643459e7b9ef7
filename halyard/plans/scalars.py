"""Scalar queries: dates and times, ages, identifiers, codes, text and keyed digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import dates as D
from halyard.functions import hashing as H
from halyard.functions import text as X
from halyard.registry import query

from .common import table

_TS = "CAST(epoch_us(ts) AS BIGINT)"
_NS_OF_DAY = f"(({_TS} % 86400000000) * 1000)"


@query("dt_parse_da", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def dt_parse_da(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, dotted, half dotted, and malformed dates."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    t = F.when(k == 0, F.date_format(d, "yyyyMMdd")).when(k == 1, F.date_format(d, "yyyy.MM.dd")).when(k == 2, F.date_format(d, " yyyy.MMdd ")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.parse_da(t).alias("day"))


@query("dt_format_da", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS da, strftime(o_orderdate, '%Y%m%d%H%M%S') || '.000000' AS dt FROM orders")
def dt_format_da(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", D.format_da(F.col("o_orderdate")).alias("da"), D.format_dt(F.date_trunc("second", "o_orderdate")).alias("dt"))


def _tm(k: int):
    return F.when(F.col("event_id") % 3 == k, F.date_format("ts", ("HHmmss.SSSSSS", "HH:mm:ss", "HHmm")[k]))


def _time_text():
    return F.coalesce(*(_tm(k) for k in range(3)))


_TM_SQL = f"CASE event_id % 3 WHEN 0 THEN {_NS_OF_DAY} WHEN 1 THEN {_NS_OF_DAY} // 1000000000 * 1000000000 ELSE {_NS_OF_DAY} // 60000000000 * 60000000000 END"


@query("dt_parse_tm", f"SELECT event_id, {_TM_SQL} AS ns FROM events")
def dt_parse_tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", D.parse_tm(_time_text()).alias("ns"))


@query("dt_parse_tm_max", f"SELECT event_id, {_TM_SQL} + CASE event_id % 3 WHEN 0 THEN 999 WHEN 1 THEN 999999999 ELSE 59999999999 END AS ns FROM events")
def dt_parse_tm_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", D.parse_tm_max(_time_text()).alias("ns"))


def _dt(k: int):
    return F.when(F.col("event_id") % 4 == k, F.concat(F.date_format("ts", ("yyyyMMddHHmmss", "yyyyMMdd", "yyyyMM", "yyyyMMddHHmm")[k]), F.lit(("+0230", "", "", "-0500")[k])))


def _date_time_text():
    return F.coalesce(*(_dt(k) for k in range(4)))


_DT_SQL = f"""CASE event_id % 4 WHEN 0 THEN {_TS} // 1000000 * 1000000000 - 9000000000000 WHEN 1 THEN {_TS} // 86400000000 * 86400000000000
  WHEN 2 THEN CAST(epoch_us(date_trunc('month', ts)) AS BIGINT) * 1000 ELSE {_TS} // 60000000 * 60000000000 + 18000000000000 END"""


@query("dt_parse_dt", f"SELECT event_id, {_DT_SQL} AS ns FROM events")
def dt_parse_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", D.parse_dt(_date_time_text()).alias("ns"))


@query(
    "dt_parse_dt_max",
    f"""SELECT event_id, {_DT_SQL} + CASE event_id % 4 WHEN 0 THEN 999999999 WHEN 1 THEN 86399999999999
        WHEN 2 THEN CAST(epoch_us(date_trunc('month', ts) + INTERVAL 1 MONTH) - epoch_us(date_trunc('month', ts)) AS BIGINT) * 1000 - 1 ELSE 59999999999 END AS ns FROM events""",
)
def dt_parse_dt_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", D.parse_dt_max(_date_time_text()).alias("ns"))


@query("dt_truncate", "SELECT event_id, strftime(ts, '%H%M%S') || '.' || strftime(ts, '%f')[1:1] AS t8, strftime(ts, '%H%M%S') AS t7, strftime(ts, '%Y%m%d%H%M') || '+0100' AS d13 FROM events")
def dt_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tm, dt = F.date_format("ts", "HHmmss.SSSSSS"), F.concat(F.date_format("ts", "yyyyMMddHHmmss.SSSSSS"), F.lit("+0100"))
    return table(spark, sf_dir, "events").select("event_id", D.truncate(tm, 8).alias("t8"), D.truncate(tm, 7).alias("t7"), D.truncate(dt, 13, zone_aware=True).alias("d13"))


@query("dt_combine", f"SELECT event_id, CASE WHEN event_id % 5 > 0 THEN {_TS} // 86400000000 * 86400000000000 + CASE WHEN event_id % 3 > 0 THEN {_NS_OF_DAY} ELSE 0 END END AS ns FROM events")
def dt_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("event_id") % 5 > 0, F.to_date("ts"))
    time = F.when(F.col("event_id") % 3 > 0, D.parse_tm(F.date_format("ts", "HHmmss.SSSSSS")))
    return table(spark, sf_dir, "events").select("event_id", D.combine(day, time).alias("ns"))


_MONTHS = "((year(d) - year(b)) * 12 + month(d) - month(b) - CASE WHEN day(d) < day(b) THEN 1 ELSE 0 END)"


@query(
    "age_string",
    f"""WITH a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - CAST(o_custkey * 37 % 9000 AS INT) AS b FROM orders)
        SELECT o_orderkey, CASE WHEN {_MONTHS} >= 24 THEN lpad(CAST({_MONTHS} // 12 AS VARCHAR), 3, '0') || 'Y' WHEN {_MONTHS} >= 2 THEN lpad(CAST({_MONTHS} AS VARCHAR), 3, '0') || 'M'
          ELSE lpad(CAST(d - b AS VARCHAR), 3, '0') || 'D' END AS age FROM a""",
)
def age_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    birth = F.date_sub(day, (F.col("o_custkey") * 37 % 9000).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.age(birth, day).alias("age"))


@query("sex_norm", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'O' END AS sex, CASE WHEN o_orderkey % 2 = 0 THEN 'M' ELSE 'O' END AS other FROM orders")
def sex_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_orderstatus") == "F", "female").when(F.col("o_orderstatus") == "O", "other")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.patient_sex(raw).alias("sex"), X.patient_sex(F.when(F.col("o_orderkey") % 2 == 0, "m").otherwise("")).alias("other"))


@query("uid_valid", "SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber NOT IN (2, 3, 4, 5) AS valid FROM lineitem")
def uid_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, uid = F.col("l_linenumber"), F.concat(F.lit("1.2."), F.col("l_orderkey"))
    bad = F.when(n == 2, F.concat(uid, F.lit("."))).when(n == 3, F.concat(F.lit("1..2"), uid)).when(n == 4, F.concat(uid, F.lit("a"))).when(n == 5, F.rpad(uid, 65, "1")).otherwise(uid)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.valid_uid(bad).alias("valid"))


@query("fmt_template", "SELECT p_partkey, CASE WHEN length(p_name) > 5 THEN p_name[1:5] || '...' ELSE p_name END AS short, 'Price: ' || printf('%.2f', p_retailprice) || ' EUR' AS price, '[' || p_brand || ']' AS brand FROM part")
def fmt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.formatted(F.col("p_name"), "$V:l$5$").alias("short"), X.formatted(F.col("p_retailprice"), "Price: $V:f$0.00$ EUR", decimal=True).alias("price"), X.formatted(F.col("p_brand"), "[$V]").alias("brand")
    )


@query("code_value", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_type END AS code FROM part")
def code_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 3
    return table(spark, sf_dir, "part").select("p_partkey", X.code_value(F.when(k == 0, F.col("p_brand")).otherwise(" "), F.when(k == 1, F.col("p_type")), F.lit("")).alias("code"))


@query(
    "http_texts",
    "WITH s AS (SELECT l_orderkey, l_linenumber, (CASE l_linenumber % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN 304 ELSE 418 END) AS s, (l_partkey * 977 % 70000 - 100) AS p FROM lineitem) SELECT l_orderkey, l_linenumber, CASE s WHEN 200 THEN 'OK' WHEN 404 THEN 'Not Found' WHEN 503 THEN 'Service Unavailable' WHEN 304 THEN 'Not Modified' ELSE 'Unknown Status' END AS text, p > 0 AND p < 65536 AS port FROM s",
)
def http_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of statuses, and ports that can be."""
    n = F.col("l_linenumber") % 5
    status = F.when(n == 0, 200).when(n == 1, 404).when(n == 2, 503).when(n == 3, 304).otherwise(418)
    port = (F.col("l_partkey") * 977 % 70000 - 100).cast("string")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.http_text(status).alias("text"), X.valid_port(port).alias("port"))


@query("http_category", "SELECT l_orderkey, l_partkey, CASE 1 + l_linenumber % 6 WHEN 1 THEN 'INFORMATIONAL' WHEN 2 THEN 'SUCCESS' WHEN 3 THEN 'REDIRECTION' WHEN 4 THEN 'CLIENT_ERROR' WHEN 5 THEN 'SERVER_ERROR' ELSE 'UNKNOWN' END AS category FROM lineitem")
def http_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", X.http_category((F.lit(1) + F.col("l_linenumber") % 6) * 100 + 4).alias("category"))


@query("hex_roundtrip", "SELECT p_partkey, lower(hex(p_name)) AS digits, true AS same FROM part")
def hex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lower(F.hex(F.col("p_name").cast("binary")))
    back = H.hex_to_bytes(F.concat(F.lit("0x"), F.regexp_replace(digits, "^(..)", "$1-"))).cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", digits.alias("digits"), (back == F.col("p_name")).alias("same"))


@query("compression_rate", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 ELSE greatest(0, least(100, p_size * 5 - 60)) END AS rate FROM part")
def compression_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("p_size") % 4 == 0, "none").otherwise((F.col("p_size") * 5 - 60).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", X.compression_rate(t).alias("rate"))


@query("tag_list", "SELECT p_partkey, CAST(p_size AS VARCHAR) || ';' || CAST(p_size AS VARCHAR) || ';8' AS tags FROM part")
def tag_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal, hexadecimal and octal tags; what is no number goes."""
    text = F.concat_ws(",", F.col("p_size").cast("string"), F.lit("zz"), F.concat(F.lit("0x"), F.hex("p_size")), F.lit("010"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.tag_list(text).cast("array<string>"), ";").alias("tags"))


@query("header_checks", "SELECT c_custkey, c_custkey % 2 = 0 AS valid, CASE WHEN c_custkey % 3 = 0 THEN '***' ELSE c_name END AS shown, c_custkey % 4 > 0 AS aet FROM customer")
def header_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, "X-Origin").otherwise("X Origin")
    secret = F.when(k % 3 == 0, "Authorization").otherwise("X-Origin")
    aet = F.when(k % 4 == 0, "A_MUCH_TOO_LONG_TITLE").otherwise("SCP")
    return table(spark, sf_dir, "customer").select("c_custkey", X.valid_header(name, F.col("c_name")).alias("valid"), X.redact(secret, F.col("c_name")).alias("shown"), X.valid_aet(aet).alias("aet"))


KEY = H.key_bytes("00112233-4455-6677-8899-aabbccddeeff")


def hmac_sql(text: str) -> str:
    """The keyed digest by its definition: a digest over the outer pad and the digest over the inner pad and the text."""
    inner, outer = (bytes(b ^ pad for b in KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


def _number_sql(digits: str) -> str:
    return f"list_reduce(list_transform(range(1, CAST(length({digits}) AS BIGINT) + 1), lambda i: (instr('0123456789abcdef', {digits}[i]) - 1)::UHUGEINT), lambda a, b: a * 16 + b)"


def uid_sql(text: str) -> str:
    """The first 128 bits of the digest with version 4 and variant 10 set, as a decimal number."""
    n = f"{_number_sql(f'{hmac_sql(text)}[1:32]')}"
    version, variant = "(1::UHUGEINT << 76)", "(1::UHUGEINT << 62)"
    return f"'2.25.' || (({n}) & ~(15 * {version}) & ~(3 * {variant}) | (4 * {version}) | (2 * {variant}))"


@query("hmac_hex", f"SELECT c_custkey, {hmac_sql('c_name')} AS digest FROM customer")
def hmac_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", H.hmac_hex(F.col("c_name"), KEY).alias("digest"))


@query("hmac_uid", f"SELECT o_orderkey, {uid_sql(chr(39) + '1.2.' + chr(39) + ' || o_orderkey')} AS uid FROM orders")
def hmac_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms of identifiers."""
    return table(spark, sf_dir, "orders").select("o_orderkey", H.uid_hash(F.concat(F.lit("1.2."), F.col("o_orderkey")), KEY).alias("uid"))


@query("hmac_scale", f"SELECT c_custkey, CAST(trunc({_number_sql(hmac_sql('c_name') + '[1:12]')}::DOUBLE / 281474976710656.0::DOUBLE * 61) AS INT) - 30 AS shift FROM customer")
def hmac_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", H.scale_hash(F.col("c_name"), KEY, -30, 31).alias("shift"))
