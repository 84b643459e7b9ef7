"""Transfer syntax queries: parts as images whose syntax, depth and attributes follow from their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import syntaxes as T
from halyard.registry import query

from .common import table

_LIST = [*T.UIDS, "1.2.3"]
#: part rows with a syntax each; ``n`` is the number behind 4. in it, if there is one
_SQL_UIDS = "[" + ", ".join(f"'{u}'" for u in _LIST) + "]"
_IMAGES = (
    f"(SELECT p_partkey, p_size, ({_SQL_UIDS})[CAST(p_partkey % {len(_LIST)} AS INT) + 1] AS uid, ({_SQL_UIDS})[CAST(p_partkey * 7 % {len(_LIST)} AS INT) + 1] AS other FROM part)"
)
_N = "TRY_CAST(regexp_extract(uid, '^1\\.2\\.840\\.10008\\.1\\.2\\.4\\.([0-9]+)', 1) AS INT)"
_VIDEO = "coalesce(n BETWEEN 100 AND 108, false)"
_J2K = "coalesce(n BETWEEN 90 AND 93 OR n BETWEEN 201 AND 203, false)"
_KIND = f"""CASE WHEN uid IN ('1.2.840.10008.1.2', '1.2.840.10008.1.2.1', '1.2.840.10008.1.2.2') THEN 'NATIVE' WHEN uid = '1.2.840.10008.1.2.1.99' THEN 'DEFLATED' WHEN n = 50 THEN 'JPEG_BASELINE'
  WHEN n = 51 THEN 'JPEG_EXTENDED' WHEN n = 53 THEN 'JPEG_SPECTRAL' WHEN n = 55 THEN 'JPEG_PROGRESSIVE' WHEN n IN (57, 70) THEN 'JPEG_LOSSLESS' WHEN n IN (80, 81) THEN 'JPEG_LS' WHEN {_J2K} THEN 'JPEG_2000'
  WHEN n IN (94, 95, 204, 205) THEN 'JPIP' WHEN {_VIDEO} THEN 'MPEG' WHEN n BETWEEN 110 AND 112 THEN 'JPEG_XL' WHEN uid = '1.2.840.10008.1.2.5' THEN 'RLE' ELSE 'UNKNOWN' END"""
_WITH = f"WITH i AS (SELECT *, {_N} AS n FROM {_IMAGES}), k AS (SELECT *, {_KIND} AS kind FROM i)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    uids = F.array(*map(F.lit, _LIST))
    p = table(spark, sf_dir, "part")
    pick = lambda n: F.element_at(uids, (n % len(_LIST)).cast("int") + 1)
    return p.select("p_partkey", "p_size", pick(F.col("p_partkey")).alias("uid"), pick(F.col("p_partkey") * 7).alias("other"))


def _even(k: int) -> Column:
    return F.floor(F.col("p_partkey") / k) % 2 == 0


@query(
    "ts_class",
    f"""{_WITH} SELECT p_partkey, kind AS type, kind = 'NATIVE' AS native, {_VIDEO} AS video, {_J2K} AS jpeg2000, coalesce(n IN (90, 111, 112), false) AS jpeg_xl,
        coalesce(n IN (50, 51, 53, 55, 81, 91, 93, 203, 111, 112), false) OR {_VIDEO} AS lossy, coalesce(n IN (50, 51, 53, 55, 90, 91, 201, 202, 203, 111), false) AS ybr,
        kind IN ('NATIVE', 'RLE', 'JPEG_XL', 'JPEG_LS') OR coalesce(n BETWEEN 50 AND 70 OR n BETWEEN 90 AND 93, false) AS readable,
        uid IN ('1.2.840.10008.1.2', '1.2.840.10008.1.2.1') OR kind IN ('JPEG_XL', 'JPEG_LS') OR coalesce(n BETWEEN 50 AND 70 OR n IN (90, 91), false) AS writable, coalesce(n BETWEEN 50 AND 55, false) AS adaptable
        FROM k WHERE kind <> 'UNKNOWN'""",
)
def ts_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of each image's syntax, from the dimension; a syntax that is not registered has none."""
    classes = T.dimension(spark).select("uid", "type", "native", "video", "jpeg2000", "jpeg_xl", "lossy", "ybr", "readable", "writable", "adaptable")
    return images(spark, sf_dir).join(classes, "uid").drop("uid", "other", "p_size")


@query(
    "ts_properties",
    f"""{_WITH} SELECT p_partkey, kind AS type, kind NOT IN ('NATIVE', 'DEFLATED', 'JPIP', 'UNKNOWN') AS encapsulated, kind LIKE 'JPEG%' AS spans_fragments,
        kind NOT IN ('JPEG_BASELINE', 'JPEG_EXTENDED', 'JPEG_SPECTRAL', 'JPEG_PROGRESSIVE', 'MPEG') AS carries_sign, CASE WHEN kind IN ('JPEG_BASELINE', 'MPEG') THEN 8
        WHEN kind IN ('JPEG_EXTENDED', 'JPEG_SPECTRAL', 'JPEG_PROGRESSIVE') THEN 12 WHEN kind = 'JPEG_XL' THEN 24 ELSE 16 END AS max_bits, CASE WHEN kind = 'RLE' THEN 1 ELSE 0 END AS planar,
        CASE WHEN n IN (51, 53, 55) AND p_size IN (9, 10, 11) THEN 12 ELSE p_size END AS bits_stored FROM k WHERE kind <> 'UNKNOWN'""",
)
def ts_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = images(spark, sf_dir).join(T.dimension(spark).select("uid", "type", "encapsulated", "spans_fragments", "carries_sign", "max_bits", "planar"), "uid")
    return got.withColumn("bits_stored", T.bits_for_twelve(T.type_of(F.col("uid")), F.col("p_size"))).drop("uid", "other", "p_size")


@query(
    "syntax_suitable",
    f"""{_WITH}, d AS (SELECT *, p_size % 7 AS depth FROM k) SELECT p_partkey, CASE WHEN uid IN ('1.2.840.10008.1.2', '1.2.840.10008.1.2.1') THEN '1.2.840.10008.1.2.1'
        WHEN (n = 50 AND depth < 2) OR (n IN (51, 53, 55) AND depth < 3 AND p_size < 13) OR ((kind IN ('JPEG_LOSSLESS', 'JPEG_LS') OR n IN (90, 91, 201, 202, 203)) AND depth < 4) OR (n = 110 AND depth < 6) OR (n IN (111, 112) AND depth < 2) THEN uid
        WHEN n IN (50, 51, 53, 55) AND depth < 4 THEN '1.2.840.10008.1.2.4.70' WHEN n IN (111, 112) AND depth < 6 THEN '1.2.840.10008.1.2.4.110'
        WHEN n IN (50, 51, 53, 55, 110, 111, 112, 90, 91, 201, 202, 203) OR kind IN ('JPEG_LOSSLESS', 'JPEG_LS') THEN '1.2.840.10008.1.2.1' ELSE uid END AS syntax FROM d""",
)
def syntax_suitable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The syntax that can hold pixels of a type and depth."""
    return images(spark, sf_dir).select("p_partkey", T.suitable(F.col("uid"), F.col("p_size") % 7, F.col("p_size")).alias("syntax"))


_NATIVE_SQL = "('1.2.840.10008.1.2', '1.2.840.10008.1.2.1', '1.2.840.10008.1.2.2')"


@query("transcode_needed", f"SELECT p_partkey, uid <> other AND NOT (uid IN {_NATIVE_SQL} AND other IN {_NATIVE_SQL}) AS needed FROM {_IMAGES}")
def transcode_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("p_partkey", T.transcode_needed(F.col("uid"), F.col("other")).alias("needed"))


_PHOTOMETRIC = ["MONOCHROME1", "MONOCHROME2", "PALETTE COLOR", "RGB", "YBR_FULL", "YBR_FULL_422", "YBR_ICT", "YBR_RCT"]


@query(
    "ybr_to_rgb",
    f"""{_WITH}, c AS (SELECT *, ({_PHOTOMETRIC!r})[CAST(p_size % 8 AS INT) + 1] AS pmi, p_partkey % 3 = 0 AS rgb, p_partkey % 4 = 0 AS lossless FROM k)
        SELECT p_partkey, CASE WHEN pmi NOT IN ('RGB', 'YBR_FULL', 'YBR_FULL_422') THEN false WHEN pmi <> 'RGB' THEN true ELSE coalesce(n IN (50, 51, 53, 55), false) AND NOT rgb AND NOT lossless END AS convert FROM c""",
)
def ybr_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    pmi = F.element_at(F.array(*map(F.lit, _PHOTOMETRIC)), (F.col("p_size") % 8).cast("int") + 1)
    got = T.converts_to_rgb(pmi, F.col("uid"), F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 4 == 0)
    return images(spark, sf_dir).select("p_partkey", got.alias("convert"))


@query(
    "decode_flags",
    f"""{_WITH}, f AS (SELECT *, (p_partkey // 2) % 2 = 0 AS signed, (p_partkey // 3) % 2 = 0 AS fragments, (p_partkey // 5) % 2 = 0 AS ybr FROM k)
        SELECT p_partkey, CASE WHEN signed AND kind NOT IN ('JPEG_BASELINE', 'JPEG_EXTENDED', 'JPEG_SPECTRAL', 'JPEG_PROGRESSIVE', 'MPEG') THEN 1 ELSE 0 END
          + CASE WHEN ybr AND fragments AND kind NOT IN ('NATIVE', 'RLE') THEN CASE WHEN kind = 'JPEG_LS' THEN 34 ELSE 2 END ELSE 0 END
          + CASE WHEN uid = '1.2.840.10008.1.2.2' THEN 4 ELSE 0 END + CASE WHEN p_size = 32 THEN 8 ELSE 0 END + CASE WHEN kind = 'RLE' THEN 16 ELSE 0 END AS flags,
        CASE WHEN p_size < 9 AND p_partkey % 2 = 0 THEN 9 ELSE p_size END AS bits FROM f""",
)
def decode_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a decoder is told about an image."""
    flags = T.decode_flags(F.col("uid"), _even(2), _even(3), _even(5), F.col("uid") == f"{T.ROOT}.2", F.col("p_size") == 32)
    return images(spark, sf_dir).select("p_partkey", flags.alias("flags"), T.bits_to_read(F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, 16).otherwise(8)).alias("bits"))


@query(
    "encoder_bits",
    f"""{_WITH}, f AS (SELECT *, 1 + p_size % 16 AS bits, (p_partkey // 2) % 2 = 0 AS signed FROM k) SELECT p_partkey, CASE WHEN kind = 'JPEG_LS' AND signed THEN 16 WHEN kind = 'JPEG_2000' THEN bits
        WHEN bits = 8 AND (p_partkey // 3) % 2 = 0 THEN 12 WHEN bits <= 8 THEN 8 WHEN bits > 12 OR (signed AND p_partkey % 7 > 1) THEN 16 ELSE 12 END AS bits FROM f""",
)
def encoder_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = T.encoder_bits(T.type_of(F.col("uid")), 1 + F.col("p_size") % 16, F.when(_even(3), 16).otherwise(8), _even(2), F.col("p_partkey") % 7)
    return images(spark, sf_dir).select("p_partkey", bits.alias("bits"))


@query(
    "compression_settings",
    f"""SELECT p_partkey, CASE WHEN p_size % 5 > 0 AND uid NOT LIKE '%.110' THEN CASE WHEN p_partkey % 4 = 0 THEN 85 ELSE p_partkey % 4 * 20 END ELSE p_size % 5 END AS quality,
        CASE WHEN p_size % 3 > 0 AND p_partkey % 2 = 1 THEN 10 ELSE p_size % 3 END AS factor FROM {_IMAGES}""",
)
def compression_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    quality, factor = T.compression_settings(F.col("uid"), s % 5, k % 4 * 20, s % 3, k % 2 * 10)
    return images(spark, sf_dir).select("p_partkey", quality.alias("quality"), factor.alias("factor"))


@query(
    "lossy_history",
    f"""{_WITH}, l AS (SELECT *, coalesce(n IN (50, 51, 53, 55, 81, 91, 93, 203, 111, 112), false) OR {_VIDEO} AS lossy, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN ' ' ELSE 'ISO_1' END AS old,
          CASE kind WHEN 'JPEG_2000' THEN 'ISO_15444_1' WHEN 'JPEG_LS' THEN 'ISO_14495_1' WHEN 'JPEG_XL' THEN 'ISO_18181_1' ELSE 'ISO_10918_1' END AS method FROM k)
        SELECT p_partkey, CASE WHEN NOT lossy THEN coalesce(old, '-') WHEN old IS NULL THEN method WHEN old = ' ' THEN 'unknown/' || method ELSE old || '/' || method END AS methods,
        CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN lossy AND p_size > 20 THEN 1 ELSE 0 END AS ratios FROM l""",
)
def lossy_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods and ratios of earlier compressions, and of this one."""
    s = F.col("p_size")
    old = F.when(s % 3 == 1, F.array(F.lit(" "))).when(s % 3 == 2, F.array(F.lit("ISO_1")))
    ratio = F.when(s > 20, s.cast("double")).when(s > 10, float("inf")).otherwise(0.0)
    methods, ratios = T.lossy_history(F.col("uid"), old, F.when(s % 3 > 0, F.array(F.lit(2.0))), ratio)
    return images(spark, sf_dir).select("p_partkey", F.coalesce(F.array_join(methods, "/"), F.lit("-")).alias("methods"), F.coalesce(F.size(ratios), F.lit(0)).alias("ratios"))
