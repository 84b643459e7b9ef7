"""Pixel queries: embeddings as image rows and part sizes as pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import dates
from halyard.functions import display as D
from halyard.functions import lut as L
from halyard.registry import query

from .common import table

_PIXELS_SQL = "(SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS x, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 1000 + 0.5) AS BIGINT) AS px FROM embeddings)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, x, px): 64 pixels a row, in thousandths."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return e.select("vec_id", F.col("x").cast("long").alias("x"), L.half_up(F.col("v").cast("double") * 1000).cast("long").alias("px"))


def _per_image(name: str, value: Callable[[], Column], sql: str) -> None:
    """Registers a query that sums a per-pixel function by image."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pixels(spark, sf_dir).withColumn("v", value()).groupBy("vec_id").agg(F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))

    query(name, f"SELECT vec_id, CAST(sum(v) AS BIGINT) AS total, min(v) AS low, max(v) AS high FROM (SELECT vec_id, CAST({sql} AS BIGINT) AS v FROM {_PIXELS_SQL}) GROUP BY 1")(run)


_per_image("lut_rescale", lambda: L.rescale(F.col("px"), 2.5, -100.0, 12, True), "greatest(-2048, least(2047, floor(px * 2.5 - 100 + 0.5)))")
_per_image("lut_rescale_inverse", lambda: L.rescale(F.col("px"), 0.5, 10.0, 8, False, inverse=True), "255 - greatest(0, least(255, floor(px * 0.5 + 10 + 0.5)))")
_per_image("lut_voi_linear", lambda: L.window_linear(F.col("px"), 400.0, 50.0, 0, 255), "trunc(greatest(0.0, least(255.0, px * (255.0::DOUBLE / 400.0::DOUBLE) + (255.0::DOUBLE - 255.0::DOUBLE / 400.0::DOUBLE * (50.0::DOUBLE + 400.0::DOUBLE / 2)))))")
_per_image("lut_voi_sigmoid", lambda: L.window_sigmoid(F.col("px"), 400.0, 50.0, 0, 255), "trunc(greatest(0.0, least(255.0, floor(255.0::DOUBLE / (1 + exp(-2.0::DOUBLE * 2.0 * (px - 50.0::DOUBLE) / 400.0)) + 0.5))))")
#: between the values of the curves at the window's ends, computed by the formulas of the specification: t = (px - level) / window
_T = "((px - 50.0::DOUBLE) / 400.0::DOUBLE)"
_NORMED = "greatest(0, least(255, floor(255.0::DOUBLE * (({0}) - ({1})) / (({2}) - ({1})) + 0.5)))"
_per_image("lut_voi_exp", lambda: L.window_exponential(F.col("px"), 400.0, 50.0, 0, 255), _NORMED.format(f"exp(2 * {_T})", "exp(-1.0::DOUBLE)", "exp(1.0::DOUBLE)"))
_per_image("lut_voi_log", lambda: L.window_log(F.col("px"), 400.0, 50.0, 0, 255), f"CASE WHEN 1 + {_T} <= 0 THEN 0 ELSE {_NORMED.format(f'ln(CASE WHEN 1 + {_T} > 0 THEN 2 * (1 + {_T}) ELSE 1 END)', 'ln(1.0::DOUBLE)', 'ln(3.0::DOUBLE)')} END")
_per_image("lut_voi_log_signed", lambda: L.window_log(F.col("px"), 400.0, 50.0, -128, 127), f"CASE WHEN 1 + {_T} < 0 THEN 0 WHEN 1 + {_T} = 0 THEN -128 ELSE greatest(-128, least(127, floor((255.0::DOUBLE * ln(CASE WHEN 1 + {_T} > 0 THEN 2 * (1 + {_T}) ELSE 1 END) + 128) / ln(3.0::DOUBLE) - 128 + 0.5))) END")
_per_image("lut_voi_sigmoid_norm", lambda: L.window_sigmoid(F.col("px"), 400.0, 50.0, 0, 255, normalised=True), _NORMED.format(f"1 / (1 + exp(-4 * {_T}))", "1 / (1 + exp(2.0::DOUBLE))", "1 / (1 + exp(-2.0::DOUBLE))"))
_per_image("lut_voi_sigmoid_inverse", lambda: L.window_sigmoid(F.col("px"), 400.0, 50.0, 0, 255, inverse=True), "255 - greatest(0.0, least(255.0, floor(255.0::DOUBLE / (1 + exp(-4.0::DOUBLE * (px - 50.0::DOUBLE) / 400.0)) + 0.5)))")
_CURVE = [20, 30, 60, 180, 220]
_AT = "(CASE WHEN px <= -150 THEN 0.0::DOUBLE WHEN px > 150 THEN 4.0::DOUBLE ELSE (px + 150) * (4.0::DOUBLE / 300) END)"
_POINT = "([20, 30, 60, 180, 220])[CAST({0} AS INT) + 1]"
_A, _B = _POINT.format(f"floor({_AT})"), _POINT.format(f"ceil({_AT})")
_per_image("lut_voi_seq", lambda: L.window_sequence(F.col("px"), 300.0, 0.0, _CURVE, 0, 255), f"least(255, floor(floor({_A} + ({_AT} - floor({_AT})) * ({_B} - {_A}) + 0.5) * (255.0::DOUBLE / 200) + 0.5))")
_per_image("mask_fill", lambda: F.when(D.in_rectangle(F.col("vec_id") % 16, F.col("x"), 0, 8, 8, 16), F.lit(0).cast("long")).otherwise(F.col("px")), "CASE WHEN x >= 8 AND x < 24 AND vec_id % 16 < 8 THEN 0 ELSE px END")
_per_image("crop_region", lambda: F.when(D.in_rectangle(F.lit(0), F.col("x"), 0, 16, 1, 32), F.col("px")), "CASE WHEN x BETWEEN 16 AND 47 THEN px END")


@query(
    "lut_table_padding",
    "SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 20 THEN 5 ELSE least(255, floor(p_size * 2 + 5 + 0.5)) END::BIGINT AS v FROM part",
)
def lut_table_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table built once, its padding entries filled, and joined to pixels by position."""
    filled = L.padding_fill(L.rescale_table(2.0, 5.0, 8, False, 8, False), 0, 10, 20, False)
    entries = spark.range(1).select(F.posexplode(filled).alias("at", "v"))
    return table(spark, sf_dir, "part").join(entries, F.col("p_size") == F.col("at")).select("p_partkey", F.col("v").cast("long").alias("v"))


@query("pixel_to_real", "SELECT p_partkey, p_size * CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE 2.0 END + CASE WHEN p_size % 2 = 0 THEN 0.0 ELSE -10.0 END::DOUBLE AS v FROM part")
def pixel_to_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    slope, intercept = F.when(F.col("p_size") % 3 > 0, 2.0), F.when(F.col("p_size") % 2 > 0, -10.0)
    return table(spark, sf_dir, "part").select("p_partkey", L.pixel_to_real(F.col("p_size"), slope, intercept).alias("v"))


@query(
    "px_minmax_padding",
    f"SELECT vec_id, min(px) AS low, CASE WHEN min(px) = max(px) THEN max(px) + 1 ELSE max(px) END AS high FROM {_PIXELS_SQL} WHERE NOT (px BETWEEN -50 AND 0) GROUP BY 1",
)
def px_minmax_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of the pixels outside the padding range; a uniform image gets a range of one."""
    low, high = D.pixel_range(F.col("px"), F.lit(0), F.lit(-50))
    return pixels(spark, sf_dir).groupBy("vec_id").agg(low.alias("low"), high.alias("high")).where("low is not null")


@query(
    "wl_params",
    """WITH w AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS w, CASE WHEN p_size % 5 = 0 THEN 100.0::DOUBLE END AS pw FROM part),
       e AS (SELECT p_partkey, coalesce(w, pw, 255.0) AS win, CASE WHEN w IS NOT NULL THEN 40.0 WHEN pw IS NOT NULL THEN 50.0 ELSE 127.5 END::DOUBLE AS lev FROM w)
       SELECT p_partkey, win, lev, least(0.0, lev - win / 2) AS low, greatest(255.0, lev + win / 2) AS high FROM e""",
)
def wl_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window and level: given, else preset, else the data's range."""
    w, pw = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double")), F.when(F.col("p_size") % 5 == 0, 100.0)
    got = L.window_parameters(w, F.lit(40.0), pw, F.lit(50.0), F.lit(0.0), F.lit(255.0))
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for c, n in zip(got, ("win", "lev", "low", "high"), strict=True)))


#: fixed values: standard CT window presets (name, window, level)
CT_PRESETS = [("Brain", 110.0, 35.0), ("Abdomen", 320.0, 50.0), ("Mediastinum", 400.0, 80.0), ("Bone", 2000.0, 350.0), ("Lung", 1500.0, -500.0)]


@query(
    "wl_presets",
    "WITH p(name, w, l) AS (VALUES " + ", ".join(f"('{n}', {w}::DOUBLE, {lv}::DOUBLE)" for n, w, lv in CT_PRESETS) + ") SELECT p_partkey, name, w, l FROM part JOIN p ON p_size % 2 = 0 AND p_size > 8",
)
def wl_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presets of a modality, for images of over 8 bits."""
    presets = spark.createDataFrame([("CT", *p) for p in CT_PRESETS], "modality string, name string, w double, l double")
    modality = F.when(F.col("p_size") % 2 == 0, "CT").otherwise("MR")
    return table(spark, sf_dir, "part").where("p_size > 8").withColumn("modality", modality).join(presets, "modality").select("p_partkey", "name", "w", "l")


@query("overlay_bits", "SELECT p_partkey, count(*) AS bits FROM (SELECT p_partkey, i, ascii(p_name[CAST(i // 8 AS INT) + 1]) AS b FROM (SELECT p_partkey, p_name, unnest(range(0, 8 * length(p_name))) AS i FROM part)) WHERE (b >> CAST(i % 8 AS INT)) & 1 = 1 GROUP BY 1")
def overlay_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed overlay bits, the lowest of a byte first."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").cast("binary").alias("data"), F.explode(F.sequence(F.lit(0), 8 * F.length("p_name") - 1)).alias("i"))
    return p.where(L.overlay_bit(F.col("data"), F.col("i")) == 1).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("bits"))


def _gray(k: int) -> Column:
    return (F.col("p_partkey") * k % 256).cast("double")




@query(
    "lab_lightness",
    """WITH g AS (SELECT p_partkey, (p_partkey % 256)::DOUBLE / 255 AS c FROM part), l AS (SELECT p_partkey, CASE WHEN c <= 0.0404482362771076::DOUBLE THEN c / 12.92::DOUBLE ELSE pow((c + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS v FROM g),
       y AS (SELECT p_partkey, 0.2125862307855955516::DOUBLE * v + 0.7151703037034108499::DOUBLE * v + 0.07220049864333622685::DOUBLE * v AS y FROM l)
       SELECT p_partkey, CAST(greatest(0, least(65535, floor((116.0::DOUBLE * (CASE WHEN y > 8.85645167903563082e-3::DOUBLE THEN pow(y, 1.0::DOUBLE / 3.0::DOUBLE) ELSE 841.0::DOUBLE / 108.0::DOUBLE * y + 4.0::DOUBLE / 29.0::DOUBLE END) - 16.0::DOUBLE) * (65535.0::DOUBLE / 100) + 0.5::DOUBLE))) AS BIGINT) AS lightness FROM y""",
)
def lab_lightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded lightness of grays."""
    g = _gray(1)
    return table(spark, sf_dir, "part").select("p_partkey", L.rgb_to_lab(g, g, g)[0].alias("lightness"))


@query("shutter_points", "SELECT vec_id, count(*) AS inside FROM (SELECT vec_id, vec_id % 64 AS y, generate_series AS x FROM embeddings, generate_series(0, 63)) WHERE x BETWEEN 4 AND 60 AND y BETWEEN 2 AND 50 AND (x - 32) * (x - 32) + (y - 32) * (y - 32) <= 900 GROUP BY 1")
def shutter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside the intersection of a rectangular and a circular shutter."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 64).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    inside = F.col("x").between(4, 60) & F.col("y").between(2, 50) & ((F.col("x") - 32) ** 2 + (F.col("y") - 32) ** 2 <= 900)
    return p.where(inside).groupBy("vec_id").agg(F.count(F.lit(1)).alias("inside"))


_PAIR_SQL = f"(SELECT vec_id // 8 AS tile_y, x // 8 AS tile_x, px::DOUBLE AS a, (px + (x * 7 + vec_id) % 5)::DOUBLE AS b FROM {_PIXELS_SQL})"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("px") + (F.col("x") * 7 + F.col("vec_id")) % 5
    return pixels(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).alias("tile_y"), F.floor(F.col("x") / 8).alias("tile_x"), F.col("px").cast("double").alias("a"), b.cast("double").alias("b"))


@query("psnr", f"SELECT tile_x, round(10 * log10(4095.0 * 4095.0 / avg((a - b) * (a - b))), 6) AS psnr FROM {_PAIR_SQL} GROUP BY 1")
def psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _pairs(spark, sf_dir).groupBy("tile_x").agg(F.avg((F.col("a") - F.col("b")) ** 2).alias("mse"))
    return got.select("tile_x", F.round(L.psnr(F.col("mse"), 4095.0), 6).alias("psnr"))


@query(
    "ssim_tiles",
    f"""WITH t AS (SELECT tile_x, tile_y, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(a*a) AS sa, avg(b*b) AS sb, avg(a*b) AS ab FROM {_PAIR_SQL} GROUP BY ALL HAVING count(*) = 64)
        SELECT tile_x, count(*) AS tiles, round(avg((2*ma*mb + 1676.9025) * (2*(ab - ma*mb) + 15092.1225) / ((ma*ma + mb*mb + 1676.9025) * ((sa - ma*ma) + (sb - mb*mb) + 15092.1225))), 6) AS ssim FROM t GROUP BY 1""",
)
def ssim_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural similarity of full 8 x 8 tiles."""
    a, b = F.col("a"), F.col("b")
    t = _pairs(spark, sf_dir).groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(k) for c, k in ((a, "ma"), (b, "mb"), (a * a, "sa"), (b * b, "sb"), (a * b, "ab")))).where("n = 64")
    s = L.ssim(*(F.col(k) for k in ("n", "ma", "mb", "sa", "sb", "ab")), 4095.0)
    return t.groupBy("tile_x").agg(F.count(F.lit(1)).alias("tiles"), F.round(F.avg(s), 6).alias("ssim"))


@query("frame_ranges", "SELECT p_partkey, f AS frame, 128 + (f - 1) * p_size * 64 AS start, p_size * 64 AS length FROM (SELECT p_partkey, p_size, unnest(generate_series(1, 1 + p_partkey % 4)) AS f FROM part)")
def frame_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of the frames of native pixel data."""
    ranges = D.frame_ranges(F.lit(128), (F.col("p_size") * 64).cast("long"), 1 + F.col("p_partkey") % 4)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(ranges).alias("r")).select("p_partkey", "r.*")


@query("fragment_frames", "SELECT l_orderkey, frame, count(*) AS fragments FROM (SELECT l_orderkey, sum(CASE WHEN r = 1 OR l_quantity > 25 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY r) AS frame FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem)) GROUP BY ALL")
def fragment_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments to frames: one that starts a new image begins a frame."""
    head = F.when(F.col("l_quantity") > 40, F.unhex(F.lit("FFD8FFE0"))).when(F.col("l_quantity") > 25, F.unhex(F.lit("FF4FFF5100"))).otherwise(F.unhex(F.lit("FFD900")))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *order, head.alias("data"))
    return D.fragment_frames(lines, "l_orderkey", order, "data").groupBy("l_orderkey", "frame").agg(F.count(F.lit(1)).alias("fragments"))


@query("descriptor", "WITH b AS (SELECT *, CASE WHEN p_size % 5 > 0 AND p_size < 16 THEN p_size ELSE 16 END AS b FROM part) SELECT p_partkey, greatest(0, p_size - 10) AS n_rows, 0 AS n_columns, CASE WHEN p_size % 2 = 0 AND p_size > 21 THEN p_size - 20 ELSE 1 END AS frames, greatest(1, p_size % 3) AS samples, b AS bits_stored, CASE WHEN p_size % 4 > 0 THEN least(b - 1, 11) ELSE b - 1 END AS high_bit FROM b")
def descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image attributes clamped to what can be."""
    s, none = F.col("p_size"), F.lit(None).cast("int")
    got = D.image_descriptor(s - 10, none, F.when(s % 2 == 0, s - 20), s % 3, F.lit(16), F.when(s % 5 > 0, s), F.when(s % 4 > 0, 11))
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in got.items()))


@query("pixel_to_table", "SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 14 THEN (p_size - 5) * 100.0 ELSE p_size END::DOUBLE AS v FROM part")
def pixel_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real values through a table of ten entries from 5 on; other pixels stay as they are."""
    entries = F.array(*(F.lit(i * 100) for i in range(10)))
    return table(spark, sf_dir, "part").select("p_partkey", L.pixel_to_table(F.col("p_size"), entries, 5).cast("double").alias("v"))


@query("descriptor_times", "SELECT o_orderkey, lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || '07.' || lpad(CAST(o_custkey * 37 % 1000000 AS VARCHAR), 6, '0') AS tm FROM orders")
def descriptor_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day as text."""
    ns = ((F.col("o_custkey") % 24) * 3600 + (F.col("o_orderkey") % 60) * 60 + 7) * 1_000_000_000 + (F.col("o_custkey") * 37 % 1000000) * 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.format_tm(ns).alias("tm"))
