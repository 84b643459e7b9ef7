"""Display queries: parts carry tables, palettes and overlays in the bytes of their names, embeddings are images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import display as D
from halyard.functions import lut as L
from halyard.operators import presentation as P
from halyard.operators import rendering as R
from halyard.operators.resampling import scaled
from halyard.registry import query
from halyard.shared import shared_folder
from halyard.sources import tables

from .common import partitions, table
from .pixels import _PIXELS_SQL, pixels

K, S = (lambda: F.col("p_partkey")), (lambda: F.col("p_size"))


def _parts(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in columns.items()))


_CODES = "list_transform(range(1, CAST(length({0}) AS BIGINT) + 1), lambda i: ascii({0}[i]))"


@query(
    "lut_decode",
    f"""WITH d AS (SELECT p_partkey, p_size % 3 AS kind, {_CODES.format("p_name")} AS b, length(p_name) // 2 AS half, p_size * 3000 AS second FROM part),
        v AS (SELECT *, CASE kind WHEN 0 THEN b WHEN 1 THEN list_transform(range(0, half), lambda i: b[2 * i + 1]) ELSE list_transform(range(0, half), lambda i: ((b[2 * i + 1] + 256 * b[2 * i + 2]) * (half - 1) // 4095) % 256) END AS v FROM d)
        SELECT p_partkey, len(v) AS entries, list_sum(v)::BIGINT AS total, v[2]::BIGINT AS second_entry, list_min(v)::BIGINT AS least, (list_max(v) - list_min(v))::BIGINT AS spread, CASE WHEN second % 65536 >= 32768 THEN second % 65536 - 65536 ELSE second % 65536 END AS first_value FROM v""",
)
def lut_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of bytes, of bytes in 16-bit cells, and of 12 bits squeezed to 8."""
    data = F.col("p_name").cast("binary")
    half = F.floor(F.octet_length(data) / 2).cast("int")
    kind = S() % 3
    data = F.when(kind == 0, data).otherwise(F.substring(data, F.lit(1), 2 * half))
    got = D.decode_table(data, F.when(kind == 0, F.octet_length(data)).otherwise(half), F.when(kind == 2, 12).otherwise(8))
    t = _parts(spark, sf_dir, v=got, offset=D.table_offset(S() * 3000))
    least, spread = L.value_range(F.col("v"), 8)
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x)
    return t.select("p_partkey", F.size("v").cast("long").alias("entries"), total.alias("total"), F.get("v", F.lit(1)).cast("long").alias("second_entry"), least.cast("long").alias("least"), spread.cast("long").alias("spread"), F.col("offset").alias("first_value"))


_SEGMENT = "(CASE WHEN j = 0 THEN a WHEN j = 1 THEN b WHEN j < 6 THEN b + CAST(trunc((c - b) * (j - 1) / 4.0) AS BIGINT) WHEN j = 6 THEN a ELSE b END) >> 8"


@query(
    "lut_segmented",
    f"""WITH s AS (SELECT p_partkey, CAST(p_partkey * 257 % 65536 AS BIGINT) AS a, CAST(p_partkey * 911 % 65536 AS BIGINT) AS b, CAST(p_size * 1300 % 65536 AS BIGINT) AS c FROM part), e AS (SELECT *, unnest(range(0, 8)) AS j FROM s)
        SELECT p_partkey, string_agg(CAST({_SEGMENT} AS VARCHAR), ',' ORDER BY j) AS entries FROM e GROUP BY 1""",
)
def lut_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A discrete, a linear and an indirect segment."""
    words = [F.lit(0), F.lit(2), K() * 257 % 65536, K() * 911 % 65536, F.lit(1), F.lit(4), S() * 1300 % 65536, F.lit(2), F.lit(1), F.lit(0), F.lit(0)]
    got = D.inflate(F.array(*(w.cast("int") for w in words)), 8)
    return _parts(spark, sf_dir, entries=F.array_join(got.cast("array<string>"), ","))


def _entry(text: str, size: str, place: str = "{0}") -> str:
    at = f"greatest(0, least(p_size - 8, {size} - 1))"
    return f"ascii({text}[CAST({place.format(at)} AS INT) + 1])"


@query(
    "palette_apply",
    f"SELECT p_partkey, {_entry('p_name', 'length(p_name)')} AS red, {_entry('p_type', 'length(p_type) // 2', '2 * {0} + 1')} AS green, {_entry('p_brand', 'length(p_brand) // 2', '2 * {0}')} AS blue FROM part",
)
def palette_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels to colours: a palette of bytes, one of 16-bit cells, and one of bytes in 16-bit cells."""
    even = lambda c: F.substring(F.col(c).cast("binary"), F.lit(1), 2 * F.floor(F.length(c) / 2).cast("int"))
    red = D.palette_entries(F.col("p_name").cast("binary"), F.length("p_name"), F.lit(8))
    green, blue = (D.palette_entries(even(c), F.floor(F.length(c) / 2).cast("int"), F.lit(bits)) for c, bits in (("p_type", 16), ("p_brand", 8)))
    t = _parts(spark, sf_dir, px=S() - 5, r=red, g=green, b=blue)
    rgb = D.palette_apply(F.col("px"), F.col("r"), F.col("g"), F.col("b"), F.lit(3))
    return t.select("p_partkey", *(c.alias(n) for c, n in zip(rgb, ("red", "green", "blue"), strict=True)))


@query(
    "modality_table",
    """WITH m AS (SELECT p_partkey, p_size, (['CT', 'XA', 'XRF', ' ', NULL])[CAST(p_size % 5 AS INT) + 1] AS m, (['LOG', 'disp', 'LIN', NULL])[CAST(p_partkey % 4 AS INT) + 1] AS r FROM part)
       SELECT p_partkey, coalesce(m = 'CT', false) OR r IS NULL OR upper(r) NOT IN ('LOG', 'DISP') AS applies, (CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE p_size / 10.0 END / power(2, p_partkey % 5))::DOUBLE AS slope FROM m""",
)
def modality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a modality table is used, and the slope above overlay bits."""
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), n.cast("int") + 1)
    applies = D.modality_table_applies(of(["CT", "XA", "XRF", " ", None], S() % 5), of(["LOG", "disp", "LIN", None], K() % 4))
    return _parts(spark, sf_dir, applies=applies, slope=D.slope_below_overlay(F.when(S() % 3 > 0, S() / 10.0), K() % 5))


_EXPLAINED = "(CASE p_partkey % 3 WHEN 0 THEN ['A', 'A', NULL, ' '] WHEN 1 THEN ['A', 'B'] ELSE ['', 'C', 'C', 'C'] END)"


@query(
    "wl_preset_list",
    f"""WITH w AS (SELECT p_partkey, unnest(range(1, 5)) AS i, p_size, {_EXPLAINED} AS e FROM part),
        v AS (SELECT p_partkey, i, ([p_size, p_size, 100, 100])[i]::DOUBLE AS w, ([40, 40, 50, 50])[i]::DOUBLE AS c, nullif(trim(e[i]), '') AS e FROM w),
        f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, e, w, c ORDER BY i) AS again FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS n FROM f WHERE e IS NULL OR again = 1)
        SELECT p_partkey, string_agg(coalesce(e, 'Default ' || n) || ' [DICOM]=' || CAST(w AS INT) || '/' || CAST(c AS INT) || CASE WHEN n < 3 THEN '#' || n ELSE '' END, ';' ORDER BY n) AS presets FROM k GROUP BY 1""",
)
def wl_preset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets of an image's windows: named, without repeats, the first two with keys."""
    explained = F.when(K() % 3 == 0, F.array(F.lit("A"), F.lit("A"), F.lit(None).cast("string"), F.lit(" "))).when(K() % 3 == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(*map(F.lit, ["", "C", "C", "C"])))
    size = S().cast("double")
    windows = D.voi_windows(F.array(size, size, F.lit(100.0), F.lit(100.0)), F.array(*map(F.lit, [40.0, 40.0, 50.0, 50.0])), explained)
    shown = F.transform(
        D.presets(windows, "[DICOM]"),
        lambda p: F.concat(p["name"], F.lit("="), p["width"].cast("int"), F.lit("/"), p["center"].cast("int"), F.coalesce(F.concat(F.lit("#"), p["key"]), F.lit(""))),
    )
    return _parts(spark, sf_dir, presets=F.array_join(shown, ";"))


@query(
    "wl_table_window",
    """WITH t AS (SELECT p_partkey, greatest(p_partkey % 100 - 50, -20) AS low, p_partkey % 100 - 50 + p_size * 10 - 1 AS last FROM part), h AS (SELECT *, least(greatest(low, last), 200) AS high FROM t)
       SELECT p_partkey, (high - low)::DOUBLE AS width, (low + (high - low) / 2.0)::DOUBLE AS center FROM h""",
)
def wl_table_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, center = D.table_window(K() % 100 - 50, S() * 10, F.lit(-20), F.lit(200))
    return _parts(spark, sf_dir, width=width, center=center.cast("double"))


@query(
    "modality_output",
    """WITH m AS (SELECT p_partkey, p_size, -p_size AS lo, p_partkey % 4096 AS hi, ([1.0, 0.5, 2.0])[CAST(p_size % 3 AS INT) + 1]::DOUBLE AS s, ([0.0, -10.0])[CAST(p_partkey % 2 AS INT) + 1]::DOUBLE AS i, CASE WHEN p_size % 7 = 0 THEN 8 END AS t FROM part),
       v AS (SELECT *, lo * s + i AS a, floor(hi * s - lo * s + 0.5)::BIGINT AS d FROM m), b AS (SELECT *, CASE WHEN t IS NOT NULL THEN t WHEN a < 0 AND d < 256 THEN 9 WHEN d = 0 THEN 0 ELSE CAST(ceil(log2(d + 1)) AS INT) END AS bits FROM v)
       SELECT p_partkey, p_size % 20 <= 16 AND NOT (s = 1.0 AND i = 0.0 AND p_size % 4 > 0) AND bits > 0 AS applies, bits, t IS NULL AND (a < 0 OR p_size % 2 = 0) AS is_signed FROM b""",
)
def modality_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pixels are rescaled, and the depth and sign that the result needs."""
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), n.cast("int") + 1)
    applies, bits, signed = D.modality_output(-S(), K() % 4096, of([1.0, 0.5, 2.0], S() % 3), of([0.0, -10.0], K() % 2), S() % 2 == 0, S() % 4 == 0, S() % 20, F.when(S() % 7 == 0, 8))
    return _parts(spark, sf_dir, applies=applies, bits=bits, is_signed=signed)


@query(
    "voi_range",
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR (p_size % 3 = 0 AND p_partkey % 2 = 0) THEN -2048 ELSE CAST(trunc(-p_size * 1.5) AS INT) END AS low, CASE WHEN p_size % 5 = 0 OR (p_size % 3 = 0 AND p_partkey % 2 = 0) THEN 2047 ELSE CAST(trunc(p_size * 2.5) AS INT) END AS high FROM part",
)
def voi_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = D.voi_range(S() % 5 == 0, S() % 3 == 0, K() % 2 == 0, (F.lit(-2048), F.lit(2047)), (S() * -1.5, S() * 2.5))
    return _parts(spark, sf_dir, low=low, high=high)


@query(
    "overlay_mask",
    "WITH m AS (SELECT p_partkey, 7 + p_size % 9 AS high, 6 + p_partkey % 9 AS stored, CASE WHEN p_size % 4 = 0 THEN 8 ELSE 16 END AS cell FROM part) SELECT p_partkey, CASE WHEN stored >= cell THEN (1 << cell) - 1 WHEN high + 1 > stored THEN (1 << (high + 1)) - (1 << (high + 1 - stored)) ELSE (1 << (high + 1)) - 1 END AS mask FROM m",
)
def overlay_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, mask=D.overlay_mask(7 + S() % 9, 6 + K() % 9, F.when(S() % 4 == 0, 8).otherwise(16)))


@query(
    "overlay_groups",
    "SELECT p_partkey, CASE WHEN p_size % 3 > 0 AND p_size % 16 >= 10 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 0 END AS embedded, bit_count(CAST(p_partkey % 65536 AS BIGINT)) AS active FROM part",
)
def overlay_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays inside the pixels, and those that a mask turns on."""
    group = lambda cell, bit: F.struct(cell.alias("bits_allocated"), bit.alias("bit_position"))
    groups = F.array(group(F.when(S() % 3 > 0, 16).otherwise(1), S() % 16), group(F.when(K() % 2 == 1, 16), F.lit(12)))
    active = F.size(D.active_groups((K() % 65536).cast("int")))
    return _parts(spark, sf_dir, embedded=F.size(D.embedded_overlays(groups, F.lit(10))), active=active)


@query(
    "overlay_pixels",
    """WITH g AS (SELECT p_partkey, p_name, y, x, f FROM part, range(0, 8) a(y), range(0, 12) b(x), range(0, 4) c(f)), i AS (SELECT *, 32 * (f - 1) + (y - 1) * 8 + (x - 2) AS i FROM g WHERE f BETWEEN 1 AND 2 AND y BETWEEN 1 AND 4 AND x BETWEEN 2 AND 9)
       SELECT p_partkey, f::BIGINT AS frame, count(*) AS covered FROM i WHERE i // 8 < length(p_name) AND (ascii(p_name[CAST(i // 8 AS INT) + 1]) >> CAST(i % 8 AS INT)) & 1 = 1 GROUP BY ALL""",
)
def overlay_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each frame under an overlay of 4 x 8 at row 2 and column 3, for two frames from the second."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").cast("binary").alias("data"))
    for name, n in (("frame", 4), ("y", 8), ("x", 12)):
        p = p.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    on = D.overlay_pixel(F.col("data"), F.lit(4), F.lit(8), F.lit(2), F.lit(3), F.col("y"), F.col("x"), F.col("frame"), F.lit(2), F.lit(2))
    return p.where(on).groupBy("p_partkey", "frame").agg(F.count(F.lit(1)).alias("covered"))


@query(
    "float_window",
    f"SELECT vec_id, CAST(sum(v) AS BIGINT) AS total FROM (SELECT vec_id, greatest(0.0, least(255.0, round_even((px / 1000.0::DOUBLE) * 170.0::DOUBLE + (255.0::DOUBLE - 170.0::DOUBLE * 1.0), 0))) AS v FROM {_PIXELS_SQL}) GROUP BY 1",
)
def float_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pixels(spark, sf_dir).withColumn("v", D.float_window(F.col("px") / 1000.0, F.lit(1.5), F.lit(0.25)))
    return got.groupBy("vec_id").agg(F.sum("v").alias("total"))


@query(
    "turns_to_float",
    """WITH m AS (SELECT p_partkey, p_size, -p_size AS lo, p_partkey % 300 AS hi, ([1.0, 0.4, 2.0, NULL])[CAST(p_size % 4 AS INT) + 1]::DOUBLE AS s FROM part), r AS (SELECT *, lo * s - 5 AS a, hi * s - 5 AS b FROM m), e AS (SELECT *, least(a, b) AS least, greatest(a, b) AS most FROM r)
       SELECT p_partkey, p_size % 11 = 0 OR (s IS NOT NULL AND (s < 0.5 OR least + 1 < CASE WHEN least < 0 OR p_size % 2 = 0 THEN -128 ELSE 0 END OR most - 1 > CASE WHEN least < 0 OR p_size % 2 = 0 THEN 127 ELSE 255 END)) AS floating FROM e""",
)
def turns_to_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    slope = F.element_at(F.array(*map(F.lit, [1.0, 0.4, 2.0, None])), (S() % 4).cast("int") + 1)
    return _parts(spark, sf_dir, floating=D.turns_to_float(-S(), K() % 300, slope, F.lit(-5.0), F.lit(8), S() % 2 == 0, S() % 11 == 0))


_BYTE = "greatest(0, least(255, {0}))"


@query(
    "display_colour",
    f"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN concat_ws(',', {_BYTE.format('p_partkey - 50')}, {_BYTE.format('p_size * 9')}, 7, 255) WHEN 1 THEN concat_ws(',', 1, 2, 3, {_BYTE.format('p_partkey % 400')})
        ELSE concat_ws(',', (p_partkey * 37 % 65536) // 256, (p_partkey * 37 % 65536) // 256, (p_partkey * 37 % 65536) // 256, 255) END AS rgba FROM part""",
)
def display_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of three and of four values, and grays."""
    k, s = K().cast("int"), S()
    given = F.when(s % 3 == 0, F.array(k - 50, s * 9, F.lit(7))).when(s % 3 == 1, F.array(F.lit(1), F.lit(2), F.lit(3), k % 400))
    return _parts(spark, sf_dir, rgba=F.array_join(D.colour((K() * 37 % 65536).cast("int"), given).cast("array<string>"), ","))


@query(
    "shutter_shapes",
    """WITH g AS (SELECT p_partkey, p_size, y + 0.3 AS y, x + 0.3 AS x FROM part, range(0, 20) a(y), range(0, 20) b(x)) SELECT p_partkey, count(*) AS inside FROM g
       WHERE (p_size % 4 = 0 OR (x >= 2 AND x < 18 AND y >= 1 AND y < 15)) AND (p_size % 5 = 0 OR power(x - 9, 2) + power(y - 8, 2) < power(p_size % 5 * 3, 2)) AND (p_size % 6 < 3 OR x + 3 * y < 3 * (p_size % 6)) GROUP BY 1""",
)
def shutter_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places inside rectangular, circular and polygonal shutters; those without an area don't count."""
    s, point = F.col("p_size"), lambda r, c: F.struct(r.alias("row"), c.alias("column"))
    side = F.when(s % 6 >= 3, s % 6).otherwise(0)
    rectangle = F.struct(F.lit(18).alias("left"), F.lit(15).alias("top"), F.when(s % 4 == 0, 18).otherwise(2).alias("right"), F.lit(1).alias("bottom"))
    circle = F.struct(F.lit(8).alias("row"), F.lit(9).alias("column"), (s % 5 * 3).alias("radius"))
    polygon = F.array(point(F.lit(0), F.lit(0)), point(F.lit(0), 3 * side), point(side, F.lit(0)))
    line = F.explode(F.sequence(F.lit(0), F.lit(19)))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    p = p.repartition(partitions(p, 20_000), "p_partkey")  # a row becomes 400 places, so a small file is work for many tasks
    p = p.select("p_partkey", "p_size", polygon.alias("polygon"), line.alias("y")).withColumn("y", F.col("y") + 0.3)
    p = p.withColumn("crossings", D.polygon_crossings(F.col("polygon"), F.col("y"))).drop("polygon")
    p = p.withColumn("x", line).withColumn("x", F.col("x") + 0.3)
    return p.where(D.shutter_contains(F.col("y"), F.col("x"), rectangle, circle, crossings=F.col("crossings"))).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("inside"))


_STORED = f"(SELECT vec_id, x, abs(px) % 4096 + CASE WHEN x % 5 = 0 THEN 4096 ELSE 0 END AS px FROM {_PIXELS_SQL})"
_REAL = "greatest(-4096, least(4095, (px & 4095) * 2 - 1000))"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of 12 bits with an overlay in the bit above."""
    over = F.when(F.col("x") % 5 == 0, 4096).otherwise(0)
    return pixels(spark, sf_dir).withColumn("px", F.abs("px") % 4096 + over)


@query("render_raw", f"SELECT vec_id, CAST(sum({_REAL}) AS BIGINT) AS total, min({_REAL}) AS low, max({_REAL}) AS high FROM {_STORED} GROUP BY 1")
def render_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real values: overlay bits off, then the modality step."""
    mask = D.overlay_mask(F.lit(11), F.lit(12), F.lit(16))
    got = stored(spark, sf_dir).withColumn("v", L.rescale(F.col("px").bitwiseAND(mask), 2.0, -1000.0, 13, True))
    return got.groupBy("vec_id").agg(F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))


_SHOWN = f"trunc(greatest(0.0::DOUBLE, least(255.0::DOUBLE, {_REAL} * (255.0::DOUBLE / 400.0::DOUBLE) + (255.0::DOUBLE - 255.0::DOUBLE / 400.0::DOUBLE * (50.0::DOUBLE + 200.0::DOUBLE)))))"


@query(
    "render_default",
    f"SELECT vec_id, CAST(sum(v) AS BIGINT) AS total, count(*) FILTER (v = 255) AS white FROM (SELECT vec_id, CASE WHEN x % 5 = 0 THEN 255 WHEN vec_id % 2 = 0 THEN 255 - {_SHOWN} ELSE {_SHOWN} END AS v FROM {_STORED}) GROUP BY 1",
)
def render_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: overlay bits off, rescaled, windowed, inverted where the photometric model asks for it, overlays on top."""
    mask = D.overlay_mask(F.lit(11), F.lit(12), F.lit(16))
    overlay = F.getbit(F.col("px"), F.lit(12)) == 1
    v = D.rendered(F.col("px"), mask, F.lit(2.0), F.lit(-1000.0), 13, True, F.lit(400.0), F.lit(50.0), F.col("vec_id") % 2 == 0, overlay)
    got = stored(spark, sf_dir).withColumn("v", v)
    return got.groupBy("vec_id").agg(F.sum("v").alias("total"), F.count(F.when(F.col("v") == 255, 1)).alias("white"))


# The SQL has its own copy of the fixed values, so that a slip in either shows.
_LIN = "CASE WHEN {0} <= 0.0404482362771076::DOUBLE THEN {0} / 12.92::DOUBLE ELSE pow(({0} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
_FOLD = "CASE WHEN {0} > 8.85645167903563082e-3::DOUBLE THEN pow({0}, 1.0::DOUBLE / 3.0::DOUBLE) ELSE 841.0::DOUBLE / 108.0::DOUBLE * {0} + 4.0::DOUBLE / 29.0::DOUBLE END"
_UNFOLD = "CASE WHEN {0} > 0.206896551724137931::DOUBLE THEN {0} * {0} * {0} ELSE 108.0::DOUBLE / 841.0::DOUBLE * ({0} - 4.0::DOUBLE / 29.0::DOUBLE) END"
_CURVE = "CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN {0} <= 0.0031306684425005883::DOUBLE THEN 12.92::DOUBLE * {0} ELSE 1.055::DOUBLE * pow({0}, 1.0::DOUBLE / 2.4::DOUBLE) - 0.055::DOUBLE END)) * 255.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


@query(
    "rgb_lab_values",
    f"""WITH c AS (SELECT p_partkey, (p_partkey % 256)::DOUBLE / 255 AS r, (p_partkey * 7 % 256)::DOUBLE / 255 AS g, (p_partkey * 31 % 256)::DOUBLE / 255 AS b FROM part), l AS (SELECT p_partkey, {_LIN.format('r')} AS r, {_LIN.format('g')} AS g, {_LIN.format('b')} AS b FROM c),
        x AS (SELECT p_partkey, (0.4123955889674142161::DOUBLE * r + 0.3575834307637148171::DOUBLE * g + 0.1804926473817015735::DOUBLE * b) / 0.950456::DOUBLE AS x, 0.2125862307855955516::DOUBLE * r + 0.7151703037034108499::DOUBLE * g + 0.07220049864333622685::DOUBLE * b AS y,
          (0.01929721549174694484::DOUBLE * r + 0.1191838645808485318::DOUBLE * g + 0.9504971251315797660::DOUBLE * b) / 1.088754::DOUBLE AS z FROM l), f AS (SELECT p_partkey, {_FOLD.format('x')} AS x, {_FOLD.format('y')} AS y, {_FOLD.format('z')} AS z FROM x)
        SELECT p_partkey, CAST(greatest(0, least(65535, floor((116.0::DOUBLE * y - 16.0::DOUBLE) * (65535.0::DOUBLE / 100) + 0.5::DOUBLE))) AS BIGINT) AS l, CAST(greatest(0, least(65535, floor((500.0::DOUBLE * (x - y) + 128.0::DOUBLE) * (65535.0::DOUBLE / 255) + 0.5::DOUBLE))) AS BIGINT) AS a,
          CAST(greatest(0, least(65535, floor((200.0::DOUBLE * (y - z) + 128.0::DOUBLE) * (65535.0::DOUBLE / 255) + 0.5::DOUBLE))) AS BIGINT) AS b FROM f""",
)
def rgb_lab_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours as coded CIELab."""
    lab = L.rgb_to_lab(*((K() * k % 256).cast("double") for k in (1, 7, 31)))
    return _parts(spark, sf_dir, l=lab[0], a=lab[1], b=lab[2])


@query(
    "lab_rgb_values",
    f"""WITH c AS (SELECT p_partkey, (p_partkey * 977 % 65536)::DOUBLE * 100 / 65535 AS l, (p_partkey * 7919 % 65536)::DOUBLE * 255 / 65535 - 128 AS a, (p_partkey * 104729 % 65536)::DOUBLE * 255 / 65535 - 128 AS b FROM part),
        f AS (SELECT p_partkey, (l + 16) / 116 AS y, (l + 16) / 116 + a / 500 AS x, (l + 16) / 116 - b / 200 AS z FROM c),
        x AS (SELECT p_partkey, 0.950456::DOUBLE * ({_UNFOLD.format('x')}) AS x, {_UNFOLD.format('y')} AS y, 1.088754::DOUBLE * ({_UNFOLD.format('z')}) AS z FROM f),
        m AS (SELECT p_partkey, 3.2406::DOUBLE * x - 1.5372::DOUBLE * y - 0.4986::DOUBLE * z AS r, -0.9689::DOUBLE * x + 1.8758::DOUBLE * y + 0.0415::DOUBLE * z AS g, 0.0557::DOUBLE * x - 0.2040::DOUBLE * y + 1.0570::DOUBLE * z AS b FROM x),
        v AS (SELECT p_partkey, r - least(0, r, g, b) AS r, g - least(0, r, g, b) AS g, b - least(0, r, g, b) AS b FROM m)
        SELECT p_partkey, {_CURVE.format('r')} AS r, {_CURVE.format('g')} AS g, {_CURVE.format('b')} AS b FROM v""",
)
def lab_rgb_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded CIELab as colours, most of them outside of what sRGB has."""
    rgb = L.lab_to_rgb(*((K() * k % 65536).cast("double") for k in (977, 7919, 104729)))
    return _parts(spark, sf_dir, r=rgb[0], g=rgb[1], b=rgb[2])


_DEPTH = "(['8U', '16U', '16S', '32S', '32F'])[CAST(p_size % 5 AS INT) + 1]"


@query(
    "tags_by_depth",
    f"""WITH d AS (SELECT p_partkey, p_size, {_DEPTH} AS depth, p_partkey % 2 = 1 AS signed, 6 + p_partkey % 12 AS compressed FROM part), c AS (SELECT *, CASE WHEN depth = '8U' THEN 8 WHEN depth IN ('16U', '16S') THEN 16 ELSE 32 END AS bits FROM d)
       SELECT p_partkey, 1 + p_size % 3 AS samples, 16 AS raw_allocated, 12 AS raw_stored, CASE WHEN p_size % 3 > 0 THEN 'RGB' ELSE 'MONOCHROME1' END AS photometric, CASE WHEN p_size % 3 > 0 THEN 0 END AS planar, CASE WHEN depth = '16S' OR signed THEN 1 ELSE 0 END AS representation,
       bits AS cell, least(compressed, bits) - 1 AS high_bit, CASE WHEN depth IN ('16S', '32S', '32F') OR (depth = '16U' AND signed) THEN 1 ELSE 0 END AS compressed_representation FROM c""",
)
def tags_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of images of every depth that are written raw and compressed."""
    descriptor = F.struct(F.lit(16).alias("bits_allocated"), F.lit(12).alias("bits_stored"), (6 + K() % 12).cast("int").alias("bits_compressed"), F.lit("MONOCHROME1").alias("photometric"))
    channels, signed = 1 + S() % 3, K() % 2 == 1
    depth = F.get(F.array(*map(F.lit, D.DEPTHS)), (S() % 5).cast("int"))
    t = _parts(spark, sf_dir, raw=D.raw_tags(F.lit(64), F.lit(32), channels, depth, signed, descriptor), packed=D.compressed_tags(F.lit(64), F.lit(32), channels, depth, signed, descriptor))
    names = {"raw.samples": "samples", "raw.bits_allocated": "raw_allocated", "raw.bits_stored": "raw_stored", "raw.photometric": "photometric", "raw.planar": "planar", "raw.representation": "representation"}
    names |= {"packed.bits_allocated": "cell", "packed.high_bit": "high_bit", "packed.representation": "compressed_representation"}
    return t.select("p_partkey", *(F.col(c).alias(n) for c, n in names.items()))


@query(
    "adapted_tags",
    """SELECT p_partkey, 1 + p_size % 3 AS samples, 16 AS raw_allocated, 12 AS raw_stored, CASE WHEN p_size % 3 > 0 THEN 'RGB' ELSE 'MONOCHROME1' END AS photometric, CASE WHEN p_size % 3 > 0 THEN 0 END AS planar, p_partkey % 2 AS representation,
       CASE WHEN p_size % 2 = 0 THEN 8 ELSE 16 END AS cell, CASE WHEN p_size % 2 = 0 THEN 7 ELSE 11 END AS high_bit, CASE WHEN p_size % 2 = 1 THEN p_partkey % 2 ELSE 0 END AS compressed_representation FROM part""",
)
def adapted_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of images that are written raw and compressed."""
    descriptor = F.struct(F.lit(16).alias("bits_allocated"), F.lit(12).alias("bits_stored"), F.lit(12).alias("bits_compressed"), F.lit("MONOCHROME1").alias("photometric"))
    channels, signed = 1 + S() % 3, K() % 2 == 1
    t = _parts(spark, sf_dir, raw=D.raw_tags(F.lit(64), F.lit(32), channels, F.lit("16U"), signed, descriptor), packed=D.compressed_tags(F.lit(64), F.lit(32), channels, F.when(S() % 2 == 0, "8U").otherwise("16U"), signed, descriptor))
    names = {"raw.samples": "samples", "raw.bits_allocated": "raw_allocated", "raw.bits_stored": "raw_stored", "raw.photometric": "photometric", "raw.planar": "planar", "raw.representation": "representation"}
    names |= {"packed.bits_allocated": "cell", "packed.high_bit": "high_bit", "packed.representation": "compressed_representation"}
    return t.select("p_partkey", *(F.col(c).alias(n) for c, n in names.items()))


_GRID = f"(SELECT vec_id // 16 AS image, vec_id % 16 AS y, x, px FROM {_PIXELS_SQL})"


@query(
    "mask_blur",
    f"""WITH a AS (SELECT image, y, x, sum(px) OVER w AS s, count(*) OVER w AS n FROM {_GRID} WINDOW w AS (PARTITION BY image, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
        b AS (SELECT image, y, x, sum(s) OVER w / sum(n) OVER w AS v FROM a WINDOW w AS (PARTITION BY image, x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING))
        SELECT image, round(sum(CASE WHEN x BETWEEN 8 AND 23 AND y < 8 THEN v ELSE p.px END), 6) AS total FROM b JOIN {_GRID} p USING (image, y, x) GROUP BY 1""",
)
def mask_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles without a colour are blurred over 7 x 7 pixels; the rest of the image stays."""
    p = pixels(spark, sf_dir).select(F.floor(F.col("vec_id") / 16).alias("image"), (F.col("vec_id") % 16).alias("y"), "x", F.col("px"), F.col("px").cast("double").alias("v"))
    b = D.box_blur(p, "image", "y", "x", "v")
    shown = F.when(D.in_rectangle(F.col("y"), F.col("x"), 0, 8, 8, 16), F.col("v")).otherwise(F.col("px"))
    return b.groupBy("image").agg(F.round(F.sum(shown), 6).alias("total"))


_W = "((v - 1500.0::DOUBLE) / 4000.0::DOUBLE)"
_UNIT = "greatest(0, least(255, floor(255.0::DOUBLE * (({0}) - ({1})) / (({2}) - ({1})) + 0.5)))"
_LINE = "trunc(greatest(0.0::DOUBLE, least(255.0::DOUBLE, v * (255.0::DOUBLE / 4000) + (255.0::DOUBLE - 255.0::DOUBLE / 4000 * (1500.0::DOUBLE + 2000)))))"
_ALONG = "(CASE WHEN v <= -500 THEN 0.0::DOUBLE WHEN v > 3500 THEN 4.0::DOUBLE ELSE (v + 500) * (4.0::DOUBLE / 4000) END)"
_ON = "([20, 30, 60, 180, 220])[CAST({0} AS INT) + 1]"


@query(
    "render_states",
    f"""WITH m AS (SELECT vec_id, vec_id % 12 AS k, CASE WHEN vec_id % 12 = 8 THEN px & 8190 ELSE px & 4095 END AS px FROM {_STORED}),
        r AS (SELECT vec_id, k, CASE WHEN k IN (9, 11) THEN px WHEN k = 10 THEN px * 7 % 4096 WHEN k = 7 AND px BETWEEN 1000 AND 2000 THEN 4095 WHEN k = 8 THEN greatest(-4096, least(4095, CAST(floor(least(px, 4095) * 1.0::DOUBLE - 1000 + 0.5) AS BIGINT))) ELSE greatest(-4096, least(4095, px * 2 - 1000)) END AS v FROM m),
        s AS (SELECT vec_id, k, v, CASE k WHEN 2 THEN greatest(0, least(255, floor(255.0::DOUBLE / (1 + exp(-4 * {_W})) + 0.5))) WHEN 3 THEN {_UNIT.format(f"1 / (1 + exp(-4 * {_W}))", "1 / (1 + exp(2.0::DOUBLE))", "1 / (1 + exp(-2.0::DOUBLE))")}
          WHEN 4 THEN CASE WHEN 1 + {_W} <= 0 THEN 0 ELSE {_UNIT.format(f"ln(CASE WHEN 1 + {_W} > 0 THEN 2 * (1 + {_W}) ELSE 1 END)", "ln(1.0::DOUBLE)", "ln(3.0::DOUBLE)")} END WHEN 5 THEN {_UNIT.format(f"exp(2 * {_W})", "exp(-1.0::DOUBLE)", "exp(1.0::DOUBLE)")}
          WHEN 6 THEN least(255, floor(floor({_ON.format(f"floor({_ALONG})")} + ({_ALONG} - floor({_ALONG})) * ({_ON.format(f"ceil({_ALONG})")} - {_ON.format(f"floor({_ALONG})")}) + 0.5) * (255.0::DOUBLE / 200) + 0.5)) WHEN 11 THEN (4095 - v) // 16 ELSE {_LINE} END AS w FROM r)
        SELECT vec_id, CAST(sum(v) AS BIGINT) AS real, CAST(sum(CASE WHEN k IN (1, 7) THEN 255 - w ELSE w END) AS BIGINT) AS total FROM s GROUP BY 1""",
)
def render_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of twelve kinds through one table of look-up tables: all shapes of windows, padding, tables of the modality and of a presentation state, pixels above an overlay bit."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    k = F.col("vec_id") % 12
    flat = k.isin(9, 10, 11)
    shapes = F.array(*(F.lit(x) for x in ("LINEAR", "LINEAR", "SIGMOID", "SIGMOID_NORM", "LOG", "LOG_INV", "SEQUENCE", "LINEAR", "LINEAR", "LINEAR", "LINEAR", "LINEAR")))
    images = e.select(
        "vec_id", F.lit(16).alias("bits_allocated"), F.lit(12).alias("bits_stored"), F.when(k == 8, 12).otherwise(11).alias("high_bit"), F.lit(True).alias("embedded"), F.lit(0).alias("low"), F.when(k == 8, 8190).otherwise(4095).alias("high"),
        F.when(k.isin(1, 7), "MONOCHROME1").otherwise("MONOCHROME2").alias("photometric"), F.when(flat, 1.0).otherwise(2.0).alias("slope"), F.when(flat, 0.0).otherwise(-1000.0).alias("intercept"),
        F.when(k == 7, 1000).alias("padding"), F.when(k == 7, 2000).alias("padding_limit"), F.when(k == 10, F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: i * 7 % 4096)).alias("modality_table"),
        F.when(k == 11, F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.floor((4095 - i) / 16).cast("int"))).alias("state_table"), F.get(shapes, k.cast("int")).alias("shape"),
        F.when(k == 6, F.array(*(F.lit(float(x)) for x in (20, 30, 60, 180, 220)))).alias("points"), F.lit(4000.0).alias("window"), F.lit(1500.0).alias("level"),
    )
    got = R.render(stored(spark, sf_dir), images, "vec_id", "px", ["x"])
    return got.groupBy("vec_id").agg(F.sum("real").alias("real"), F.sum("shown").alias("total"))


@query(
    "mask_polygon",
    f"""WITH p AS (SELECT image, y, x, px, 2 + image % 5 AS a, 12 + image % 20 AS b FROM {_GRID}), c AS (SELECT *, [[1, a], [4 + a, b], [14, 3 * a], [9, 1]] AS q FROM p), e AS (SELECT c.*, k, q[k] AS u, q[k % 4 + 1] AS w FROM c, range(1, 5) r(k)),
        h AS (SELECT image, y, x, px, sum(CASE WHEN (u[1] <= y) <> (w[1] <= y) AND x >= u[2] + (y - u[1]) * (w[2] - u[2])::DOUBLE / (w[1] - u[1]) THEN 1 ELSE 0 END) AS crossed,
          max(CASE WHEN (abs(w[1] - u[1]) >= abs(w[2] - u[2]) AND y BETWEEN least(u[1], w[1]) AND greatest(u[1], w[1]) AND x = floor(u[2] + (y - u[1]) * (w[2] - u[2])::DOUBLE / (w[1] - u[1]) + 0.5))
            OR (abs(w[1] - u[1]) < abs(w[2] - u[2]) AND x BETWEEN least(u[2], w[2]) AND greatest(u[2], w[2]) AND y = floor(u[1] + (x - u[2]) * (w[1] - u[1])::DOUBLE / (w[2] - u[2]) + 0.5)) THEN 1 ELSE 0 END) AS edge FROM e GROUP BY ALL)
        SELECT image, count(*) FILTER (crossed % 2 = 1 OR edge = 1) AS covered, CAST(sum(CASE WHEN crossed % 2 = 1 OR edge = 1 THEN 9999 ELSE px END) AS BIGINT) AS total FROM h GROUP BY 1""",
)
def mask_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled polygons with their edges, by spans of rows."""
    p = pixels(spark, sf_dir).select(F.floor(F.col("vec_id") / 16).alias("image"), (F.col("vec_id") % 16).alias("y"), "x", "px")
    i = F.col("image")
    a, b = 2 + i % 5, 12 + i % 20
    point = lambda y, x: F.struct(y.cast("long").alias("row"), x.cast("long").alias("column"))
    shapes = p.select("image").distinct().withColumn("points", F.array(point(F.lit(1), a), point(4 + a, b), point(F.lit(14), 3 * a), point(F.lit(9), F.lit(1))))
    got = P.filled(p, "image", "y", "x", "px", shapes, "points", 9999)
    return got.groupBy("image").agg(F.count(F.when(F.col("px") == 9999, 1)).alias("covered"), F.sum("px").alias("total"))


@query(
    "mask_blur_mirrored",
    f"""WITH r AS (SELECT image, y, x, px, (SELECT max(y) FROM {_GRID} g WHERE g.image = p.image) AS bottom FROM {_GRID} p), n AS (SELECT *, least(bottom, 7) AS b FROM r), i AS (SELECT * FROM n WHERE y <= b AND b >= 2 AND x BETWEEN 50 AND 63),
        m AS (SELECT i.image, i.y, i.x, b, CASE WHEN (i.y + dy + 2 * b) % (2 * b) > b THEN 2 * b - (i.y + dy + 2 * b) % (2 * b) ELSE (i.y + dy + 2 * b) % (2 * b) END AS yy, CASE WHEN (i.x - 50 + dx + 26) % 26 > 13 THEN 26 - (i.x - 50 + dx + 26) % 26 ELSE (i.x - 50 + dx + 26) % 26 END + 50 AS xx FROM i, range(-3, 4) u(dy), range(-3, 4) v(dx)),
        w AS (SELECT m.image, m.y, m.x, round_even(sum(i.px) / 49.0::DOUBLE, 0) AS v FROM m JOIN i ON i.image = m.image AND i.y = m.yy AND i.x = m.xx GROUP BY 1, 2, 3)
        SELECT r.image, CAST(sum(coalesce(w.v, r.px)) AS BIGINT) AS total FROM r LEFT JOIN w ON w.image = r.image AND w.y = r.y AND w.x = r.x GROUP BY 1""",
)
def mask_blur_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle at the image's edge blurred by itself: clipped, mirrored at its edges, rounded."""
    p = pixels(spark, sf_dir).select(F.floor(F.col("vec_id") / 16).alias("image"), (F.col("vec_id") % 16).alias("y"), "x", "px")
    got = D.rectangle_blur(p, "image", "y", "x", "px", -4, 50, 12, 40)
    return got.groupBy("image").agg(F.sum("px").alias("total"))


@query(
    "state_choice",
    """WITH f AS (SELECT l_orderkey AS series, l_linenumber AS instance, fr AS frame FROM lineitem, range(1, 4) r(fr)),
       r AS (SELECT 's' || o_custkey % 40 AS state, o_orderkey AS series, NULL::BIGINT AS instance, NULL AS frames FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT 's' || l_partkey % 40, l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN [2, 3, 2] END FROM lineitem WHERE l_partkey % 2 = 0
             UNION ALL SELECT 's' || l_suppkey % 40, l_orderkey, l_linenumber, [l_suppkey % 3 + 1] FROM lineitem WHERE l_suppkey % 5 = 0),
       a AS (SELECT f.series, f.instance, f.frame, state, max(CASE WHEN r.instance IS NULL THEN 0 WHEN frames IS NULL THEN 1 ELSE 2 END) AS depth FROM f JOIN r ON r.series = f.series AND (r.instance IS NULL OR (r.instance = f.instance AND (frames IS NULL OR list_contains(frames, f.frame)))) GROUP BY ALL),
       o AS (SELECT *, row_number() OVER (PARTITION BY series, instance, frame ORDER BY depth DESC, CAST(substr(state, 2) AS INT) % 7 > 0 DESC, CAST(substr(state, 2) AS INT) % 7 DESC, state DESC) AS place, count(*) OVER (PARTITION BY series, instance, frame) AS states FROM a)
       SELECT series, instance, frame, state, depth, states FROM o WHERE place = 1""",
)
def state_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which presentation state holds for each frame: states name whole series, images and frames, and ties go to the newest."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    frames = lines.select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("instance"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("frame"))
    name = lambda c: F.concat(F.lit("s"), F.col(c) % 40)
    none = F.lit(None).cast("array<int>")
    whole = orders.where("o_custkey % 3 = 0").select(name("o_custkey").alias("state"), F.col("o_orderkey").alias("series"), F.lit(None).cast("long").alias("instance"), none.alias("frames"))
    some = lines.where("l_partkey % 2 = 0").select(name("l_partkey").alias("state"), F.col("l_orderkey").alias("series"), F.col("l_linenumber").cast("long").alias("instance"), F.when(F.col("l_suppkey") % 2 == 0, F.array(*map(F.lit, (2, 3, 2)))).alias("frames"))
    one = lines.where("l_suppkey % 5 = 0").select(name("l_suppkey").alias("state"), F.col("l_orderkey").alias("series"), F.col("l_linenumber").cast("long").alias("instance"), F.array((F.col("l_suppkey") % 3 + 1).cast("int")).alias("frames"))
    refs = whole.unionByName(some).unionByName(one)
    number = F.substring("state", 2, 9).cast("int")
    states = refs.select("state").distinct().withColumn("created", F.when(number % 7 > 0, number % 7))
    return P.chosen(frames, refs, states)


@query(
    "preset_list_all",
    """WITH w AS (SELECT p_partkey, p_size, i, CASE WHEN i = 3 THEN NULL WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' || i END AS e, (100 + p_size * (i % 2))::DOUBLE AS w FROM part, range(0, 4) r(i) WHERE p_partkey % 3 > 0),
       d AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, e, w ORDER BY i) AS again FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS n FROM d WHERE e IS NULL OR again = 1),
       l AS (SELECT p_partkey, n AS place, coalesce(e, 'Default ' || n) || ' [S]=' || CAST(w AS INT) || '/40' AS t, n FROM k UNION ALL
             SELECT p_partkey, 10 + i, CASE WHEN i = 0 THEN 'VOI LUT 0' ELSE 'T' END || ' [S]=' || (p_size + i * 2) || '/' || CAST(floor(10 * i + (p_size + i * 2) / 2.0) AS INT), coalesce((SELECT max(n) FROM k WHERE k.p_partkey = part.p_partkey), 0) + i + 1 FROM part, range(0, 2) r(i) WHERE p_size % 3 = 0 UNION ALL
             SELECT p_partkey, 20, 'Auto Level [Image]=' || (p_size * 10) || '/' || (p_size * 5), NULL FROM part UNION ALL
             SELECT p.p_partkey, 30, n_name || '=' || (100 + n_nationkey) || '/' || n_regionkey, NULL FROM part p JOIN nation ON n_regionkey = p.p_size % 7 WHERE p.p_size > 8)
       SELECT p_partkey, string_agg(t || CASE WHEN n IS NOT NULL AND n < 3 THEN '#' || n ELSE '' END, ';' ORDER BY place, split_part(t, '=', 1)) AS presets FROM l GROUP BY 1""",
)
def preset_list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole preset lists: windows, tables, the image's range and its modality's presets, which are read from an XML file that is written first."""
    place = shared_folder(spark, "presets")
    n = table(spark, sf_dir, "nation")
    given = n.select(F.col("n_regionkey").cast("string").alias("_modality"), F.col("n_name").alias("_name"), (100.0 + F.col("n_nationkey")).alias("_window"), F.col("n_regionkey").cast("double").alias("_level"), F.lit("LINEAR").alias("_shape"))
    given.write.format("xml").option("rootTag", "presets").option("rowTag", "preset").option("attributePrefix", "_").save(place)
    by_modality = P.presets_of_modalities(tables.window_presets(spark, place))
    index = F.array(*map(F.lit, range(4)))
    windows = F.when(K() % 3 > 0, F.transform(index, lambda i: F.struct((100 + S() * (i % 2)).cast("double").alias("width"), F.lit(40.0).alias("center"), F.when(i < 3, F.when(S() % 2 == 0, "A").otherwise(F.concat(F.lit("B"), i.cast("string")))).alias("explanation"))))
    luts = F.when(S() % 3 == 0, F.transform(F.slice(index, 1, 2), lambda i: F.struct((10 * i).alias("low"), (10 * i + S() + i * 2).cast("int").alias("high"), F.when(i > 0, "T").alias("explanation"))))
    part = table(spark, sf_dir, "part").withColumn("modality", (S() % 7).cast("string")).join(by_modality, "modality", "left")
    auto = F.struct((S() * 10).alias("width"), (S() * 5).alias("center"))
    whole = P.preset_list(windows, luts, F.lit("LINEAR"), auto, "[S]", F.col("presets"), S())
    shown = F.transform(whole, lambda p: F.concat(p["name"], F.lit("="), p["width"].cast("int"), F.lit("/"), F.floor(p["center"]).cast("int"), F.when(p["key"] > 0, F.concat(F.lit("#"), p["key"])).otherwise("")))
    return part.select("p_partkey", F.array_join(shown, ";").alias("presets"))


_SINC = "CASE WHEN abs({0}) < 1e-9 THEN 1.0::DOUBLE WHEN abs({0}) < 4 THEN sin(pi() * ({0})) * sin(pi() * ({0}) / 4) * 4 / (pi() * ({0}) * pi() * ({0})) ELSE 0.0::DOUBLE END"


@query(
    "scale_images",
    f"""WITH g AS (SELECT * FROM {_GRID} p WHERE image < (SELECT count(*) // 16 FROM embeddings)), s AS (SELECT DISTINCT image, 16 AS r, 64 AS c, 6 + image % 3 * 9 AS nr, 40 + image % 2 * 50 AS nc FROM g),
        z AS (SELECT r AS a, nr AS b FROM s UNION SELECT c, nc FROM s), t AS (SELECT a, b, q, (q + 0.5::DOUBLE) * a / b - 0.5::DOUBLE AS p FROM z, range(0, 90) u(q) WHERE q < b), k AS (SELECT a, b, q, greatest(0, least(a - 1, CAST(floor(p) AS BIGINT) + d)) AS o, {_SINC.format("p - floor(p) - d")} AS w FROM t, range(-3, 5) u(d)),
        n AS (SELECT a, b, q, o, sum(w) / (SELECT sum(w) FROM k j WHERE j.a = k.a AND j.b = k.b AND j.q = k.q) AS w FROM k GROUP BY a, b, q, o),
        l AS (SELECT g.image, nr, r, y, q AS nx, sum(px * w) AS v FROM g JOIN s ON s.image = g.image JOIN n ON n.a = c AND n.b = nc AND n.o = x GROUP BY ALL), m AS (SELECT image, q AS ny, nx, sum(v * w) AS v FROM l JOIN n ON n.a = r AND n.b = nr AND n.o = y GROUP BY ALL)
        SELECT image, count(*) AS pixels, CAST(sum(greatest(-3000, least(3000, floor(round(v, 6) + 0.5)))) AS BIGINT) AS total FROM m GROUP BY 1""",
)
def scale_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images brought to other sizes, smaller and larger, by a windowed sinc."""
    p = pixels(spark, sf_dir).select(F.floor(F.col("vec_id") / 16).alias("image"), (F.col("vec_id") % 16).alias("y"), "x", "px")
    full = F.floor(F.lit(1) * table(spark, sf_dir, "embeddings").count() / 16)
    p = p.where(F.col("image") < full)  # the last one may have fewer lines
    i = F.col("image")
    images = p.select("image").distinct().select("image", F.lit(16).alias("rows"), F.lit(64).alias("columns"), (6 + i % 3 * 9).alias("new_rows"), (40 + i % 2 * 50).alias("new_columns"))
    got = scaled(p, images, "image", "y", "x", "px", -3000, 3000)
    return got.groupBy("image").agg(F.count(F.lit(1)).alias("pixels"), F.sum("px").alias("total"))
