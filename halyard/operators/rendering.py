"""The way from stored pixels to shown ones for images of many kinds, through one table of look-up tables.

Images that share their parameters share a table: distinct parameters are keyed, each key's table is built once from the same column expressions
that would compute a single pixel, and pixels meet it by (key, stored value). A table has at most 65,536 rows, as it is built for cells of 16 bits at
most; pixels of wider cells are computed one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions import display as D
from halyard.functions import lut as L

#: What an image says about its pixels, with types and what holds where a table of images has no such column.
PARAMETERS: dict[str, tuple[str, object]] = {
    "bits_allocated": ("int", 16),
    "bits_stored": ("int", None),  # as allocated
    "high_bit": ("int", None),  # below what is stored
    "signed": ("boolean", False),
    "embedded": ("boolean", False),  # overlays stand in the cells, above what is stored
    "photometric": ("string", "MONOCHROME2"),
    "low": ("int", None),  # least and greatest pixel without overlays; all that can be stored if unknown
    "high": ("int", None),
    "slope": ("double", 1.0),
    "intercept": ("double", 0.0),
    "reset": ("boolean", False),  # the pixels are real values already
    "modality_table": ("array<int>", None),
    "modality_offset": ("int", 0),
    "modality_bits": ("int", 16),
    "padding": ("int", None),
    "padding_limit": ("int", None),
    "apply_padding": ("boolean", True),
    "inverse_action": ("boolean", False),
    "shape": ("string", "LINEAR"),  # LINEAR, SIGMOID, SIGMOID_NORM, LOG, LOG_INV, SEQUENCE
    "points": ("array<double>", None),  # of a sequence
    "window": ("double", None),
    "level": ("double", None),
    "fill_outside": ("boolean", False),
    "state_shape": ("string", None),  # a presentation state's shape, before that of the photometric interpretation
    "state_table": ("array<int>", None),  # a presentation state's table, from 0
}


def with_parameters(images: DataFrame) -> DataFrame:
    """The images with all parameters: what they lack has its default."""
    have = set(images.columns)
    full = [F.coalesce(F.col(n).cast(t), F.lit(v).cast(t)).alias(n) if n in have else F.lit(v).cast(t).alias(n) for n, (t, v) in PARAMETERS.items()]
    out = images.select(*(c for c in images.columns if c not in PARAMETERS), *full)
    stored = F.coalesce("bits_stored", "bits_allocated")
    out = out.withColumn("bits_stored", stored).withColumn("high_bit", F.coalesce("high_bit", F.col("bits_stored") - 1))
    low, high = _depth(F.col("bits_stored"), F.col("signed"))
    return out.withColumn("low", F.coalesce("low", low.cast("int"))).withColumn("high", F.coalesce("high", high.cast("int")))


def _depth(bits: Column, signed: Column) -> tuple[Column, Column]:
    bits = F.greatest(F.lit(1), F.least(F.lit(16), bits))
    half, full = F.pow(F.lit(2.0), bits - 1).cast("long"), F.pow(F.lit(2.0), bits).cast("long")
    return F.when(signed, -half).otherwise(0), F.when(signed, half - 1).otherwise(full - 1)


def _entry(table: Column, at: Column) -> Column:
    """A table's entry, its first and last one beyond its ends."""
    return F.get(table, F.greatest(F.lit(0), F.least(at, F.size(table) - 1)).cast("int"))


def inverted() -> Column:
    """Whether light and dark are turned over."""
    return F.coalesce(F.col("state_shape") == "INVERSE", F.col("photometric") == "MONOCHROME1")


def _prepared(kinds: DataFrame) -> DataFrame:
    """What an image's parameters come to, computed once for each image or kind of image."""
    c = F.col
    cut = c("embedded") & (c("bits_stored") < c("bits_allocated")) & c("bits_allocated").between(8, 16)
    shift = c("high_bit") + 1 - c("bits_stored")
    first, last = _depth(c("bits_stored"), c("signed"))
    table, offset = c("modality_table"), c("modality_offset")
    out = kinds.withColumns(
        {
            "_mask": F.when(cut, D.overlay_mask(c("high_bit"), c("bits_stored"), c("bits_allocated"))),
            # where pixels stand above overlay bits, the slope is that much smaller
            "_slope": F.when(cut & (shift > 0), D.slope_below_overlay(c("slope"), shift)).otherwise(c("slope")),
            "_inverse": inverted(),
            "_first": first,
            "_last": last,
            "_mono": c("photometric").startswith("MONOCHROME"),
            "_plain": F.coalesce(table.isNotNull() & (~c("apply_padding") | c("padding").isNull()) & (c("low") >= offset) & (c("high") < offset + F.size(table)), F.lit(False)),
        }
    )
    table_bits = F.when(table.isNotNull(), F.when(c("modality_bits") <= 8, 8).otherwise(16))
    applies, bits, out_signed = D.modality_output(c("low"), c("high"), c("_slope"), c("intercept"), c("signed"), c("padding").isNotNull(), c("bits_stored"), table_bits)
    out = out.withColumns({"_applies": applies, "_bits": bits, "_out_signed": out_signed, "_turned": c("_inverse") != (c("apply_padding") & c("inverse_action"))})
    least, most = _depth(c("_bits"), c("_out_signed"))
    ends = [c("padding"), F.coalesce("padding_limit", "padding")]
    pads = c("apply_padding") & c("padding").isNotNull() & c("_mono")
    out = out.withColumns({"_least": least, "_most": most, "_pad_from": F.when(pads, F.least(*ends)), "_pad_to": F.when(pads, F.greatest(*ends))})
    edge = F.when(c("_turned"), F.when(table.isNotNull(), F.element_at(table, -1).cast("long")).otherwise(_ramp(c("_last")))).otherwise(F.when(table.isNotNull(), F.get(table, F.lit(0)).cast("long")).otherwise(_ramp(c("_first"))))
    out = out.withColumn("_fill", F.when(c("_bits") <= 8, F.when(c("_turned"), 255).otherwise(0)).otherwise(edge).cast("long"))
    cut = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))  # noqa: E731  to whole numbers towards zero
    half = F.greatest(F.lit(1.0), c("window")) / 2
    limits = [modality_step(c(e).cast("long")).cast("double") for e in ("low", "high")]
    out = out.withColumns({"_low": cut(F.least(limits[0], c("level") - half)), "_high": cut(F.greatest(limits[1], c("level") + half))})
    return out.withColumn("_whole", c("fill_outside") | (c("padding").isNotNull() & c("_mono")))


def _ramp(v: Column) -> Column:
    return L.clamp(L.half_up(v * F.col("_slope") + F.col("intercept")), F.col("_least"), F.col("_most")).cast("long")


def without_overlay(px: Column) -> Column:
    return F.when(F.col("_mask").isNotNull(), px.bitwiseAND(F.col("_mask"))).otherwise(px)


def modality_step(px: Column) -> Column:
    """A pixel without overlays through the modality step: a table whose range holds the image's pixels and that no padding forbids, else, unless nothing changes, the
    table with padding or the ramp, as deep as its output needs.
    """
    c = F.col
    table = c("modality_table")
    entry = _entry(table, px - c("modality_offset")).cast("long")
    padded = F.coalesce(px.between(c("_pad_from"), c("_pad_to")), F.lit(False))
    value = F.when(padded, c("_fill")).when(table.isNotNull(), entry).otherwise(_ramp(L.clamp(px, c("_first"), c("_last"))))
    return F.when(c("reset"), px).when(c("_plain"), entry).when(~c("_applies"), px).otherwise(value)


def window_step(v: Column) -> Column:
    """A real value as a byte by the window's shape, turned over where the image or its state says so. Values beyond the window and the image's range count as their ends, unless
    the table is to be filled for all that can be stored."""
    c = F.col
    window, level = c("window"), c("level")
    shown = (
        F.when(c("shape") == "SIGMOID", L.window_sigmoid(v, window, level, 0, 255))
        .when(c("shape") == "SIGMOID_NORM", L.window_sigmoid(v, window, level, 0, 255, normalised=True))
        .when(c("shape") == "LOG", L.window_log(v, window, level, 0, 255))
        .when(c("shape") == "LOG_INV", L.window_exponential(v, window, level, 0, 255))
        .when(c("shape") == "SEQUENCE", L.window_points(v, window, level, c("points"), 0, 255))
        .otherwise(L.window_linear(v, window, level, 0, 255))
    )
    return L.bound(shown, lambda s: F.when(c("_inverse"), 255 - s).otherwise(s))


def _shown(rows: DataFrame, stored: str) -> DataFrame:
    """Adds real and shown, step by step. A presentation state's table comes last, and then of windows only sequences count; colour images are not windowed."""
    c = F.col
    rows = rows.withColumn("real", modality_step(without_overlay(c(stored).cast("long"))))
    rows = rows.withColumn("_v", F.when(c("_whole"), c("real")).otherwise(L.clamp(c("real"), c("_low"), c("_high"))))
    rows = rows.withColumn("_windowed", window_step(c("_v")))
    by_state = _entry(c("state_table"), F.when(c("shape") == "SEQUENCE", c("_windowed")).otherwise(c("real"))).cast("long")
    return rows.withColumn("shown", F.when(~c("_mono"), c("real")).when(c("state_table").isNotNull(), by_state).otherwise(c("_windowed")))


def look_up_tables(images: DataFrame, image: str) -> tuple[DataFrame, DataFrame]:
    """((image, key, parameters), (key, stored, real, shown)): images by the key of their parameters, and one table for each key."""
    keyed = with_parameters(images).withColumn("key", F.sha2(F.to_json(F.struct(*PARAMETERS)), 256)).select(image, "key", *PARAMETERS)
    kinds = _prepared(keyed.drop(image).dropDuplicates(["key"]).where("bits_allocated <= 16"))
    low, high = _depth(F.col("bits_allocated"), F.col("signed"))
    rows = kinds.withColumn("stored", F.explode(F.sequence(low, high)))
    return keyed, _shown(rows, "stored").select("key", "stored", "real", "shown")


def render(pixels: DataFrame, images: DataFrame, image: str, value: str, keep: Sequence[str] = (), broadcast_rows: int = 2_000_000) -> DataFrame:
    """Adds ``real`` and ``shown`` to the pixels of images.

    Tables of at most ``broadcast_rows`` rows in all are broadcast; beyond that they meet the pixels in a shuffle by key and value. Images of wider cells go
    without tables.
    """
    keyed, tables = look_up_tables(images, image)
    kinds = keyed.where("bits_allocated <= 16").select("key", "bits_allocated").distinct()
    rows = kinds.agg(F.sum(F.pow(F.lit(2.0), F.col("bits_allocated")))).first()[0] or 0
    px = F.col(value).cast("long").alias("stored")
    few = pixels.select(image, *keep, px).join(keyed.where("bits_allocated <= 16").select(image, "key"), image)
    small = few.join(F.broadcast(tables) if rows <= broadcast_rows else tables, ["key", "stored"]).select(image, *keep, "stored", "real", "shown")
    wide = pixels.select(image, *keep, px).join(_prepared(keyed.where("bits_allocated > 16")), image)
    return small.unionByName(_shown(wide, "stored").select(image, *keep, "stored", "real", "shown"))
