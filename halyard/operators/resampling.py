"""Scaling of images as two joins and two sums: a table of weights for each pair of sizes, along the lines, then across them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions import lut as L

TAPS = 4  # on either side of a place


def lanczos(t: Column) -> Column:
    """sinc(t) sinc(t/4) for |t| < 4."""
    x = t * math.pi
    return F.when(F.abs(t) < 1e-9, 1.0).when(F.abs(t) < TAPS, F.sin(x) * F.sin(x / TAPS) * TAPS / (x * x)).otherwise(0.0)


def weights(sizes: DataFrame) -> DataFrame:
    """(source_size, target_size, target, source, weight) for pairs of sizes: eight neighbours of each target place, those beyond an edge counted for the edge, weights summing to one.

    A size has as many rows as eight times its targets, whatever the number of images.
    """
    at = (F.col("target") + 0.5) * F.col("source_size") / F.col("target_size") - 0.5
    rows = sizes.select("source_size", "target_size").distinct().where("source_size > 0 AND target_size > 0").withColumn("target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("target_size").cast("long") - 1))).withColumn("at", at)
    rows = rows.withColumn("tap", F.explode(F.sequence(F.floor("at") - TAPS + 1, F.floor("at") + TAPS))).withColumn("w", lanczos(F.col("at") - F.col("tap")))
    inside = F.greatest(F.lit(0), F.least(F.col("tap"), F.col("source_size") - 1)).alias("source")
    whole = rows.groupBy("source_size", "target_size", "target").agg(F.sum("w").alias("all"))
    edge = rows.groupBy("source_size", "target_size", "target", inside).agg(F.sum("w").alias("w"))
    met = edge.join(whole, ["source_size", "target_size", "target"])
    return met.select("source_size", "target_size", "target", "source", (F.col("w") / F.col("all")).alias("weight"))


def scaled(pixels: DataFrame, images: DataFrame, image: str, y: str, x: str, value: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(image, y, x, value) of each image at its new size. ``images``: (image, rows, columns, new_rows, new_columns), one row each.

    Values are rounded, and clamped to ``low`` and ``high`` if given. Images without new sizes, and pixels outside of what is stated, are left out. A pixel is met by its
    image's weights only: the join's keys are sizes and place, and partial sums are made before each shuffle.
    """
    sizes = images.select(F.col(image).alias("of"), *(F.col(c).cast("long").alias(c) for c in ("rows", "columns", "new_rows", "new_columns")))
    both = sizes.select(F.col("columns").alias("source_size"), F.col("new_columns").alias("target_size")).union(sizes.select("rows", "new_rows"))
    table = weights(both)
    named = lambda a, b, s, t: table.select(F.col("source_size").alias(a), F.col("target_size").alias(b), F.col("source").alias(s), F.col("target").alias(t), F.col("weight").alias(f"w_{t}"))
    own = pixels.select(F.col(image).alias("of"), F.col(y).cast("long").alias("y"), F.col(x).cast("long").alias("x"), F.col(value).cast("double").alias("v")).join(sizes, "of").where("y < rows AND y >= 0")
    along = own.join(named("columns", "new_columns", "x", "new_x"), ["columns", "new_columns", "x"]).groupBy("of", "rows", "new_rows", "y", "new_x").agg(F.sum(F.col("v") * F.col("w_new_x")).alias("v"))
    across = along.join(named("rows", "new_rows", "y", "new_y"), ["rows", "new_rows", "y"]).groupBy("of", "new_y", "new_x").agg(F.sum(F.col("v") * F.col("w_new_y")).alias("v"))
    whole = L.half_up(F.round("v", 6)).cast("long")  # sums differ in their last bits by the order of their parts
    for bound, pick in ((low, F.greatest), (high, F.least)):
        whole = whole if bound is None else pick(whole, F.lit(bound))
    return across.select(F.col("of").alias(image), F.col("new_y").alias(y), F.col("new_x").alias(x), whole.alias(value))
