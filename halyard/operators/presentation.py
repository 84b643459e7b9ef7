"""Presentation states and the images they are for: references of three depths resolved by equi-joins, ties broken, presets gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES, IMAGE, FRAME = 0, 1, 2


def applying(frames: DataFrame, references: DataFrame) -> DataFrame:
    """(series, instance, frame, state, depth): each state that applies to each frame of ``frames``, once, with the deepest reference that says so.

    ``references``: (state, series, instance, frames). Without an instance a reference holds for the whole series; without frames (null or empty) for the whole image.
    Each depth is a join on its own keys, so no frame meets the references of other images.
    """
    r = references.select("state", F.col("series").alias("r_series"), F.col("instance").alias("r_instance"), F.col("frames").alias("r_frames"))
    listed = F.coalesce(F.size("r_frames"), F.lit(0)) > 0
    series = r.where(F.col("r_instance").isNull()).select("state", "r_series").distinct()
    images = r.where(F.col("r_instance").isNotNull() & ~listed).select("state", "r_series", "r_instance").distinct()
    single = r.where(F.col("r_instance").isNotNull() & listed).select("state", "r_series", "r_instance", F.explode("r_frames").alias("r_frame")).distinct()
    one = F.col("series") == F.col("r_series")
    same = one & (F.col("instance") == F.col("r_instance"))
    parts = [frames.join(series, one), frames.join(images, same), frames.join(single, same & (F.col("frame") == F.col("r_frame")))]
    all_ = None
    for depth, part in enumerate(parts):
        part = part.select("series", "instance", "frame", "state", F.lit(depth).alias("depth"))
        all_ = part if all_ is None else all_.unionByName(part)
    # one shuffle by frame, for the states of each and for what is chosen of them
    return all_.repartition("series", "instance", "frame").groupBy("series", "instance", "frame", "state").agg(F.max("depth").alias("depth"))


def chosen(frames: DataFrame, references: DataFrame, states: DataFrame) -> DataFrame:
    """(series, instance, frame, state, depth, states): of the states that apply to a frame, the one with the deepest reference, then the newest (``created``; null is
    oldest), then the greatest identifier; and how many apply. Frames without a state are not there.

    ``states``: (state, created), one row each.
    """
    known = applying(frames, references).join(states.select("state", "created"), "state")
    order = F.struct("depth", F.col("created").isNotNull(), "created", "state")
    best = known.groupBy("series", "instance", "frame").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("states"))
    return best.select("series", "instance", "frame", F.col("best.state").alias("state"), F.col("best.depth").alias("depth"), "states")


PRESET = "struct<name:string,width:double,center:double,shape:string,key:int>"
AUTO, FIRST, SECOND = 0, 1, 2  # keys


def preset_list(windows: Column, tables: Column, shape: Column, auto: Column, keyword: str, by_modality: Column | None = None, bits_stored: Column | None = None) -> Column:
    """All presets of an image in their order: windows, tables, the image's own range, those of its modality.

    ``windows``: (width, center, explanation), those of a presentation state first; unnamed ones are ``Default`` and a running number, one that is there already is left out.
    ``tables``: (low, high, explanation), the values that each covers; unnamed ones are ``VOI LUT`` and their place from 0. ``auto``: (width, center).
    ``by_modality``: a list of presets, for images of more than 8 bits. The first two of the list have keys of their own, and so has the image's range.
    """

    def preset(name: Column, width: Column, center: Column, of: Column, key: Column) -> Column:
        return F.struct(name.alias("name"), width.cast("double").alias("width"), center.cast("double").alias("center"), of.cast("string").alias("shape"), key.cast("int").alias("key"))

    def named(given: Column, otherwise: Column) -> Column:
        blank = F.length(F.trim(F.coalesce(given, F.lit("")))) == 0
        return F.concat(F.when(blank, otherwise).otherwise(given), F.lit(f" {keyword}"))

    def key_at(size: Column) -> Column:
        return F.when(size == 0, FIRST).when(size == 1, SECOND)

    def add(state: Column, w: Column) -> Column:
        name = named(w["explanation"], F.concat(F.lit("Default "), (F.size(state) + 1).cast("string")))
        known = F.exists(state, lambda p: (p["name"] == name) & (p["width"] == w["width"]) & (p["center"] == w["center"]))
        return F.when(known, state).otherwise(F.concat(state, F.array(preset(name, w["width"], w["center"], shape, key_at(F.size(state))))))

    none = F.array().cast(f"array<{PRESET}>")
    first = F.aggregate(F.coalesce(windows, F.array().cast("array<struct<width:double,center:double,explanation:string>>")), none, add)
    # a table's window: what it covers
    second = F.transform(
        F.coalesce(tables, F.array().cast("array<struct<low:int,high:int,explanation:string>>")),
        lambda t, i: F.struct(named(t["explanation"], F.concat(F.lit("VOI LUT "), i.cast("string"))).alias("name"), (t["high"] - t["low"]).cast("double").alias("width"), (t["low"] + (t["high"] - t["low"]) / 2.0).alias("center")),
    )
    with_tables = F.aggregate(second, first, lambda s, t: F.concat(s, F.array(preset(t["name"], t["width"], t["center"], F.lit("SEQUENCE"), key_at(F.size(s))))))
    own = F.array(preset(F.lit("Auto Level [Image]"), auto["width"], auto["center"], shape, F.lit(AUTO)))
    last = none if by_modality is None else F.when(bits_stored > 8, F.coalesce(by_modality.cast(f"array<{PRESET}>"), none)).otherwise(none)
    return F.concat(with_tables, own, last)


def presets_of_modalities(presets: DataFrame) -> DataFrame:
    """(modality, presets): the presets of each modality in order of their names; a table with a row a modality."""
    p = F.struct("name", F.col("window").alias("width"), F.col("level").alias("center"), "shape", "key")
    return presets.groupBy("modality").agg(F.array_sort(F.collect_list(p)).cast(f"array<{PRESET}>").alias("presets"))


def polygon_rows(shapes: DataFrame, image: str, points: str) -> DataFrame:
    """(image, row, from, to): the spans of columns that filled polygons cover in each row, their edges' pixels included.

    A polygon is an array of (row, column) whole numbers, closed from its last point to its first; fewer than three points cover nothing. Inside is by the even-odd rule, spans
    of a row are found by sorting its crossings; a steep edge has a pixel in each row, a flat one in each column.
    """
    n = F.size(points)
    corner = F.posexplode(F.when(n >= 3, F.col(points)).otherwise(F.slice(points, 1, 0))).alias("i", "a")
    edges = shapes.withColumn("shape_no", F.monotonically_increasing_id()).select(image, "shape_no", points, corner)
    b = F.get(points, (F.col("i") + 1) % F.size(points))
    e = edges.select(image, "shape_no", *(F.col(f"a.{c}").cast("long").alias(f"{c}1") for c in ("row", "column")), *(b[c].cast("long").alias(f"{c}2") for c in ("row", "column")))
    dy, dx = F.col("row2") - F.col("row1"), F.col("column2") - F.col("column1")
    # crossings of whole rows, each edge without its lower end
    low, high = F.least("row1", "row2"), F.greatest("row1", "row2")
    crossing = e.where(low < high).withColumn("y", F.explode(F.sequence(low, high - 1)))
    crossing = crossing.select(image, "shape_no", "y", (F.col("column1") + (F.col("y") - F.col("row1")) * dx / dy).alias("x"))
    sorted_ = crossing.groupBy(image, "shape_no", "y").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    spans = sorted_.select(image, F.col("y").alias("row"), F.explode(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2))).alias("k"), "xs")
    spans = spans.select(image, "row", F.ceil(F.get("xs", F.col("k"))).alias("from"), F.floor(F.get("xs", F.col("k") + 1)).alias("to")).where(F.col("from") <= F.col("to"))
    steep = F.abs(dy) >= F.abs(dx)
    down = e.where(steep).withColumn("y", F.explode(F.sequence("row1", "row2"))).select(image, F.col("y").alias("row"), F.floor(F.col("column1") + F.coalesce(F.try_divide((F.col("y") - F.col("row1")) * dx, dy), F.lit(0.0)) + 0.5).alias("from"))
    along = e.where(~steep).withColumn("x", F.explode(F.sequence("column1", "column2"))).select(image, F.floor(F.col("row1") + (F.col("x") - F.col("column1")) * dy / dx + 0.5).alias("row"), F.col("x").alias("from"))
    edge = down.unionByName(along).withColumn("to", F.col("from"))
    return spans.unionByName(edge)


def filled(pixels: DataFrame, image: str, y: str, x: str, value: str, shapes: DataFrame, points: str, colour: int) -> DataFrame:
    """The pixels with those that a polygon of their image covers set to a colour. Spans meet pixels by image and row; spans of a row are united first, so a row meets few."""
    rows = polygon_rows(shapes, image, points)
    w = Window.partitionBy(image, "row").orderBy("from", "to")
    reach = F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    united = rows.withColumn("new", F.when(F.col("from") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    united = united.groupBy(image, "row", "run").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    lists = united.groupBy(F.col(image).alias("of_image"), F.col("row").alias("of_row")).agg(F.collect_list(F.struct("from", "to")).alias("covered"))
    met = pixels.join(lists, (F.col(image) == F.col("of_image")) & (F.col(y) == F.col("of_row")), "left")
    inside = F.coalesce(F.exists("covered", lambda s: (F.col(x) >= s["from"]) & (F.col(x) <= s["to"])), F.lit(False))
    return met.withColumn(value, F.when(inside, F.lit(colour)).otherwise(F.col(value))).drop("of_image", "of_row", "covered")
