"""From stored pixels to a picture: tables, palettes, overlays, shutters, and the chain that puts them together, as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lut as L


def byte_at(data: Column, index: Column) -> Column:
    """The byte of a 0-based index, 0 to 255."""
    return F.conv(F.hex(F.substring(data, index.cast("int") + 1, F.lit(1))), 16, 10).cast("int")


def _bytes(data: Column, count: Column, place) -> Column:
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: byte_at(data, place(i)))).otherwise(F.array().cast("array<int>"))


def entries_of(first: Column) -> Column:
    """Entries by a descriptor's first value: 0 stands for 65,536, and so do stored negatives for what they are without a sign."""
    return F.when(first <= 0, first + 0x10000).otherwise(first)


def table_offset(second: Column) -> Column:
    """A descriptor's second value as a signed 16-bit number."""
    low = F.pmod(second, F.lit(0x10000))
    return F.when(low >= 0x8000, low - 0x10000).otherwise(low)


def decode_table(data: Column, first: Column, bits: Column) -> Column:
    """Entries of a look-up table from little-endian data; null without data or for more than 16 bits.

    8-bit entries in 16-bit cells are unpacked; up to 256 entries of more bits are squeezed to 8.
    """
    n, size = entries_of(first), F.octet_length(data)
    plain = F.when((n <= 256) & (size == 2 * n), _bytes(data, n, lambda i: 2 * i)).otherwise(_bytes(data, size, lambda i: i))
    words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(byte_at(data, 2 * i), F.lit(0)) + 256 * F.coalesce(byte_at(data, 2 * i + 1), F.lit(0)))
    most = F.pow(F.lit(2.0), bits)
    squeezed = F.transform(words, lambda v: F.pmod(F.floor(v * (n - 1) / (most - 1)), F.lit(256)).cast("int"))
    return F.when(size > 0, F.when(bits <= 8, plain).when(bits <= 16, F.when(n <= 256, squeezed).otherwise(words)))


def palette_entries(data: Column, first: Column, bits: Column) -> Column:
    """8-bit entries of one colour of a palette: the high byte of 16-bit cells, the low one where 8 bits are stated. Null if sizes disagree."""
    n, size = entries_of(first), F.octet_length(data)
    wide = F.when(size == 2 * n, F.when(bits == 8, _bytes(data, n, lambda i: 2 * i)).otherwise(_bytes(data, n, lambda i: 2 * i + 1)))
    return F.when(bits.isin(8, 16) & (first >= 0), F.when((bits == 8) & (size == n), _bytes(data, n, lambda i: i)).otherwise(wide))


def palette_apply(px: Column, red: Column, green: Column, blue: Column, offset: Column) -> list[Column]:
    """Colours of a pixel; below and above the palette its first and last entry."""
    return [F.element_at(c, F.greatest(F.lit(0), F.least(px - offset, F.size(c) - 1)).cast("int") + 1) for c in (red, green, blue)]


def inflate_segments(segments: Sequence[int], entries: int) -> list[int]:
    """The 8-bit entries of a segmented table: discrete (0), linear (1) and indirect (2) segments of 16-bit values.

    An indirect segment runs segments that stand elsewhere in the data; it may not name another one. What it writes counts as written.
    """
    out: list[int] = []

    def word(at: int) -> int:
        if at >= len(segments):
            raise ValueError("the segments end too early")
        return segments[at] & 0xFFFF

    def write(y: int) -> None:
        if len(out) >= entries:
            raise ValueError(f"the segments hold more than {entries} entries")
        out.append(y >> 8 & 0xFF)

    def run(at: int, count: int | None, last: int) -> int:
        while at < len(segments) if count is None else count > 0:
            code, n = word(at), word(at + 1)
            if code == 0:
                for k in range(n):
                    write(word(at + 2 + k))
                at += 2 + n
                last = word(at - 1)
            elif code == 1:
                if not out:
                    raise ValueError("a linear segment can't be the first")
                end = word(at + 2)
                for k in range(1, n + 1):
                    write(last + int(math.copysign(abs(end - last) * k // n, end - last)))
                at, last = at + 3, end
            elif code == 2 and count is None:
                last = run(word(at + 2) | word(at + 3) << 16, n, last)
                at += 4
            else:
                raise ValueError(f"segment type {code} at {at}" + (" inside an indirect one" if code == 2 else ""))
            count = None if count is None else count - 1
        return last

    run(0, None, 0)
    return out + [0] * (entries - len(out))


def inflate(segments: Column, entries: int) -> Column:
    """Segmented tables of a column, inflated; their state runs from segment to segment, so rows go through Python, a table each."""
    return F.udf(lambda s: None if s is None else inflate_segments(s, entries), "array<int>", useArrow=True)(segments)


def modality_table_applies(modality: Column, relationship: Column) -> Column:
    """Whether a modality table is used: not for XA and XRF with log or display pixels."""
    special = (F.length(F.trim(F.coalesce(modality, F.lit("")))) == 0) | modality.isin("XA", "XRF")
    return ~special | relationship.isNull() | ~F.upper(relationship).isin("LOG", "DISP")


def slope_below_overlay(slope: Column, shift: Column) -> Column:
    """The slope where pixels stand above overlay bits."""
    return F.coalesce(slope, F.lit(1.0)) / F.pow(F.lit(2.0), shift)


def voi_windows(widths: Column, centers: Column, explanations: Column) -> Column:
    """Windows as (width, center, explanation), as many as both lists have."""
    n = F.least(F.size(widths), F.size(centers))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(widths, i).alias("width"), F.get(centers, i).alias("center"), F.get(explanations, i).alias("explanation"))))


PRESET = "struct<name:string,width:double,center:double,key:int>"


def presets(windows: Column, keyword: str) -> Column:
    """Named presets of windows: an explanation, or ``Default`` and a running number; one that is there already is left out. The first two get keys 1 and 2."""

    def add(state: Column, w: Column) -> Column:
        blank = F.length(F.trim(F.coalesce(w["explanation"], F.lit("")))) == 0
        number = F.size(state) + 1
        name = F.concat(F.when(blank, F.concat(F.lit("Default "), number.cast("string"))).otherwise(w["explanation"]), F.lit(f" {keyword}"))
        known = F.exists(state, lambda p: (p["name"] == name) & (p["width"] == w["width"]) & (p["center"] == w["center"]))
        new = F.struct(name.alias("name"), w["width"].cast("double").alias("width"), w["center"].cast("double").alias("center"), F.when(number <= 2, number).cast("int").alias("key"))
        return F.when(known, state).otherwise(F.concat(state, F.array(new)))

    none = F.array().cast(f"array<{PRESET}>")
    return F.aggregate(F.coalesce(windows, F.array().cast("array<struct<width:double,center:double,explanation:string>>")), none, add)


def table_window(offset: Column, entries: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """(width, center) that a table covers within the allocated range; the upper end is taken from the lower one as it was moved."""
    low = F.greatest(offset, least)
    high = F.least(F.greatest(low, offset + entries - 1), most)
    return (high - low).cast("double"), low + (high - low) / 2.0


def modality_output(low: Column, high: Column, slope: Column, intercept: Column, signed: Column, padded: Column, bits_stored: Column, table_bits: Column) -> tuple[Column, Column, Column]:
    """(applies, bits, signed) of the modality step. ``table_bits`` is null without a table; then the data's range decides."""
    at_low, at_high = low * slope + intercept, high * slope + intercept
    spread = L.half_up(at_high - at_low).cast("long")
    bits = F.when(spread < 0, 32).when(spread == 0, 0).otherwise(F.length(F.bin(spread)))
    bits = F.coalesce(table_bits, F.when((at_low < 0) & (bits <= 8), 9).otherwise(bits))
    identity = (F.abs(slope - 1.0) < 1e-6) & (F.abs(intercept) < 1e-6) & ~padded
    out_signed = F.when(table_bits.isNotNull(), F.lit(False)).otherwise((at_low < 0) | signed)
    return (bits_stored <= 16) & ~identity & (bits > 0) & (bits <= 32), bits, out_signed


def voi_range(fill_outside: Column, padded: Column, monochrome: Column, allocated: tuple[Column, Column], levels: tuple[Column, Column]) -> tuple[Column, Column]:
    """The values that a window table covers: all that can be stored if it is filled beyond the window or padding is there, else the levels."""
    whole = fill_outside | (padded & monochrome)
    return tuple(F.when(whole, a).otherwise(v.cast("int")) for a, v in zip(allocated, levels, strict=True))


def overlay_mask(high_bit: Column, bits_stored: Column, bits_allocated: Column) -> Column:
    """The bits of a pixel without those of embedded overlays; all bits where the cell has no room for overlays."""
    top = high_bit + 1
    power = lambda k: F.pow(F.lit(2.0), k).cast("long")
    mask = power(top) - 1 - F.when(top > bits_stored, power(top - bits_stored) - 1).otherwise(0)
    return F.when((bits_stored < bits_allocated) & bits_allocated.between(8, 16), mask).otherwise(power(bits_allocated) - 1)


def embedded_overlays(groups: Column, bits_stored: Column) -> Column:
    """Of overlay groups (bits_allocated, bit_position), the bit positions of those that stand inside the pixels, above what is stored."""
    inside = F.filter(groups, lambda g: (F.coalesce(g["bits_allocated"], F.lit(1)) != 1) & (F.coalesce(g["bit_position"], F.lit(0)) >= bits_stored))
    return F.transform(inside, lambda g: g["bit_position"])


def active_groups(mask: Column) -> Column:
    """Numbers of the overlay groups that an activation mask turns on."""
    return F.filter(F.sequence(F.lit(0), F.lit(15)), lambda g: F.getbit(mask, g) == 1)


def overlay_pixel(data: Column, rows: Column, columns: Column, origin_row: Column, origin_column: Column, y: Column, x: Column, frame: Column, first_frame: Column, frames: Column) -> Column:
    """Whether an overlay covers a pixel of a 0-based frame: origins and the first frame count from 1, the lowest bit of a byte comes first."""
    turn = frame - first_frame + 1
    row, col = y - (origin_row - 1), x - (origin_column - 1)
    inside = (turn >= 0) & (turn < frames) & (row >= 0) & (row < rows) & (col >= 0) & (col < columns)
    index = rows * columns * turn + row * columns + col
    return F.coalesce(inside & (F.floor(index / 8) < F.octet_length(data)) & (L.overlay_bit(data, index) == 1), F.lit(False))


def float_window(px: Column, window: Column, level: Column) -> Column:
    """A floating pixel as a byte: rounded to even, saturated."""
    slope = 255.0 / window
    return L.clamp(F.rint(px * slope + (255.0 - slope * (level + window / 2.0))), 0.0, 255.0).cast("int")


def turns_to_float(low: Column, high: Column, slope: Column, intercept: Column, bits_allocated: Column, signed: Column, reset: Column) -> Column:
    """Whether rescaled pixels need floating numbers: a slope below a half, or a range that the stored type can't hold."""
    ends = [low * slope + intercept, high * slope + intercept]
    least, most = F.least(*ends), F.greatest(*ends)
    out_signed = (least < 0) | signed
    bits = F.greatest(F.lit(1), F.least(F.lit(16), bits_allocated))
    half, full = F.pow(F.lit(2.0), bits - 1), F.pow(F.lit(2.0), bits)
    bottom, top = F.when(out_signed, -half).otherwise(0.0), F.when(out_signed, half - 1).otherwise(full - 1)
    return reset | (slope.isNotNull() & F.coalesce((slope < 0.5) | (least + 1 < bottom) | (most - 1 > top), F.lit(False)))


def colour(gray: Column, rgba: Column) -> Column:
    """[r, g, b, a]: a colour of three or four values clamped to bytes, else a 16-bit gray's high byte."""
    byte = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("int")
    given = F.concat(F.transform(F.slice(rgba, 1, 4), byte), F.when(F.size(rgba) > 3, F.array().cast("array<int>")).otherwise(F.array(F.lit(255))))
    return F.when(F.size(rgba) >= 3, given).otherwise(F.array(*[byte(F.shiftrightunsigned(F.coalesce(gray, F.lit(0)), 8))] * 3, F.lit(255)))


def polygon_crossings(points: Column, y: Column) -> Column:
    """The columns at which a line of places crosses a polygon of (row, column) points; null for under three points or without an area. They are the same
    for all places of a line, so find them before its places are dealt out."""
    n = F.size(points)
    follow = lambda i: F.get(points, (i + 1) % n)
    pairs = F.transform(points, lambda p, i: F.struct(p["row"].cast("double").alias("y1"), p["column"].cast("double").alias("x1"), follow(i)["row"].cast("double").alias("y2"), follow(i)["column"].cast("double").alias("x2")))
    area = F.aggregate(pairs, F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])
    crossed = F.filter(pairs, lambda e: (e["y1"] > y) != (e["y2"] > y))
    at = F.transform(crossed, lambda e: (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return F.when((n >= 3) & (area != 0), at)


def between_crossings(crossings: Column, x: Column) -> Column:
    """Whether a place of a line is inside by the even-odd rule."""
    return F.size(F.filter(crossings, lambda c: x < c)) % 2 == 1


def polygon_contains(points: Column, y: Column, x: Column) -> Column:
    """Whether a polygon of (row, column) points holds a place, by crossings; null for under three points or without an area."""
    crossings = polygon_crossings(points, y)
    return F.when(crossings.isNotNull(), between_crossings(crossings, x))


def shutter_contains(y: Column, x: Column, rectangle: Column | None = None, circle: Column | None = None, polygon: Column | None = None, crossings: Column | None = None) -> Column:
    """Whether a place is inside all shutters that have an area; true if none has.

    A rectangle is (left, top, right, bottom) in any order of its corners, a circle (row, column, radius), a polygon (row, column) points; ``crossings`` are
    those of a polygon with the place's line, for many places.
    """
    inside = F.lit(True)
    if rectangle is not None:
        r = rectangle
        left, right, top, bottom = F.least(r["left"], r["right"]), F.greatest(r["left"], r["right"]), F.least(r["top"], r["bottom"]), F.greatest(r["top"], r["bottom"])
        inside = inside & F.coalesce(~((right > left) & (bottom > top)) | ((x >= left) & (x < right) & (y >= top) & (y < bottom)), F.lit(True))
    if circle is not None:
        inside = inside & F.coalesce(~(circle["radius"] > 0) | ((x - circle["column"]) ** 2 + (y - circle["row"]) ** 2 < circle["radius"] ** 2), F.lit(True))
    if polygon is not None:
        inside = inside & F.coalesce(polygon_contains(polygon, y, x), F.lit(True))
    if crossings is not None:
        inside = inside & (crossings.isNull() | between_crossings(crossings, x))
    return inside


def rendered(px: Column, mask: Column, slope: Column, intercept: Column, bits_out: int, signed_out: bool, window: Column, level: Column, inverse: Column, overlay: Column) -> Column:
    """A monochrome pixel as shown: overlay bits off, rescaled, windowed to a byte, inverted, and white where an overlay covers it."""
    real = L.rescale(px.bitwiseAND(mask), slope, intercept, bits_out, signed_out)
    shown = L.window_linear(real, window, level, 0, 255)
    return F.when(overlay, 255).otherwise(F.when(inverse, 255 - shown).otherwise(shown)).cast("long")


def image_descriptor(rows: Column, columns: Column, frames: Column, samples: Column, bits_allocated: Column, bits_stored: Column, high_bit: Column) -> dict[str, Column]:
    """Image attributes brought to what can be: sizes from 0, frames and samples from 1, bits from 1 to 16, the high bit below what is stored."""
    at_least = lambda c, n: F.greatest(F.lit(n), F.coalesce(c, F.lit(n)))
    stored = F.greatest(F.lit(1), F.least(F.lit(16), F.coalesce(bits_stored, bits_allocated)))
    return {"n_rows": at_least(rows, 0), "n_columns": at_least(columns, 0), "frames": at_least(frames, 1), "samples": at_least(samples, 1), "bits_stored": stored, "high_bit": F.least(stored - 1, F.coalesce(high_bit, stored - 1))}


def pixel_range(px: Column, padding: Column | None = None, limit: Column | None = None) -> tuple[Column, Column]:
    """Aggregates (least, greatest) of pixels without those from the padding value to its limit; a uniform image gets a range of one."""
    if padding is not None:
        ends = (padding, limit if limit is not None else padding)
        px = F.when(~px.between(F.least(*ends), F.greatest(*ends)), px)
    low, high = F.min(px), F.max(px)
    return low, F.when(low == high, high + 1).otherwise(high)


def in_rectangle(y: Column, x: Column, top: int, left: int, height: int, width: int) -> Column:
    return (y >= top) & (y < top + height) & (x >= left) & (x < left + width)


def frame_ranges(offset: Column, length: Column, frames: Column) -> Column:
    """(frame, start, length) of each frame of native pixels that begin at an offset."""
    return F.transform(F.sequence(F.lit(1).cast("long"), frames.cast("long")), lambda f: F.struct(f.alias("frame"), (offset + (f - 1) * length).alias("start"), length.alias("length")))


def starts_image(fragment: Column) -> Column:
    """Whether a fragment begins a JPEG, JPEG-LS or JPEG 2000 code stream, or a JPEG XL one."""
    head = F.hex(F.substring(fragment, 1, 4))
    return F.coalesce(head.startswith("FFD8FF") | head.startswith("FF4FFF51") | head.startswith("FF0A"), F.lit(False))


def fragment_frames(fragments: DataFrame, image: str, order: Sequence[str], data: str) -> DataFrame:
    """Adds ``frame``, from 1, to the fragments of each image: one that starts a new code stream begins a frame, and so does the first."""
    w = Window.partitionBy(image).orderBy(*order)
    first = F.row_number().over(w) == 1
    starts = fragments.withColumn("_starts", (first | starts_image(F.col(data))).cast("int"))
    return starts.withColumn("frame", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_starts")


def raw_tags(width: Column, height: Column, channels: Column, depth: Column, signed: Column, descriptor: Column) -> Column:
    """Attributes of pixels that are written as they are: depth from the descriptor, several channels interleaved as RGB; signed if the cells (8U, 16U, 16S, 32S, 32F) or the image are."""
    return _tags(width, height, channels, (depth == "16S") | signed, descriptor)


def _tags(width: Column, height: Column, channels: Column, signed: Column, descriptor: Column) -> Column:
    several = channels > 1
    return F.struct(
        width.alias("columns"),
        height.alias("rows"),
        channels.alias("samples"),
        descriptor["bits_allocated"].alias("bits_allocated"),
        descriptor["bits_stored"].alias("bits_stored"),
        (descriptor["bits_stored"] - 1).alias("high_bit"),
        F.when(signed, 1).otherwise(0).alias("representation"),
        F.when(several, "RGB").otherwise(descriptor["photometric"]).alias("photometric"),
        F.when(several, 0).alias("planar"),
    )


#: Bits of an element by the depth of its cells.
DEPTHS = {"8U": 8, "16U": 16, "16S": 16, "32S": 32, "32F": 32}


def compressed_tags(width: Column, height: Column, channels: Column, depth: Column, signed: Column, descriptor: Column) -> Column:
    """Attributes of pixels that are written compressed: cells as wide as an element of the image, no more bits than it had compressed; signed for
    every depth but 8U, and 16U only where the image is."""
    bits = F.lit(None).cast("int")
    for name, n in DEPTHS.items():
        bits = F.when(depth == name, n).otherwise(bits)
    stored = F.least(descriptor["bits_compressed"], bits)
    own = F.struct(bits.alias("bits_allocated"), stored.alias("bits_stored"), descriptor["photometric"].alias("photometric"))
    return _tags(width, height, channels, (depth != "8U") & ((depth != "16U") | signed), own)


def rectangle_blur(pixels: DataFrame, image: str, y: str, x: str, value: str, top: int, left: int, height: int, width: int, size: int = 7, least: int = 3) -> DataFrame:
    """The pixels with those of a rectangle, as far as it is in the image, blurred over a square of ``size``: means of whole numbers, rounded, of the rectangle's own
    pixels, which are mirrored at its edges (the edge itself counts once). A rectangle of less than ``least`` either way stays.

    Mirroring is done on the sums: a line's weights are those of how often each of its pixels is met, so sums go along lines, then across them.
    """
    bounds = pixels.groupBy(image).agg(F.max(y).alias("_bottom"), F.max(x).alias("_right"))
    met = pixels.join(bounds, image)
    t, l_ = max(0, top), max(0, left)
    b, r = F.least(F.col("_bottom"), F.lit(top + height - 1)), F.least(F.col("_right"), F.lit(left + width - 1))
    inside = F.col(y).between(t, b) & F.col(x).between(l_, r) & (b - t + 1 >= least) & (r - l_ + 1 >= least)
    reach = size // 2

    def mirrored(at: Column, low: int, high: Column) -> Column:
        """The places from which a pixel is met: its own neighbours, and those that reach it over an edge."""
        n = high - low
        around = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: at - low + d)
        folded = F.transform(around, lambda p: F.pmod(p, 2 * n))
        return F.transform(folded, lambda p: F.when(p > n, 2 * n - p).otherwise(p) + low)

    own = met.where(inside).select(image, F.col(y).alias("_y"), F.col(x).alias("_x"), F.col(value).cast("long").alias("_v"), b.alias("_b"), r.alias("_r"))
    line = own.groupBy(image, "_y", "_b", "_r").agg(F.map_from_entries(F.collect_list(F.struct("_x", "_v"))).alias("_line"))
    along = own.join(line.select(image, "_y", "_line"), [image, "_y"]).select(image, "_y", "_x", "_b", F.aggregate(mirrored(F.col("_x"), l_, F.col("_r")), F.lit(0).cast("long"), lambda s, p: s + F.try_element_at("_line", p)).alias("_s"))
    column = along.groupBy(image, "_x").agg(F.map_from_entries(F.collect_list(F.struct("_y", "_s"))).alias("_column"))
    across = along.join(column, [image, "_x"]).select(image, "_y", "_x", F.aggregate(mirrored(F.col("_y"), t, F.col("_b")), F.lit(0).cast("long"), lambda s, p: s + F.try_element_at("_column", p)).alias("_sum"))
    blurred = across.select(F.col(image).alias("_image"), "_y", "_x", F.rint(F.col("_sum") / (size * size)).cast("long").alias("_mean"))
    out = pixels.join(blurred, (F.col(image) == F.col("_image")) & (F.col(y) == F.col("_y")) & (F.col(x) == F.col("_x")), "left")
    return out.withColumn(value, F.coalesce("_mean", F.col(value))).drop("_image", "_y", "_x", "_mean")


def box_blur(pixels: DataFrame, image: str, y: str, x: str, value: str, size: int = 7) -> DataFrame:
    """Each pixel's mean over a square of ``size`` around it, as far as the image goes: sums along the lines, then across them."""
    reach = size // 2
    along = Window.partitionBy(image, y).orderBy(x).rangeBetween(-reach, reach)
    across = Window.partitionBy(image, x).orderBy(y).rangeBetween(-reach, reach)
    lines = pixels.withColumn("_sum", F.sum(value).over(along)).withColumn("_n", F.count(F.lit(1)).over(along))
    return lines.withColumn(value, F.sum("_sum").over(across) / F.sum("_n").over(across)).drop("_sum", "_n")
