"""Rescale and window arithmetic: by value where pixels are columns, as arrays where a table is wanted."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Rounding with halves upwards, also below zero."""
    return F.floor(c + 0.5)


def depth_range(bits: int, signed: bool) -> tuple[int, int]:
    bits = max(1, min(16, bits))
    return (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)


def clamp(c: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.greatest(low, F.least(high, c))


def rescale(px: Column, slope: float | Column, intercept: float | Column, bits_out: int, signed_out: bool, inverse: bool = False) -> Column:
    """The ramp's entry for a pixel: rounded, clamped to the output's range, turned over if asked for."""
    low, high = depth_range(bits_out, signed_out)
    v = clamp(half_up(px * slope + intercept), low, high).cast("long")
    return F.lit(high + low) - v if inverse else v


def rescale_table(slope: float, intercept: float, bits: int, signed: bool, bits_out: int, signed_out: bool, inverse: bool = False) -> Column:
    low, high = depth_range(bits, signed)
    return F.transform(F.sequence(F.lit(low), F.lit(high)), lambda x: rescale(x, slope, intercept, bits_out, signed_out, inverse))


def padding_fill(table: Column, first: int, low: int, high: int, inverse: bool) -> Column:
    """The table with its entries for padding values set to its first entry, or its last if it is turned over."""
    fill = F.element_at(table, -1 if inverse else 1)
    return F.transform(table, lambda v, i: F.when((i + first).between(min(low, high), max(low, high)), fill).otherwise(v))


def pixel_to_real(px: Column, slope: Column | None, intercept: Column | None) -> Column:
    return px * F.coalesce(slope if slope is not None else F.lit(None).cast("double"), F.lit(1.0)) + F.coalesce(intercept if intercept is not None else F.lit(None).cast("double"), F.lit(0.0))


def pixel_to_table(px: Column, table: Column, offset: Column | int) -> Column:
    """The table's entry of a pixel; outside the table the pixel itself."""
    at = px.cast("int") - offset + 1
    return F.when((at >= 1) & (at <= F.size(table)), F.try_element_at(table, at).cast("double")).otherwise(px)


def _cut(c: Column) -> Column:
    """To a whole number towards zero."""
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long")


def window_linear(px: Column, window: float | Column, level: float | Column, low: int, high: int, inverse: bool = False) -> Column:
    window = F.greatest(F.lit(1.0), window if isinstance(window, Column) else F.lit(float(window)))
    slope = F.lit(float(high - low)) / window
    v = _cut(clamp(px * slope + (F.lit(float(high)) - slope * (level + window / 2)), float(low), float(high)))
    return F.lit(high + low) - v if inverse else v


def _scaled(raw: Column, ends: tuple[float, float] | None, low: int, high: int, inverse: bool) -> Column:
    """A curve's value on the output's range. ``ends`` are its values at both edges of the window, if it is normalised to them."""
    if ends:
        raw = (raw - (low + ends[0])) * (float(high - low) / abs(ends[1] - ends[0]))
    v = clamp(half_up(raw + float(low)), float(low), float(high)).cast("long")
    return F.lit(high + low) - v if inverse else v


def _width(window: float | Column) -> Column:
    return F.greatest(F.lit(1.0), window if isinstance(window, Column) else F.lit(float(window)))


def window_sigmoid(px: Column, window: float | Column, level: float | Column, low: int, high: int, inverse: bool = False, normalised: bool = False) -> Column:
    """An S-shaped curve around the level; factor -20/10, twice, as the standard's examples have it."""
    r, w = float(high - low), _width(window)
    ends = (r / (1 + math.exp(2.0)), r / (1 + math.exp(-2.0))) if normalised else None
    return _scaled(r / (1 + F.exp(-4.0 * (px - level) / w)), ends, low, high, inverse)


def window_exponential(px: Column, window: float | Column, level: float | Column, low: int, high: int, inverse: bool = False) -> Column:
    """e^2t, with t from -1/2 to 1/2 over the window, normalised to the window's ends."""
    r, w = float(high - low), _width(window)
    return _scaled(r * F.exp(2.0 * (px - level) / w), (r * math.exp(-1.0), r * math.exp(1.0)), low, high, inverse)


def window_log(px: Column, window: float | Column, level: float | Column, low: int, high: int, inverse: bool = False) -> Column:
    """ln(2(1 + t)), with t from -1/2 to 1/2 over the window, normalised to the window's ends.

    At t = -1 the output is its lowest value; below, where there is no logarithm, it is 0 or the nearest value to it.
    """
    r, w = float(high - low), _width(window)
    x = 1 + (px - level) / w
    v = _scaled(r * F.ln(F.when(x > 0, 2.0 * x)), (0.0, r * math.log(3.0)), low, high, inverse)
    none = [max(low, min(high, 0)), low]
    if inverse:
        none = [high + low - n for n in none]
    return F.when(x < 0, F.lit(none[0]).cast("long")).when(x == 0, F.lit(none[1]).cast("long")).otherwise(v)


def window_sequence(px: Column, window: float, level: float, entries: list[int], low: int, high: int, inverse: bool = False) -> Column:
    """A curve given by points: the window is spread over them; a value between two points is interpolated and rounded, then
    stretched by the output's range over the points' range (their least value is not taken off), rounded and clamped.
    """
    n, w = len(entries), max(1.0, float(window))
    below, above = level - w / 2.0, level + w / 2.0
    table = F.array(*(F.lit(float(x)) for x in entries))
    at = F.when(px <= below, 0.0).when(px > above, float(n - 1)).otherwise((px - below) * ((n - 1) / w))
    down = F.floor(at).cast("int")
    a, b = F.element_at(table, down + 1), F.element_at(table, F.least(F.ceil(at).cast("int"), F.lit(n - 1)) + 1)
    value = half_up(a + (at - down) * (b - a))
    spread = max(entries) - min(entries)
    if spread:
        v = clamp(half_up(value * (float(high - low) / spread)), float(low), float(high)).cast("long")
    else:  # a flat curve has no range to stretch: its lowest value comes out
        v = F.lit(max(low, min(high, -1 if max(entries) > 0 else 0))).cast("long")
    return F.lit(high + low) - v if inverse else v


def window_points(px: Column, window: Column, level: Column, points: Column, low: int, high: int) -> Column:
    """As ``window_sequence``, with the curve's points as a column."""
    n, w = F.size(points), _width(window)
    below, above = level - w / 2.0, level + w / 2.0
    at = F.when(px <= below, 0.0).when(px > above, (n - 1).cast("double")).otherwise((px - below) * ((n - 1) / w))
    down = F.floor(at).cast("int")
    a, b = F.get(points, down), F.get(points, F.least(F.ceil(at).cast("int"), n - 1))
    spread = F.array_max(points) - F.array_min(points)
    value = half_up(a + (at - down) * (b - a))
    flat = F.least(F.lit(high), F.greatest(F.lit(low), F.when(F.array_max(points) > 0, -1).otherwise(0)))
    return F.when(spread > 0, clamp(half_up(value * F.try_divide(F.lit(float(high - low)), spread)), float(low), float(high))).otherwise(flat).cast("long")


def value_range(table: Column, bits: int) -> tuple[Column, Column]:
    """(least value, range) of a table's entries, as unsigned numbers of so many bits."""
    seen = F.transform(table, lambda v: v.bitwiseAND(F.lit((1 << bits) - 1)))
    return F.array_min(seen), F.array_max(seen) - F.array_min(seen)


def window_parameters(window: Column, level: Column, preset_window: Column, preset_level: Column, low: Column, high: Column) -> tuple[Column, Column, Column, Column]:
    """(window, level, level_min, level_max): what is given, else the preset, else the data's range; the limits hold the data as well."""

    def usable(w: Column) -> Column:
        return F.when(~F.isnan(w) & (F.abs(w) < 1e300) & (w > 0), w)

    w = F.coalesce(usable(window), usable(preset_window), usable(high - low), F.lit(1.0))
    lv = F.coalesce(F.when(usable(window).isNotNull(), level), F.when(usable(preset_window).isNotNull(), preset_level), (low + high) / 2, F.lit(0.0))
    return w, lv, F.least(low, lv - w / 2), F.greatest(high, lv + w / 2)


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """A value that an expression uses several times, computed once."""
    return F.element_at(F.transform(F.array(c), use), 1)


# fixed values: white point, matrices and thresholds of the conversion between coded CIELab and sRGB under D65
WHITE = (0.950456, 1.0, 1.088754)
FROM_RGB = (
    (0.4123955889674142161, 0.3575834307637148171, 0.1804926473817015735),
    (0.2125862307855955516, 0.7151703037034108499, 0.07220049864333622685),
    (0.01929721549174694484, 0.1191838645808485318, 0.9504971251315797660),
)
TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
CUBE_FROM, ROOT_FROM = 0.206896551724137931, 8.85645167903563082e-3
DARK_LINEAR, DARK_CODED = 0.0031306684425005883, 0.0404482362771076


def _times(matrix: tuple[tuple[float, ...], ...], vector: list[Column]) -> list[Column]:
    return [m[0] * vector[0] + m[1] * vector[1] + m[2] * vector[2] for m in matrix]


def lab_to_rgb(lstar: Column, a: Column, b: Column) -> list[Column]:
    """16-bit coded CIELab to 8-bit sRGB. Of colours that sRGB doesn't have, the least component is lifted to zero and the others with it."""
    lv, av, bv = lstar * 100.0 / 65535.0, a * 255.0 / 65535.0 - 128.0, b * 255.0 / 65535.0 - 128.0
    fy = (lv + 16.0) / 116.0

    def unfold(t: Column) -> Column:
        return bound(t, lambda t: F.when(t > CUBE_FROM, t * t * t).otherwise(108.0 / 841.0 * (t - 4.0 / 29.0)))

    linear = F.array(*_times(TO_RGB, [w * unfold(f) for w, f in zip(WHITE, (fy + av / 500.0, fy, fy - bv / 200.0))]))
    lifted = bound(linear, lambda v: F.transform(v, lambda c: c - F.least(F.lit(0.0), F.array_min(v))))
    curve = F.transform(lifted, lambda c: F.when(c <= DARK_LINEAR, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1.0 / 2.4)) - 0.055))
    coded = F.transform(curve, lambda c: half_up(clamp(c, 0.0, 1.0) * 255.0).cast("long"))
    return [F.element_at(coded, k) for k in (1, 2, 3)]


def rgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """8-bit sRGB to 16-bit coded CIELab."""

    def decode(c: Column) -> Column:
        return bound(c / 255.0, lambda c: F.when(c <= DARK_CODED, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))))

    def fold(t: Column) -> Column:
        return bound(t, lambda t: F.when(t > ROOT_FROM, F.pow(t, F.lit(1.0 / 3.0))).otherwise(841.0 / 108.0 * t + 4.0 / 29.0))

    fx, fy, fz = (fold(t / w) for t, w in zip(_times(FROM_RGB, [decode(c) for c in (r, g, b)]), WHITE))
    out = ((116.0 * fy - 16.0) * (65535.0 / 100.0), (500.0 * (fx - fy) + 128.0) * (65535.0 / 255.0), (200.0 * (fy - fz) + 128.0) * (65535.0 / 255.0))
    return [clamp(half_up(c), 0, 65535).cast("long") for c in out]


def overlay_bit(data: Column, index: Column) -> Column:
    """Bit number ``index`` of packed bytes, the lowest bit of a byte first."""
    byte = F.conv(F.hex(F.substring(data, F.floor(index / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.getbit(byte, (index % 8).cast("int"))


def psnr(mse: Column, peak: float) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10.0 * F.log10(F.lit(peak * peak) / mse))


def ssim(n: Column, mean_a: Column, mean_b: Column, square_a: Column, square_b: Column, product: Column, peak: float) -> Column:
    """Structural similarity of one tile from its means."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    var_a, var_b, cov = square_a - mean_a * mean_a, square_b - mean_b * mean_b, product - mean_a * mean_b
    return ((2 * mean_a * mean_b + c1) * (2 * cov + c2)) / ((mean_a * mean_a + mean_b * mean_b + c1) * (var_a + var_b + c2))
