"""Tables of look-up tables against the steps pixel by pixel, and those against plain arithmetic."""

import math
import random

from pyspark.sql import functions as F

from halyard.operators import rendering as R

BASE = dict(bits_allocated=16, bits_stored=12, high_bit=11, signed=False, embedded=False, photometric="MONOCHROME2", low=0, high=4095, slope=1.0, intercept=0.0, reset=False, modality_table=None, modality_offset=0,
            modality_bits=16, padding=None, padding_limit=None, apply_padding=True, inverse_action=False, shape="LINEAR", points=None, window=400.0, level=50.0, fill_outside=False, state_shape=None, state_table=None)
CASES = [
    {},
    dict(slope=2.0, intercept=-1024.0),
    dict(slope=0.5, intercept=-7.25, photometric="MONOCHROME1"),
    dict(slope=2.0, intercept=-1024.0, padding=0, padding_limit=100),
    dict(slope=2.0, intercept=-1024.0, padding=50, photometric="MONOCHROME1"),
    dict(slope=1.0, padding=4000, padding_limit=3000, inverse_action=True),
    dict(slope=2.0, intercept=3.0, padding=50, apply_padding=False),
    dict(bits_stored=8, high_bit=7, low=0, high=255, slope=0.9, intercept=1.0, padding=3, window=200.0, level=100.0),
    dict(signed=True, low=-2048, high=2047, slope=1.5, intercept=10.0),
    dict(embedded=True, bits_stored=10, high_bit=9, high=1023),
    dict(embedded=True, bits_stored=10, high_bit=11, high=4092, slope=2.0, intercept=-100.0),
    dict(reset=True, slope=5.0, intercept=1.0),
    dict(modality_table=[(i * 7) % 4096 for i in range(4096)]),
    dict(modality_table=[i // 16 for i in range(4000)], slope=2.0),  # the table doesn't hold the pixels
    dict(modality_table=[i // 2 for i in range(4096)], padding=7, slope=2.0, photometric="MONOCHROME1"),
    dict(modality_table=[3, 2, 1], modality_offset=5, modality_bits=8),  # nothing is applied at all
    *(dict(shape=s, slope=2.0, intercept=-1000.0, photometric=p) for s in ("SIGMOID", "SIGMOID_NORM", "LOG", "LOG_INV") for p in ("MONOCHROME1", "MONOCHROME2")),
    dict(shape="SEQUENCE", points=[20.0, 30.0, 60.0, 180.0, 220.0], window=300.0, level=100.0),
    dict(shape="SEQUENCE", points=[5.0, 5.0]),
    dict(state_shape="INVERSE"),
    dict(state_shape="IDENTITY", photometric="MONOCHROME1"),
    dict(state_table=[(4095 - i) // 16 for i in range(4096)], shape="SIGMOID"),
    dict(state_table=[255 - i for i in range(256)], shape="SEQUENCE", points=[0.0, 100.0, 255.0], window=2000.0, level=1000.0),
    dict(photometric="RGB", slope=2.0, intercept=1.0),
    dict(fill_outside=True, window=0.2, level=40.0),
    dict(bits_allocated=32, bits_stored=32, high_bit=31, low=0, high=100_000, window=90_000.0, level=45_000.0),
]


def half_up(x):
    return math.floor(x + 0.5)


def depth(bits, signed):
    bits = max(1, min(16, bits))
    return (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)


def clamp(x, a, b):
    return max(a, min(b, x))


def brute(px, p):
    cut = p["embedded"] and p["bits_stored"] < p["bits_allocated"] and 8 <= p["bits_allocated"] <= 16
    shift = p["high_bit"] + 1 - p["bits_stored"]
    if cut:
        px &= (1 << p["high_bit"] + 1) - 1 - ((1 << shift) - 1 if shift > 0 else 0)
    slope = p["slope"] / (1 << shift) if cut and shift > 0 else p["slope"]
    inverse = p["state_shape"] == "INVERSE" if p["state_shape"] else p["photometric"] == "MONOCHROME1"
    mono = p["photometric"].startswith("MONOCHROME")

    def modality(v):
        t, o = p["modality_table"], p["modality_offset"]
        if p["reset"]:
            return v
        at = lambda v: t[clamp(v - o, 0, len(t) - 1)]
        if t and (not p["apply_padding"] or p["padding"] is None) and p["low"] >= o and p["high"] < o + len(t):
            return at(v)
        if p["bits_stored"] > 16 or (slope == 1 and p["intercept"] == 0 and p["padding"] is None):
            return v
        a, b = p["low"] * slope + p["intercept"], p["high"] * slope + p["intercept"]
        bits = (8 if p["modality_bits"] <= 8 else 16) if t else half_up(b - a).bit_length()
        if not t and a < 0 and bits <= 8:
            bits = 9
        least, most = depth(bits, not t and (a < 0 or p["signed"]))
        first, last = depth(p["bits_stored"], p["signed"])
        f = at if t else lambda v: clamp(half_up(clamp(v, first, last) * slope + p["intercept"]), least, most)
        if p["apply_padding"] and p["padding"] is not None and mono:
            ends = sorted((p["padding"], p["padding_limit"] if p["padding_limit"] is not None else p["padding"]))
            if ends[0] <= v <= ends[1]:
                turned = inverse != p["inverse_action"]
                if bits <= 8:
                    return 255 if turned else 0
                return (t[-1] if t else f(last)) if turned else (t[0] if t else f(first))
        return f(v)

    real = modality(px)
    if not mono:
        return real, real

    def window(v):
        w, lv = max(1.0, p["window"]), p["level"]
        if not (p["fill_outside"] or p["padding"] is not None):
            v = clamp(v, int(min(modality(p["low"]), lv - w / 2)), int(max(modality(p["high"]), lv + w / 2)))
        t = (v - lv) / w
        unit = lambda x, a, b: clamp(half_up((x - a) / (b - a) * 255), 0, 255)
        s = p["shape"]
        if s == "SIGMOID":
            out = clamp(half_up(255 / (1 + math.exp(-4 * t))), 0, 255)
        elif s == "SIGMOID_NORM":
            out = unit(1 / (1 + math.exp(-4 * t)), 1 / (1 + math.exp(2)), 1 / (1 + math.exp(-2)))
        elif s == "LOG":
            out = 0 if 1 + t <= 0 else unit(math.log(2 * (1 + t)), 0, math.log(3))
        elif s == "LOG_INV":
            out = unit(math.exp(2 * t), math.exp(-1), math.exp(1))
        elif s == "SEQUENCE":
            q, n = p["points"], len(p["points"])
            x = 0 if v <= lv - w / 2 else n - 1 if v > lv + w / 2 else (v - lv + w / 2) * (n - 1) / w
            i = math.floor(x)
            y = half_up(q[i] + (x - i) * (q[math.ceil(x)] - q[i]))
            spread = max(q) - min(q)
            out = clamp(half_up(y * 255 / spread), 0, 255) if spread else 0
        else:
            k = 255 / w
            out = int(clamp(v * k + (255 - k * (lv + w / 2)), 0, 255))
        return 255 - out if inverse else out

    if p["state_table"]:
        t = p["state_table"]
        return real, t[clamp(window(real) if p["shape"] == "SEQUENCE" else real, 0, len(t) - 1)]
    return real, window(real)


def test_tables_equal_the_steps(spark):
    rnd = random.Random(3)
    kinds = [BASE | c for c in CASES]
    schema = "image long, " + ", ".join(f"{n} {t}" for n, (t, _) in R.PARAMETERS.items())
    images = spark.createDataFrame([(i, *(k[n] for n in R.PARAMETERS)) for i, k in enumerate(kinds + kinds[:5])], schema)
    rows = []
    for i, k in enumerate(kinds + kinds[:5]):
        low, high = (-2048, 2047) if k["signed"] else (0, 100_000 if k["bits_allocated"] > 16 else 65_535 if k["embedded"] else 4095)
        rows += [(i, n, rnd.randint(low, high)) for n in range(60)]
    pixels = spark.createDataFrame(rows, "image long, n int, px int")
    for limit in (10**9, 0):  # tables broadcast, and met in a shuffle
        got = {(r.image, r.n): (r.real, r.shown) for r in R.render(pixels, images, "image", "px", ["n"], limit).collect()}
        assert len(got) == len(rows)
        for i, n, px in rows:
            k = (kinds + kinds[:5])[i]
            want = brute(px, k)
            assert got[i, n][0] == want[0], (k, px)
            assert abs(got[i, n][1] - want[1]) <= 0, (k, px, got[i, n], want)
    keyed, tables = R.look_up_tables(images, "image")
    assert keyed.select("key").distinct().count() == len(kinds)  # equal parameters share a table
    assert tables.groupBy("key").count().agg(F.max("count")).first()[0] <= 65_536


def test_defaults_stand_for_missing_columns(spark):
    images = spark.createDataFrame([(1, 400.0, 50.0)], "image long, window double, level double")
    pixels = spark.createDataFrame([(1, 0), (1, 50), (1, 900)], "image long, px int")
    got = sorted(tuple(r) for r in R.render(pixels, images, "image", "px").collect())
    assert got == [(1, p, *brute(p, BASE | dict(bits_stored=16, high_bit=15, high=65_535))) for p in (0, 50, 900)]
    assert R.render(pixels.limit(0), images, "image", "px").count() == 0
