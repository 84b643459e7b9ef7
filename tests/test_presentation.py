"""Presentation states, preset lists, polygons and blur on small fixtures."""

import math
import random

from pyspark.sql import functions as F

from halyard.functions import display as D
from halyard.operators import dictionaries
from halyard.operators import presentation as P


def test_states_of_frames(spark):
    frames = [(s, i, f) for s in ("A", "B") for i in ("1", "2") for f in (1, 2)]
    refs = [("old", "A", None, None), ("new", "A", None, None), ("image", "A", "1", []), ("frames", "A", "1", [2, 2, 9]), ("frames", "A", None, None), ("void", "B", "7", None), ("undated", "B", "2", None), ("zz", "B", "2", None)]
    states = [("old", 1), ("new", 2), ("image", 0), ("frames", 0), ("void", 5), ("undated", None), ("zz", None)]
    f = spark.createDataFrame(frames, "series string, instance string, frame int")
    r = spark.createDataFrame(refs, "state string, series string, instance string, frames array<int>")
    s = spark.createDataFrame(states, "state string, created int")
    got = {(x.series, x.instance, x.frame): (x.state, x.depth, x.states) for x in P.chosen(f, r, s).collect()}
    assert got == {
        ("A", "1", 1): ("image", P.IMAGE, 4),
        ("A", "1", 2): ("frames", P.FRAME, 4),
        ("A", "2", 1): ("new", P.SERIES, 3),
        ("A", "2", 2): ("new", P.SERIES, 3),
        ("B", "2", 1): ("zz", P.IMAGE, 2),
        ("B", "2", 2): ("zz", P.IMAGE, 2),
    }
    assert P.chosen(f.limit(0), r, s).count() == 0


def brute_fill(points, y, x):
    n, odd = len(points), False
    if n < 3:
        return False
    for k in range(n):
        (y1, x1), (y2, x2) = points[k], points[(k + 1) % n]
        dy, dx = y2 - y1, x2 - x1
        if abs(dy) >= abs(dx):
            if min(y1, y2) <= y <= max(y1, y2) and x == math.floor((x1 + (y - y1) * dx / dy if dy else x1) + 0.5):
                return True
        elif min(x1, x2) <= x <= max(x1, x2) and y == math.floor(y1 + (x - x1) * dy / dx + 0.5):
            return True
        if (y1 <= y) != (y2 <= y) and x >= x1 + (y - y1) * dx / dy:
            odd = not odd
    return odd


def test_polygons_by_spans(spark):
    rnd = random.Random(7)
    shapes = [[(rnd.randint(0, 15), rnd.randint(0, 20)) for _ in range(rnd.randint(1, 6))] for _ in range(25)] + [[(3, 3)] * 3, [(2, 2), (2, 9), (2, 5)], [(-5, 4), (30, 4), (30, 8), (-5, 8)]]
    rows = [(i, [{"row": y, "column": x} for y, x in p]) for i, p in enumerate(shapes)]
    df = spark.createDataFrame(rows, "image int, points array<struct<row:int,column:int>>")
    pixels = spark.createDataFrame([(i, y, x, 0) for i in range(len(shapes)) for y in range(16) for x in range(21)], "image int, y int, x int, px int")
    got = {(r.image, r.y, r.x) for r in P.filled(pixels, "image", "y", "x", "px", df, "points", 5).where("px = 5").collect()}
    want = {(i, y, x) for i, p in enumerate(shapes) for y in range(16) for x in range(21) if brute_fill(p, y, x)}
    assert got == want
    two = df.where("image < 3").withColumn("image", F.lit(0))  # several shapes of one image
    assert P.filled(pixels.where("image = 0"), "image", "y", "x", "px", two, "points", 5).count() == 16 * 21


def test_blur_of_small_and_clipped_rectangles(spark):
    rnd = random.Random(1)
    grid = {(y, x): rnd.randint(0, 500) for y in range(9) for x in range(12)}
    df = spark.createDataFrame([(1, y, x, v) for (y, x), v in grid.items()], "image int, y int, x int, px int")

    def brute(top, left, height, width):
        t, l_, b, r = max(0, top), max(0, left), min(8, top + height - 1), min(11, left + width - 1)
        out = dict(grid)
        if b - t < 2 or r - l_ < 2:
            return out
        fold = lambda p, n: 2 * n - p % (2 * n) if p % (2 * n) > n else p % (2 * n)
        for y in range(t, b + 1):
            for x in range(l_, r + 1):
                out[y, x] = round(sum(grid[fold(y - t + a, b - t) + t, fold(x - l_ + c, r - l_) + l_] for a in range(-3, 4) for c in range(-3, 4)) / 49)
        return out

    for box in ((2, 3, 4, 5), (-2, -3, 8, 9), (0, 0, 2, 9), (5, 9, 9, 9), (0, 0, 99, 99), (1, 1, 3, 3)):
        got = {(r.y, r.x): r.px for r in D.rectangle_blur(df, "image", "y", "x", "px", *box).collect()}
        assert got == brute(*box), box


def test_labels_that_are_given_twice(spark):
    labels = spark.createDataFrame([("a", "en", "y"), ("a", "en", "x"), ("a", None, "n")], "code string, lang string, label string")
    df = spark.createDataFrame([("a", "en"), ("a", "fr"), ("b", "en"), (None, None)], "c string, l string")
    assert sorted((str(r.c), str(r.l), r.label) for r in dictionaries.localised(df, "c", "l", labels, "en", "?").collect()) == [("None", "None", "?"), ("a", "en", "x"), ("a", "fr", "x"), ("b", "en", "?")]


def test_states_of_a_frame_are_shuffled_once_by_frame(spark, small):
    from halyard import registry

    plan = registry.queries()["state_choice"](spark, small)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.split("\n") if "Exchange hashpartitioning(series" in line and "frame" in line]
    assert sum("REPARTITION_BY_COL" in k for k in keys) == 1
    above = plan[: plan.index("REPARTITION_BY_COL")]
    assert above.count("Exchange hashpartitioning(series") == 1  # its own
