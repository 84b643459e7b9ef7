import math
import random

from halyard.operators.resampling import scaled, weights


def kernel(t):
    return 1.0 if abs(t) < 1e-9 else 0.0 if abs(t) >= 4 else math.sin(math.pi * t) * math.sin(math.pi * t / 4) * 4 / (math.pi * t) ** 2


def line(v, m):
    out = []
    for q in range(m):
        p = (q + 0.5) * len(v) / m - 0.5
        w = [(math.floor(p) + d, kernel(p - math.floor(p) - d)) for d in range(-3, 5)]
        out.append(sum(v[max(0, min(len(v) - 1, i))] * x for i, x in w) / sum(x for _, x in w))
    return out


def test_images_of_several_sizes(spark):
    rnd = random.Random(3)
    sizes = {1: (5, 7, 9, 4), 2: (5, 7, 5, 7), 3: (1, 1, 3, 2), 4: (6, 2, 2, 11), 5: (3, 3, 0, 3)}
    grids = {i: [[rnd.randint(0, 255) for _ in range(c)] for _ in range(r)] for i, (r, c, _, _) in sizes.items()}
    pixels = spark.createDataFrame([(i, y, x, v) for i, g in grids.items() for y, row in enumerate(g) for x, v in enumerate(row)] + [(1, 99, 0, 5), (9, 0, 0, 1)], "image int, y int, x int, px int")
    images = spark.createDataFrame([(i, *s) for i, s in sizes.items()], "image int, rows int, columns int, new_rows int, new_columns int")
    got = {(r.image, r.y, r.x): r.px for r in scaled(pixels, images, "image", "y", "x", "px", 0, 255).collect()}
    want = {}
    for i, (_, _, nr, nc) in sizes.items():
        wide = [line(row, nc) for row in grids[i]]
        for x in range(nc):
            for y, v in enumerate(line([row[x] for row in wide], nr)):
                want[i, y, x] = max(0, min(255, math.floor(round(v, 6) + 0.5)))
    assert got == want
    assert all(got[2, y, x] == grids[2][y][x] for y in range(5) for x in range(7))  # the same size changes nothing
    assert all(abs(r.s - 1) < 1e-9 for r in weights(images.selectExpr("rows AS source_size", "new_rows AS target_size")).groupBy("source_size", "target_size", "target").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "s").collect())
