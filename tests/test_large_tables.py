"""What keeps tasks small on large tables: seen in plans and numbers of tasks, as the tables here are small."""

import random

import numpy as np
from pyspark.sql import functions as F

from halyard import registry
from halyard.functions import display, hashing
from halyard.llm import suffix_dedup
from halyard.plans.common import partitions
from halyard.plans.scalars import KEY


def plan_of(df, which="executedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_scrolling_groups_shuffle_no_rows_of_display_sets(spark, small):
    """A shuffle by display set has one task for each, whatever the cluster."""
    plan = plan_of(registry.queries()["hp_scrolling"](spark, small))
    assert "BroadcastHashJoin" in plan and "hashpartitioning(display_set" not in plan


def test_a_digest_is_computed_once_within_a_lambda(spark):
    got = spark.createDataFrame([(["1.2", " "],)], "s array<string>").select(F.transform("s", lambda x: hashing.uid_hash(x, KEY)).alias("u"))
    assert plan_of(got, "analyzed").count("sha2(concat(0x") == 2  # a digest takes two
    assert got.first().u == [spark.range(1).select(hashing.uid_hash(F.lit("1.2"), KEY)).first()[0], None]


def test_decimals_of_all_lengths(spark):
    rnd = random.Random(4)
    numbers = [0, 1, 10**8 - 1, 10**8, 10**16, 10**19, 10**38 - 1, 10**38, 2**64, 2**96 - 1, 2**127, 2**128 - 1] + [rnd.getrandbits(rnd.randint(1, 128)) for _ in range(300)]
    df = spark.createDataFrame([(f"{n:032x}", str(n)) for n in numbers], "h string, want string")
    assert df.where(hashing.decimal_of(F.col("h")) != F.col("want")).count() == 0
    assert df.where(hashing.decimal_of(F.col("h")).isNull()).count() == 0


def test_crossings_of_a_line_tell_what_the_polygon_holds(spark):
    rnd = random.Random(9)
    shapes = [[(rnd.randint(0, 9), rnd.randint(0, 9)) for _ in range(n)] for n in (0, 2, 3, 3, 4, 5, 9)] + [[(1, 1), (1, 1), (1, 1)]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "i int, points array<struct<row:int,column:int>>")
    places = df.select("i", "points", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("y")).withColumn("c", display.polygon_crossings(F.col("points"), F.col("y") + 0.3))
    places = places.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("x"))
    one = display.shutter_contains(F.col("y") + 0.3, F.col("x") + 0.3, polygon=F.col("points"))
    other = display.shutter_contains(F.col("y") + 0.3, F.col("x") + 0.3, crossings=F.col("c"))
    got = places.select("i", "points", "y", "x", one.alias("one"), other.alias("other")).collect()

    def holds(points, y, x):
        pairs = list(zip(points, [*points[1:], *points[:1]]))
        if len(points) < 3 or not sum(a.column * b.row - b.column * a.row for a, b in pairs):
            return True
        return sum((a.row > y) != (b.row > y) and x < (b.column - a.column) * (y - a.row) / (b.row - a.row) + a.column for a, b in pairs) % 2 == 1

    assert all(r.one == r.other == holds(r.points, r.y + 0.3, r.x + 0.3) for r in got) and len(got) == 800


def test_a_small_file_of_shutters_is_dealt_to_many_tasks(spark, small):
    df = registry.queries()["shutter_shapes"](spark, small)
    plan = plan_of(df)
    assert plan.index("Generate") < plan.index("REPARTITION_BY_NUM")  # rows are dealt out before they are places


def test_partitions_follow_the_rows(spark):
    assert [partitions(spark.range(n), 100) for n in (0, 400, 401, 1000)] == [4, 4, 5, 10]


def test_tree_counts_have_more_partitions_for_more_lines(spark, small, monkeypatch):
    from halyard.plans import manifests

    monkeypatch.setattr(manifests, "partitions", lambda df: partitions(df, 500))
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert f"{-(-lines // 500)}), REPARTITION_BY_NUM" in plan_of(manifests.mf_tree_counts(spark, small))


def test_windows_that_meet_in_a_task_are_settled_there(spark):
    """Of a window of many documents a task sends on one, so that what meets in Spark doesn't grow with a group."""
    rnd = random.Random(3)
    odd = lambda n: bytes(rnd.choice(b"abcdefgh") for _ in range(n))
    common = odd(50)
    strings = [odd(2) + common + odd(2) for _ in range(500)] + [b"short"]
    doc = np.array([7 + i // 2 for i in range(501)])
    string, place, settled = suffix_dedup.settled_windows(strings, doc, np.arange(501) * 1000)
    seen = {}
    for i, s in enumerate(strings):
        for p in range(len(s) - 49):
            seen[s[p : p + 50]] = min(seen.get(s[p : p + 50], 10**9), doc[i])
    want = {(i, i * 1000 + p): doc[i] > seen[s[p : p + 50]] for i, s in enumerate(strings) for p in range(len(s) - 49)}
    assert dict(zip(zip(string.tolist(), place.tolist()), settled.tolist())) == want
    rows = [(i, int(doc[i]), 0, i % 3 == 0, s) for i, s in enumerate(strings)]
    scratch = suffix_dedup.Scratch(spark, "t")
    got = suffix_dedup._equal_windows(spark.createDataFrame(rows, "rid long, doc long, start long, follows boolean, bytes binary").repartition(4), scratch)
    covered = {(r.rid, p) for r in got.collect() for p in range(r.start, r.end - 49)}
    assert covered == {(i, p - i * 1000) for (i, p), late in want.items() if late}
    meet = spark.read.parquet(scratch.path("windows")).where(F.col("window") == common).count()
    assert meet <= 8  # two equal ids a task, of 500 occurrences
