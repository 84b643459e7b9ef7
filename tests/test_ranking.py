import math
import random

from pyspark.sql import functions as F

from halyard.operators import comparison as C
from halyard.operators.ranking import ranked


def test_ranks_of_equal_and_null_rows(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1.0, 2.0, rnd.random()]), rnd.choice(["a", None])) for _ in range(500)] + [(1.0, "a")] * 300
    df = spark.createDataFrame(rows, "v double, rank_no string").withColumn("range_no", F.lit(1)).repartition(5)
    got = ranked(df, [F.col("v").desc_nulls_last(), F.col("rank_no")], "place").collect()
    assert sorted(r.place for r in got) == list(range(1, 801))
    order = lambda v, s: (v is None, -(v or 0), s is not None, s or "")
    assert [order(r.v, r.rank_no) for r in sorted(got, key=lambda r: r.place)] == sorted(order(v, s) for v, s in rows)
    assert ranked(df.limit(0), [F.col("v")]).count() == 0


def groups():
    rnd = random.Random(2)
    hot = [("hot", rnd.gauss(0, 1)) for _ in range(9000)]  # nine tenths of all, all different
    tied = [("tied", float(v)) for v in [1] * 300 + [2] * 4 + [3] * 300]
    odd = [("odd", v) for v in (math.inf, -math.inf, 0.0, math.nan, 5.0)] + [("odd", None)] * 3 + [(None, 7.0), (None, 6.0), ("void", None)]
    few = [("few", float(i)) for i in range(7)]
    return hot + tied + odd + few


def test_values_at_ranks_by_ranges(spark):
    """However small the largest sorted range is, the values are those of the sorted group."""
    df = spark.createDataFrame(groups(), "k string, v double").repartition(4)
    by = {}
    for k, v in groups():
        if v is not None:
            by.setdefault(k, []).append(v)
    for v in by.values():
        v.sort(key=lambda x: (math.isnan(x), x))
    shown = lambda rows: {k: str(v) for k, v in rows}
    for most in (1_000_000, 500, 20):
        got = C.value_at_rank(df, ["k"], "v", F.floor(F.col("_n") / 2), "m", most)
        assert shown(got.collect()) == shown((k, v[len(v) // 2]) for k, v in by.items())
    for share in (0.0, 0.01, 0.95, 1.0):
        got = C.value_at_rank(df, ["k"], "v", F.greatest(F.ceil(F.col("_n") * share), F.lit(1)) - 1, "m", 100)
        assert shown(got.collect()) == shown((k, v[max(1, math.ceil(len(v) * share)) - 1]) for k, v in by.items())
    assert C.nearest_rank(df.limit(0), ["k"], "v", 0.5, "m").count() == 0


def test_throughput_uses_the_upper_median(spark):
    df = spark.createDataFrame([("a", 1.0, float(ms)) for ms in (10, 20, 30, 1000)] + [("b", 1.0, 0.0)], "k string, w double, ms double")
    got = {r.k: r.rate for r in C.throughput(df, ["k"], "w", "ms", "rate").collect()}
    assert round(got["a"], 1) == 133.3 and got["b"] is None
