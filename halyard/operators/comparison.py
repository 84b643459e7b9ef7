"""Comparing runs: A/B differences, gates, and order statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.shared import shared_folder

INF = float("inf")


def percent_change(base: Column, candidate: Column) -> Column:
    """Null if either is unknown or the base is 0; two infinities are no change."""
    return F.when((base == INF) & (candidate == INF), 0.0).when(base != 0, (candidate - base) / base * 100)


def compare(base: DataFrame, candidate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A full outer join on the keys: side (base, candidate, both) and each metric of either side."""
    b = base.select(*(F.col(c).alias(c if c in keys else f"base_{c}") for c in base.columns), F.lit(True).alias("_b"))
    c = candidate.select(*(F.col(c).alias(c if c in keys else f"candidate_{c}") for c in candidate.columns), F.lit(True).alias("_c"))
    side = F.when(F.col("_c").isNull(), "base").when(F.col("_b").isNull(), "candidate").otherwise("both")
    return b.join(c, list(keys), "full_outer").withColumn("side", side).drop("_b", "_c")


def gates(digest: tuple[str, str], quality: tuple[str, str], speed: tuple[str, str], slower_by: float) -> dict[str, Column]:
    """A changed digest, a drop in quality (from infinite to finite too), a speed that fell by more than so many percent."""
    return {
        "digest_changed": F.coalesce(F.col(digest[0]) != F.col(digest[1]), F.lit(False)),
        "quality_dropped": F.coalesce(F.col(quality[1]) < F.col(quality[0]), F.lit(False)),
        "slower": F.coalesce(percent_change(F.col(speed[0]), F.col(speed[1])) < -slower_by, F.lit(False)),
    }


CUTS = 63  # values that cut a group into ranges in one round


def value_at_rank(df: DataFrame, keys: Sequence[str], value: str, at: Column, name: str, most: int = 1_000_000) -> DataFrame:
    """(keys, name): each group's value at a 0-based rank, an expression of the group's size ``_n``; nulls don't count, null keys are a group.

    Selection over the cluster: a group of more than ``most`` rows is cut into ranges by approximate quantiles, rows are counted by range, and
    only the range that holds the rank stays, until it has at most ``most`` rows or one value. No task sorts more than that of a group, whatever its share of the table.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    same = lambda a, b: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys), F.lit(True))
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if (groups.agg(F.max("_n")).first()[0] or 0) <= most:
        w = Window.partitionBy(*keys)
        turns = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_turn", F.row_number().over(w.orderBy("_v")) - 1)
        return turns.where(F.col("_turn") == at).select(*keys, F.col("_v").alias(name))
    kind = rows.schema["_v"].dataType
    place = shared_folder(df.sparkSession, "ranks")

    def written(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{place}/{name}")
        return df.sparkSession.read.parquet(f"{place}/{name}")

    # the open range: rows above _low and below _high, _rows of them, the wanted one at place _at among them; _one if they are one value
    none = F.lit(None).cast(kind)
    open_ranges = written(groups.select(*keys, F.col("_n").alias("_rows"), at.cast("long").alias("_at"), none.alias("_low"), none.alias("_high"), none.alias("_one")), "0")
    step = 0
    while open_ranges.where((F.col("_rows") > most) & F.col("_one").isNull()).limit(1).count():
        large = open_ranges.where((F.col("_rows") > most) & F.col("_one").isNull())
        inside = _inside(rows, large, keys, same)
        shares = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
        cuts = written(inside.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", shares, 1000)).alias("_cuts")), f"cuts-{step}")
        # even numbers are the ranges between two cuts, odd ones the rows equal to a cut
        met = inside.alias("r").join(cuts.alias("c"), same(inside, cuts)).select(*(F.col(f"r.{k}").alias(k) for k in keys), "_v", "_cuts")
        below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        equal = F.exists("_cuts", lambda c: c == F.col("_v"))
        counts = met.groupBy(*keys, (2 * below + F.when(equal, 1).otherwise(0)).alias("_part")).agg(F.count(F.lit(1)).alias("_rows"), F.first("_cuts").alias("_cuts"))
        upto = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_part"))
        sums = counts.withColumn("_upto", upto)
        sums = sums.join(large.select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("_at").alias("_want"), F.col("_low").alias("_was"), F.col("_high").alias("_to")), reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys), F.lit(True)))
        held = sums.where((F.col("_upto") > F.col("_want")) & (F.col("_upto") - F.col("_rows") <= F.col("_want")))
        cut = lambda i: F.get("_cuts", i.cast("int"))
        i = F.floor(F.col("_part") / 2)
        found = held.select(
            *keys, "_rows", (F.col("_want") - (F.col("_upto") - F.col("_rows"))).alias("_at"), F.coalesce(F.when(i > 0, cut(i - 1)), F.col("_was")).alias("_low"), F.coalesce(cut(i), F.col("_to")).alias("_high"), F.when(F.col("_part") % 2 == 1, cut(i)).alias("_one")
        )
        step += 1
        small = open_ranges.where((F.col("_rows") <= most) | F.col("_one").isNotNull())
        open_ranges = written(small.unionByName(found), str(step))
    one = open_ranges.where(F.col("_one").isNotNull()).select(*keys, F.col("_one").alias(name))
    rest = open_ranges.where(F.col("_one").isNull())
    inside = _inside(rows, rest, keys, same)
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1
    numbered = inside.withColumn("_turn", turn)
    wanted = rest.select(*(F.col(k).alias(f"of_{k}") for k in keys), "_at")
    match = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys), F.col("_turn") == F.col("_at"))
    return numbered.join(wanted, match).select(*keys, F.col("_v").alias(name)).unionByName(one)


def _inside(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], same) -> DataFrame:
    """The rows in their groups' open ranges."""
    above = F.col("g._low").isNull() | (F.col("r._v") > F.col("g._low"))
    below = F.col("g._high").isNull() | (F.col("r._v") < F.col("g._high"))
    met = rows.alias("r").join(ranges.alias("g"), reduce(lambda x, y: x & y, (F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys), above & below))
    return met.select(*(F.col(f"r.{k}").alias(k) for k in keys), F.col("r._v").alias("_v"))


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return value_at_rank(df, keys, value, F.floor(F.col("_n") / 2), name)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """The value of rank ceil(share * n), from 1."""
    return value_at_rank(df, keys, value, F.greatest(F.ceil(F.col("_n") * share), F.lit(1)) - 1, name)


def throughput(df: DataFrame, keys: Sequence[str], work: str, milliseconds: str, name: str) -> DataFrame:
    """(keys, name): total work of a group over the upper median of its seconds."""
    total = df.groupBy(*(F.col(k).alias(f"of_{k}") for k in keys)).agg(F.sum(work).alias("_work"))
    middle = upper_median(df, keys, milliseconds, "_ms")
    match = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys), F.lit(True))
    return middle.join(total, match).select(*keys, F.try_divide(F.col("_work"), F.col("_ms") / 1000).alias(name))


def relative_window(df: DataFrame, ts: str, now: str, start: int, end: int, unit: str) -> DataFrame:
    """Rows between ``start`` and ``end`` units before a given now."""
    moment = F.lit(now).cast("timestamp")
    back = lambda n: moment - F.expr(f"INTERVAL {n} {unit}")
    return df.where((F.col(ts) >= back(start)) & (F.col(ts) <= back(end)))
