"""Mixing sources to target weights by weighted fair queueing.

Each document of a source stands in a queue in a fixed shuffled order, and the whole queue repeats up to
``max_repeats`` times. A document's virtual finish time is the number of its source's words up to and including it,
divided by the source's target. All queue entries are sorted by finish time over the cluster, and the mix is what
comes before the total budget is used up; then a source that a long document at the cut left off its target gains or loses a copy or
two. Running sums come in two steps (ranges of the order, then rows within a range), and every row has a number of its own as the
last tie, so that neither a source with a third of all rows nor a flood of equal rows is one task's work.

Defined cases: a null or empty text has size 0; a null source is a source of its own, last in order; null and repeated ids are
rows like others, each taken by itself; rows equal in id and text are interchangeable; an empty table gives an empty result;
targets of an all-empty corpus are 0; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, share_of: int = 1, weights: int = 3, cap: int = 3) -> DataFrame:
    """Targets of (source, source_size): weights 1..``weights`` repeating by code point, null last; the sum of all sizes is dealt
    by weight, no target exceeds ``cap`` times its source's size, and what is cut off goes to the others by weight.

    Filling by level: with sources in order of size/weight, the first ones are at their cap and the rest share the remainder.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = sizes.withColumn("weight", (F.row_number().over(order) - 1) % weights + 1)
    by_level = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").isNull(), F.col("source"))
    all_rows = Window.partitionBy(F.lit(0))
    w = (
        w.withColumn("total", F.sum("source_size").over(all_rows) * share_of)
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        # capped if its share of what is left over by the sources before it would exceed its cap
        .withColumn("capped", (F.col("total") - cap * F.col("size_before")) * F.col("weight") >= cap * F.col("source_size") * F.col("weight_from"))
    )
    w = w.withColumn("left_over", F.col("total") - cap * F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(all_rows), F.lit(0)))
    w = w.withColumn("weight_left", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(all_rows))
    target = F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(
        (F.col("left_over") * F.col("weight")).cast("double") / F.col("weight_left")
    )
    return w.select("source", "source_size", target.alias("target"))


def _running_sum(df: DataFrame, by: list[str], order: list[str], value: str, out: str, scratch: Scratch, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to and including each row in ``order`` among rows equal in ``by``, nulls included.

    The rows are range-partitioned; a range's sum goes to those behind it, so no task holds more than a range.
    """
    ranged = scratch.save(df.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()), name)  # the ranges are fixed once they are written
    sums = ranged.groupBy("part", *by).agg(F.sum(value).alias("part_sum"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("part").alias("p"), *(F.col(c).alias(f"p_{c}") for c in by), F.coalesce(F.sum("part_sum").over(before), F.lit(0)).alias("ahead"))
    sums = scratch.save(sums, f"{name}-sums")
    same = F.col("part") == F.col("p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    within = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.withColumn(out, F.sum(value).over(within)).join(sums, same).withColumn(out, F.col(out) + F.col("ahead")).select(*df.columns, out)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: int = 3,
    seed: str = "mix-1",
    settle_steps: int = 2,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, taken (words, repeats counted), copies (whole copies taken) and
    row (the number in ``row_col``, else one that tells the rows apart).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    number = docs[row_col] if row_col else F.monotonically_increasing_id()
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), docs[text_col].cast("string").alias("text"), number.alias("row"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"), F.md5("text")))
    rows = scratch.save(rows.select("id", "source", size.alias("size"), draw.alias("draw"), "row"), "rows")
    sizes = scratch.save(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    targets = scratch.save(source_targets(sizes, cap=max_repeats).withColumnRenamed("source", "s"), "targets")
    budget = targets.agg(F.round(F.sum("target")).cast("long").alias("budget")).first()["budget"] or 0
    order = ["draw", "id", "size", "row"]
    rows = _running_sum(rows, ["source"], order, "size", "upto", scratch, "queues")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    queue = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    finish = F.when(F.col("target") > 0, (F.col("turn") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")).otherwise(0.0)
    queue = queue.select("id", "size", "source", "source_size", "target", "draw", "row", "turn", finish.alias("finish"))
    queue = _running_sum(queue, [], ["finish", *order, "turn"], "size", "used", scratch, "queue")
    # where a long document leaves its source short, the budget reaches past the other sources' targets: what lies there for the most part stays out
    inside = (F.col("used") <= budget) & (F.col("finish") * F.col("target") - F.col("size") / 2 <= F.col("target"))
    first = [F.first(c).alias(c) for c in ("id", "draw", "size", "source", "source_size", "target")]  # the same in each turn of a row
    taken = queue.groupBy("row").agg(*first, F.sum(inside.cast("long")).alias("copies"))
    taken = scratch.save(taken.select("id", "draw", "size", "source", "source_size", "target", "row", "copies"), "taken-0")
    scratch.drop("rows", "queues", "queue")
    for step in range(1, settle_steps + 1):
        taken = scratch.save(_settle(taken, max_repeats), f"taken-{step}")
        scratch.drop(f"taken-{step - 1}")
    return taken.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "row")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3) -> DataFrame:
    """The rows of a table, each as many times as the mix takes it, columns as they are.

    Rows are numbered once and written with their numbers, so that what is planned for a row is done to that row.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    numbered = scratch.save(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    fields = numbered.select(*(F.col("row").getField(c).alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (source_col, "source"))), "number")
    taken = mix_sources(fields, "id", "text", "source", max_repeats, row_col="number").where("copies > 0").select(F.col("row").alias("of"), "copies")
    rows = numbered.join(taken, F.col("number") == F.col("of")).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("turn"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _settle(taken: DataFrame, max_repeats: int) -> DataFrame:
    """Adds or drops one copy in each source whose words miss the target, if a document of about that size brings them nearer.

    A long document at the cut leaves its source short, or the others long, by up to its size; this matters for small sources only.
    """
    gaps = taken.groupBy(F.col("source").alias("s")).agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    near = taken.join(gaps, F.col("source").eqNullSafe(F.col("s")))
    can = F.when(F.col("gap") > 0, F.col("copies") < max_repeats).otherwise(F.col("copies") > 0)
    near = near.where(can & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap")))
    pick = near.groupBy("source").agg(F.min(F.struct(F.abs(F.abs("gap") - F.col("size")).alias("miss"), "draw", "id", "size", "row", F.signum("gap").cast("long").alias("change"))).alias("p"))
    pick = pick.select(F.col("p.row").alias("p_row"), F.col("p.change").alias("p_change"))  # a row for each source at most
    out = taken.join(pick, F.col("row") == F.col("p_row"), "left")
    return out.select(*(c for c in taken.columns if c != "copies"), (F.col("copies") + F.coalesce("p_change", F.lit(0))).alias("copies"))
