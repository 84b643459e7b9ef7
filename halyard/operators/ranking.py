"""Ranks over a whole table, without a window that has the table in one task.

Rows are dealt to ranges of the order and written; the sizes of the ranges say how many rows lie before each, and a window numbers
the rows inside a range. Every row has a number of its own as the last tie, so that a flood of equal rows is cut into ranges too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.shared import shared_folder


def ranked(df: DataFrame, order: list[Column], out: str = "rank", folder: str | None = None) -> DataFrame:
    """The table with each row's place in ``order``, from 1; rows that tie get consecutive places.

    ``order`` has sort expressions over the table's columns. Ranges are written to ``folder`` (a new shared folder if None), which cuts
    lineage: a lost executor costs a range at most, and places are the same in a repeated task.
    """
    spark = df.sparkSession
    place = folder or shared_folder(spark, "ranges")
    names = {c.lower() for c in df.columns}
    part, row, ahead = (next(n for n in (base, *(f"{base}_{i}" for i in range(len(names) + 1))) if n not in names) for base in ("range_no", "row_no", "rows_ahead"))
    numbered = df.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(*order, F.col(row))
    numbered.withColumn(part, F.spark_partition_id()).write.parquet(place)
    ranges = spark.read.parquet(place)
    sizes = ranges.groupBy(part).agg(F.count(F.lit(1)).alias("rows_in")).select(F.col(part).alias("of"), "rows_in")  # a row a range
    before = sizes.select("of", F.coalesce(F.sum("rows_in").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(ahead))
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order, F.col(row)))
    joined = ranges.withColumn(out, within.cast("long")).join(F.broadcast(before), F.col(part) == F.col("of"))
    return joined.withColumn(out, F.col(out) + F.col(ahead)).select(*df.columns, out)
