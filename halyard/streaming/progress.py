"""Transfer progress: status classes, counters, throttled logs. All forms are the same over a stream's micro-batches and over a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILED, WARNING, COMPLETED = "failed", "warning", "completed"


def status(event: Column) -> Column:
    return F.when(event == "error", FAILED).when(event == "view", WARNING).otherwise(COMPLETED)


def dimse_status(code: Column) -> Column:
    """Status codes of transfers: 0 is success, three codes are warnings, others failures."""
    return F.when(code == 0x0000, COMPLETED).when(code.isin(0xB000, 0xB006, 0xB007), WARNING).otherwise(FAILED)


def counters(column: str, total: int) -> list[Column]:
    """Completed, failed and warning counts, and what remains of a total: at least one less than one."""
    counts = [F.coalesce(F.sum(F.when(F.col(column) == s, 1)), F.lit(0)).alias(s) for s in (COMPLETED, FAILED, WARNING)]
    return [*counts, (F.greatest(F.lit(total) - F.count(F.lit(1)), F.lit(1)) - 1).alias("remaining")]


def message(completed: Column, failed: Column, warning: Column, remaining: Column, comment: Column | None = None) -> Column:
    """What is to be said about an operation: an error comment that is not blank first, then its counts that are not zero."""
    total = completed + failed + warning + remaining
    return F.concat_ws(
        ", ",
        F.when(F.length(F.trim(comment)) > 0, comment) if comment is not None else F.lit(None).cast("string"),
        F.when(failed > 0, F.format_string("%d of %d failed", failed, total)),
        F.when(remaining > 0, F.format_string("%d remaining", remaining)),
        F.when(warning > 0, F.format_string("%d with warnings", warning)),
    )


def in_flight(events: DataFrame, key: str, starts: Column) -> DataFrame:
    """(key, open): starts less ends of each key; a key with none open is gone."""
    return events.groupBy(key).agg(F.sum(F.when(starts, 1).otherwise(-1)).alias("open")).where("open <> 0")


def throttled(df: DataFrame, key: str, order: Sequence[str], column: str, most: int) -> DataFrame:
    """The first rows of each key where the status changes, ``most`` of them."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.coalesce(F.col(column) != F.lag(column).over(w), F.lit(True))
    df = df.withColumn("_changed", changed)
    return df.withColumn("_n", F.sum(F.col("_changed").cast("int")).over(w)).where("_changed").where(F.col("_n") <= most).drop("_changed", "_n")


def last_failed(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Adds whether the number of failures has grown since the row before; false on a key's first row."""
    w = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("_failed", F.sum((F.col("status") == FAILED).cast("int")).over(w))
    return df.withColumn("last_failed", F.coalesce(F.col("_failed") > F.lag("_failed").over(w), F.lit(False))).drop("_failed")
