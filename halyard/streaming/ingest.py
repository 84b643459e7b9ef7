"""Receiving instances as a stream: a file source, a transformation, and an idempotent sink; rows that an editor refuses go aside."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, folder: str, like: DataFrame, pattern: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as they come, with the schema of a known table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def forward(stream: DataFrame, editors: Sequence[Callable[[DataFrame], DataFrame]], refuse: Column, sink: str, aside: str, checkpoint: str) -> StreamingQuery:
    """Edits each micro-batch and writes it under its batch number, refused rows to a folder of their own. A batch is read once: it is kept while both are written.

    A batch that is run again after a failure replaces what it wrote before, so every row arrives once.
    """

    def write(batch: DataFrame, number: int) -> None:
        refused = F.coalesce(refuse, F.lit(False))
        batch.persist()
        try:
            batch.where(refused).write.mode("overwrite").parquet(f"{aside}/batch={number}")
            kept = batch.where(~refused)
            for f in editors:
                kept = f(kept)
            kept.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idle_sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key that end after a gap without rows; rows later than ``late`` are left out."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need instants
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n")


def running_counts(stream: DataFrame, key: str, status: Column) -> DataFrame:
    return stream.groupBy(key, status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
