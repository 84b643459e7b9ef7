"""The driver's tables under the names that imaging concepts have in this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.shared import shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame, rows: int = 1_000_000) -> int:
    """So many partitions that one has about ``rows`` rows, so that a task's memory doesn't grow with the table; no fewer than is set. Files tell their number of rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def tally(df: DataFrame) -> DataFrame:
    """What a filter on line items lets through: rows and key sums by flag and status."""
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("orderkeys"), F.sum("l_partkey").alias("partkeys"))


def tally_sql(where: str, source: str = "lineitem") -> str:
    return f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orderkeys, CAST(sum(l_partkey) AS BIGINT) AS partkeys FROM {source} WHERE {where} GROUP BY ALL"

