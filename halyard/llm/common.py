"""Helpers shared by the corpus operators: written intermediate tables and byte views of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one is made only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("halyard.scratch.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="halyard-")
        spark.conf.set("halyard.scratch.dir", found)
    return found


class Scratch:
    """Intermediate tables in the shared folder. A written table cuts lineage and outlives any executor.

    Tables that a result still reads go when the application ends; ``drop`` removes the others earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/halyard-{name}-{uuid.uuid4().hex[:12]}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs = fs
        fs.mkdirs(self._path(self.root))
        fs.deleteOnExit(self._path(self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(self.path(name)), True)


def spread(df: DataFrame) -> DataFrame:
    """The table over all cores, where its files make fewer scan tasks than there are; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Runs of rows whose texts sum to about ``limit`` bytes, so that numpy temporaries stay small: (start, stop, texts)."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop, col.slice(start, stop - start).cast(pa.binary()).to_pylist()
        start = stop


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(29))
    h = h * U64(0xA0761D6478BD642F)
    return h ^ (h >> U64(32))


def total_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows and text bytes of a table (two numbers reach the driver)."""
    from pyspark.sql import functions as F

    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return int(row["n"] or 0), int(row["b"] or 0)
