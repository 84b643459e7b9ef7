"""Sharding by size-tiered compaction, with DataFrame operations only.

Arrivals are appended as small immutable Parquet shards, one per write task or fewer rows, without a shuffle. Compaction sorts
the live shards of a store into tiers by size, and merges runs of similarly sized ones into files of the target size: the scan of a
tier packs whole files, in order of size, into tasks of the target size, and each task writes one file, so that no row is
shuffled and a merge costs one read and one write. What is live is said by a manifest, a small table with a row per shard. A
version of it becomes visible when its version file, written aside, is renamed into place without overwriting. So readers
see all of a change or nothing, a writer that dies leaves nothing that is read, and of two writers one starts again from the
other's version. (The rename is atomic on HDFS; a local file system checks for the target first.)

The driver sees shard paths, never rows: those of at most ``round_shards`` shards in a round of merges, and when rows are read,
those of the live shards (bytes of the corpus over the target size), which the file listing of any scan holds.

Defined cases: rows of any content, nulls and repeats included, are kept as they are; an empty arrival adds no shard and an
empty store reads as no rows; a row larger than the target makes a larger file; an arrival with further columns adds
them to the store, with nulls in rows from before; columns named like the manifest's don't clash with it, as a
shard holds the arrival's columns alone.
"""

from __future__ import annotations

import functools
import json
import math
import threading
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RENAMING = threading.Lock()
MANIFEST = "path string, bytes long, rows long, tier int, added long"


class VersionConflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Tiering:
    target_bytes: int = 32 << 20  # of a merged file
    base_bytes: int = 64 << 10  # upper end of tier 0
    growth: int = 4  # size ratio of neighbouring tiers
    least_run: int = 4  # shards of a tier that make a merge worthwhile
    full_share: float = 0.5  # a shard of this share of the target is never merged again
    arrival_rows: int = 5_000  # rows of a small shard at most
    round_shards: int = 100_000  # shards that a round of merges takes at most; the next round takes the others


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, tiering: Tiering = Tiering()):
        self.spark, self.root, self.tiering = spark, root.rstrip("/"), tiering
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for d in ("versions", "manifests", "shards"):
            self._fs.mkdirs(self._path(f"{self.root}/{d}"))

    # versions

    def version(self) -> int:
        """The newest committed version, 0 for a new store."""
        return max(map(int, self._version_names()), default=0)

    def _version_names(self) -> list[str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/versions"))]
        return [x for x in names if x.isdigit()]

    def _state(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/versions/{version:010d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{self._state(version)['manifest']}")

    def _commit(self, base: int, shards: DataFrame, schema: T.StructType) -> int:
        """Writes the manifest and the version file aside, then renames the latter; this fails if the version exists."""
        name = uuid.uuid4().hex
        shards.coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        aside = self._path(f"{self.root}/versions/.{name}.tmp")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps({"manifest": name, "schema": json.loads(schema.json())}).encode()))
        finally:
            stream.close()
        if not self._rename(aside, self._path(f"{self.root}/versions/{base + 1:010d}")):
            self._fs.delete(aside, False)
            raise VersionConflict(f"version {base + 1} was committed by another writer")
        return base + 1

    def _rename(self, source, target) -> bool:
        """Renames a file unless the target exists."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        try:
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        except Py4JJavaError:  # a file system without this interface
            return not self._fs.exists(target) and self._fs.rename(source, target)
        try:
            with _RENAMING:  # on a local file system, check and rename are two steps
                files.rename(source, target, self.spark.sparkContext._gateway.new_array(kind, 0))
        except Py4JJavaError:
            if self._fs.exists(source) and self._fs.exists(target):
                return False
            raise
        return True

    def _schema(self, version: int, arrival: T.StructType | None = None) -> T.StructType:
        """The columns of a version, and those that an arrival adds."""
        old = T.StructType.fromJson(self._state(version)["schema"]) if version else T.StructType()
        known = {f.name: f.dataType for f in old}
        for f in arrival or ():
            if known.setdefault(f.name, f.dataType) != f.dataType:
                raise ValueError(f"column {f.name} is {known[f.name].simpleString()} in the store and {f.dataType.simpleString()} in the arrival")
        return T.StructType(list(old) + [f for f in arrival or () if f.name not in old.names])

    # shards

    def _shards_under(self, folder: str, schema: T.StructType, version: int) -> DataFrame:
        """A manifest row for each file of a folder; only file metadata and row counts are read."""
        files = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        t = self.tiering
        tier = F.greatest(F.lit(0), F.ceil(F.log(F.col("bytes") / t.base_bytes) / math.log(t.growth))).cast("int")
        return files.groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("rows")).select("path", "bytes", "rows", tier.alias("tier"), F.lit(version).cast("long").alias("added"))

    def append(self, arrival: DataFrame) -> int:
        """Adds an arrival as small shards; returns the new version."""
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        arrival.write.option("maxRecordsPerFile", self.tiering.arrival_rows).option("compression", "zstd").parquet(folder)
        while True:
            base = self.version()
            shards = self.manifest(base).unionByName(self._shards_under(folder, arrival.schema, base + 1))
            try:
                return self._commit(base, shards, self._schema(base, arrival.schema))
            except VersionConflict:
                continue

    def plan(self, version: int) -> DataFrame:
        """(path, tier, bytes): the live shards that the next round merges.

        These are the unfinished shards of each tier that has a long enough run of them, or a run that fills a good part of a file;
        lower tiers go first where a round can't take all.
        """
        t = self.tiering
        live = self.manifest(version).where(F.col("bytes") < t.full_share * t.target_bytes)
        runs = live.groupBy("tier").agg(F.count(F.lit(1)).alias("run"), F.sum("bytes").alias("size"))
        runs = runs.where((F.col("run") > 1) & ((F.col("run") >= t.least_run) | (F.col("size") >= t.full_share * t.target_bytes)))
        return live.join(runs.select("tier"), "tier", "left_semi").orderBy("tier", "bytes", "path").limit(t.round_shards).select("path", "tier", "bytes")

    def _packed(self, paths: list[str], size: int, schema: T.StructType) -> DataFrame:
        """The rows of shards of ``size`` bytes together, one task for a merged file.

        A session of its own lets scans put whole files together up to the target size. Where that setting can't be changed,
        the scan's tasks are put together by number.
        """
        target = self.tiering.target_bytes
        session = self.spark.newSession()
        settings = {"spark.sql.files.maxPartitionBytes": str(target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        for key, value in settings.items():
            session.conf.set(key, value)
        rows = session.read.schema(schema).parquet(*paths)
        if any(session.conf.get(key) != value for key, value in settings.items()):
            rows = rows.coalesce(max(1, math.ceil(size / target)))
        return rows

    def compact(self) -> int | None:
        """One round of merges; returns the new version, or None if no tier has a run to merge."""
        base = self.version()
        if not base:
            return None
        chosen = self.plan(base).collect()  # paths of shards, not rows
        if len(chosen) < 2:
            return None
        schema = self._schema(base)
        tiers = []
        for tier in sorted({r["tier"] for r in chosen}):
            run = [r for r in chosen if r["tier"] == tier]
            tiers.append(self._packed([r["path"] for r in run], sum(r["bytes"] for r in run), schema))
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        functools.reduce(DataFrame.union, tiers).write.option("compression", "zstd").parquet(folder)
        gone = self.spark.createDataFrame([(r["path"],) for r in chosen], "path string")
        while True:
            now = self.version()
            old = self.manifest(now)
            if now != base and gone.join(old, "path", "left_anti").head(1):
                self._fs.delete(self._path(folder), True)  # another compaction has merged some of them: start again
                return self.compact()
            merged = self._shards_under(folder, schema, now + 1)
            if merged.count() >= len(chosen):  # nothing is gained, and another round would not gain more
                self._fs.delete(self._path(folder), True)
                return None
            try:
                return self._commit(now, old.join(gone, "path", "left_anti").unionByName(merged), self._schema(now))
            except VersionConflict:
                continue

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of the live shards, with ``_metadata.file_path`` to tell their shard."""
        version = self.version() if version is None else version
        schema = self._schema(version)
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, grace_seconds: int = 86_400) -> int:
        """Deletes shard files that an older version names and the newest doesn't, and what writers that died have left behind
        longer than ``grace_seconds`` ago; returns how many. Readers of older versions must have ended.
        """
        newest = self.version()
        if not newest:
            return 0
        states = sorted(int(x) for x in self._version_names())
        older = [f"{self.root}/manifests/{self._state(v)['manifest']}" for v in states if v < newest]
        live = self.manifest(newest).select("path")
        named = self.spark.read.schema(MANIFEST).parquet(*older).select("path").distinct().join(live, "path", "left_anti") if older else live.limit(0)
        gone = {self._path(r["path"]).toUri().getPath() for r in named.collect()}
        live = {self._path(r["path"]).toUri().getPath() for r in live.collect()}
        before = (time.time() - grace_seconds) * 1000
        dead = 0
        for status in self._fs.listStatus(self._path(f"{self.root}/versions")):
            if status.getPath().getName().endswith(".tmp") and status.getModificationTime() < before:
                self._fs.delete(status.getPath(), False)
        files = self._fs.listFiles(self._path(f"{self.root}/shards"), True)
        while files.hasNext():
            status = files.next()
            path = status.getPath()
            name = path.toUri().getPath()
            if name.endswith(".parquet") and (name in gone or name not in live and status.getModificationTime() < before):
                self._fs.delete(path, False)
                dead += 1
        return dead


def compact_fully(store: ShardStore) -> int:
    """Rounds until no tier has a run to merge; each leaves fewer shards."""
    while store.compact() is not None:
        pass
    return store.version()


def shard_documents(arrivals: list[DataFrame], root: str, tiering: Tiering = Tiering()) -> tuple[ShardStore, int]:
    """Appends tables one after the other, compacts the store and deletes the shards that were merged."""
    store = ShardStore(arrivals[0].sparkSession, root, tiering)
    for arrival in arrivals:
        store.append(arrival)
    version = compact_fully(store)
    store.vacuum()
    return store, version
