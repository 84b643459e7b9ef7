"""File sources with fixed schemas: benchmark reports, property tables, DICOM headers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import manifest

_TEXT = {"file", "src_ts", "decoder", "decode_sha1", "dst_ts", "enc_sha1", "encoder"}
#: fixed values: columns of a benchmark report
REPORT = (
    "file frames rows cols mp_per_frame src_ts decoder decode_med_ms decode_p95_ms decode_mpps decode_sha1 dst_ts transcode_med_ms"
    " transcode_p95_ms transcode_mpps out_kb enc_sha1 psnr_db ssim encoder encode_med_ms encode_p95_ms encode_mpps"
).split()


def benchmark_report(spark: SparkSession, path: str) -> DataFrame:
    """A report: blank or malformed numbers are null, ``inf`` is infinity, and of two rows of a file and target the later counts.

    Later is further down in a file; between files, that of the greater name.
    """
    raw = spark.read.schema(", ".join(f"{c} string" for c in REPORT)).option("header", True).csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_line"))
    last = manifest.last_by_struct(raw, ["file", "dst_ts"], ["_path", "_line"])
    number = lambda c: F.when(F.lower(F.trim(c)) == "inf", float("inf")).otherwise(F.trim(c).try_cast("double"))
    return last.select(*(F.col(c) if c in _TEXT else number(F.col(c)).alias(c) for c in REPORT))


def property_table(spark: SparkSession, path: str) -> DataFrame:
    """``key = a, b`` lines as (key, values)."""
    lines = spark.read.text(path).where(F.trim("value").rlike("^[^#!]")).select(F.split("value", "[=:]", 2).alias("p"))
    return lines.select(F.trim(F.element_at("p", 1)).alias("key"), F.filter(F.transform(F.split(F.coalesce(F.try_element_at("p", F.lit(2)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "").alias("values"))


def capabilities(table: DataFrame) -> DataFrame:
    """(class, syntax) pairs of a property table of storage classes, a class without a list with a null syntax."""
    return table.select(F.col("key").alias("class"), F.explode_outer("values").alias("syntax"))


def related_classes(table: DataFrame) -> DataFrame:
    """(related, general): the general class of each class named in a property table of general classes."""
    return table.select(F.explode("values").alias("related"), F.col("key").alias("general"))


def window_presets(spark: SparkSession, path: str) -> DataFrame:
    """(modality, name, window, level, shape, key) of the ``preset`` elements of an XML file; one without name, modality, window and level is skipped."""
    names = {"name": "string", "modality": "string", "window": "double", "level": "double", "shape": "string", "key": "int"}
    raw = spark.read.format("xml").option("rowTag", "preset").option("attributePrefix", "_").schema(", ".join(f"_{n} {t}" for n, t in names.items())).load(path)
    rows = raw.select(*(F.col(f"_{n}").alias(n) for n in names)).dropna(subset=["name", "modality", "window", "level"])
    return rows.select("modality", "name", "window", "level", F.coalesce("shape", F.lit("LINEAR")).alias("shape"), "key")


HEAD = 132


def looks_like_dicom(head: Column) -> Column:
    """A prefix after the preamble, or a first tag of group 2 or 8 in either byte order."""
    tag = F.hex(F.substring(head, 1, 2))
    return F.coalesce((F.substring(head, 129, 4) == F.lit(bytearray(b"DICM"))) | tag.isin("0200", "0800", "0002", "0008"), F.lit(False))


def dicom_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder with what they look like: DICOM, XML (by name), or neither. Of each file only its head is read.

    Spark lists the files, empty ones apart; tasks open them by Arrow's file systems, for the schemes that these know.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(place) as stream:
                    out.append(stream.read(HEAD))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "head"])

    got = files.mapInArrow(heads, "path string, length long, modificationTime timestamp, head binary")
    kind = F.when(looks_like_dicom(F.col("head")), "dicom").when(F.lower("path").endswith(".xml"), "xml").otherwise("other")
    return got.select("path", "length", "modificationTime", (kind == "dicom").alias("is_dicom"), kind.alias("kind"))
