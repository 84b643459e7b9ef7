"""Archives: every syntax and sequence form, pruning, broken files, and a sink that commits whole jobs only."""

import os
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from halyard.sources import archive
from halyard.sources.elements import BIG_ENDIAN, DEFLATED, EXPLICIT, IMPLICIT, LONG, tag_of

CLASS = "1.2.840.10008.5.1.4.1.1.4"


def el(name, data, syntax=EXPLICIT, vr=None):
    tag, known = tag_of(name)
    vr = vr or known
    end = ">" if syntax == BIG_ENDIAN else "<"
    head = struct.pack(end + "HH", tag >> 16, tag & 0xFFFF)
    n = len(data)
    if syntax == IMPLICIT:
        return head + struct.pack(end + "I", n) + data
    return head + vr.encode() + (b"\0\0" + struct.pack(end + "I", n) if vr in LONG else struct.pack(end + "H", n)) + data


def text(s, vr="LO"):
    b = s.encode()
    return b + (b"\0" if vr == "UI" else b" ") * (len(b) % 2)


def sequence(name, rows, syntax=EXPLICIT, open_ended=False):
    end = ">" if syntax == BIG_ENDIAN else "<"
    mark = lambda tag, n: struct.pack(end + "HHI", tag >> 16, tag & 0xFFFF, n)
    body = b"".join(mark(0xFFFEE000, 0xFFFFFFFF if open_ended else len(r)) + r + (mark(0xFFFEE00D, 0) if open_ended else b"") for r in rows)
    tag, _ = tag_of(name)
    head = struct.pack(end + "HH", tag >> 16, tag & 0xFFFF) + (b"" if syntax == IMPLICIT else b"SQ\0\0")
    return head + struct.pack(end + "I", 0xFFFFFFFF if open_ended else len(body)) + body + (mark(0xFFFEE0DD, 0) if open_ended else b"")


def data_set(syntax, open_ended, uid="1.2.3"):
    end = ">" if syntax == BIG_ENDIAN else "<"
    us = lambda *n: struct.pack(f"{end}{len(n)}H", *n)
    image = lambda k: el("ReferencedSOPInstanceUID", text(f"9.{k}", "UI"), syntax) + el("ReferencedFrameNumber", text("1\\2"), syntax)
    series = lambda k: sequence("ReferencedImageSequence", [image(10 * k), image(10 * k + 1)], syntax, open_ended) + el("SeriesInstanceUID", text(f"8.{k}", "UI"), syntax)
    private = sequence("x00091010", [sequence("x00091011", [el("PatientID", b"no", syntax)], syntax, True)], syntax, True) if open_ended else el("x00091010", b"\x01" * 70_000, syntax, "OB")
    return (
        el("SpecificCharacterSet", text("ISO_IR 192"), syntax)
        + el("SOPClassUID", text(CLASS, "UI"), syntax)
        + el("SOPInstanceUID", text(uid, "UI"), syntax)
        + sequence("ReferencedSeriesSequence", [series(1), series(2)], syntax, open_ended)
        + private
        + el("PatientName", text("Müller^Jörg"), syntax)
        + el("Rows", us(512), syntax)
        + el("WindowCenter", text("40.5\\-1e2"), syntax)
        + el("PixelData", b"\x7f" * 5000, syntax)
    )


def whole(syntax, data, uid="1.2.3", meta=True):
    if not meta:
        return data
    m = el("FileMetaInformationVersion", b"\0\1") + el("MediaStorageSOPClassUID", text(CLASS, "UI")) + el("MediaStorageSOPInstanceUID", text(uid, "UI")) + el("TransferSyntaxUID", text(syntax, "UI"))
    m = struct.pack("<HH2sHI", 2, 0, b"UL", 4, len(m)) + m
    if syntax == DEFLATED:
        z = zlib.compressobj(wbits=-15)
        data = z.compress(data) + z.flush()
    return bytes(128) + b"DICM" + m + data


SCHEMA = """path string, length long, position long, syntax string, class_uid string, instance_uid string, PatientName string, Rows int, WindowCenter array<double>,
 ReferencedSeriesSequence array<struct<SeriesInstanceUID:string,ReferencedImageSequence:array<struct<x00081155:string,ReferencedFrameNumber:array<int>>>>>, error string"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("archive")
    (d / "a" / "b").mkdir(parents=True)
    (d / "_hidden").mkdir()
    files = {f"a/{i}-{int(o)}-{int(m)}.dcm": (s, o, m) for i, s in enumerate((EXPLICIT, IMPLICIT, BIG_ENDIAN, DEFLATED)) for o in (False, True) for m in (True, False) if m or s in (EXPLICIT, IMPLICIT)}
    for name, (s, o, m) in files.items():
        (d / name).write_bytes(whole(s, data_set(s, o), meta=m))
    full = whole(EXPLICIT, data_set(EXPLICIT, False))
    cut = full.index(b"\x09\x00\x10\x10")
    (d / "a/b/cut.dcm").write_bytes(full[: cut + 40])
    (d / "a/b/text.txt").write_bytes(b"not an image at all" * 20)
    (d / "a/b/empty").write_bytes(b"")
    (d / "a/b/odd.dcm").write_bytes(whole(EXPLICIT, el("SOPClassUID", text(CLASS, "UI")) + b"\x10\x00\x10\x00??\x00\x00"))
    (d / "_hidden/x.dcm").write_bytes(full)
    (d / "a/one.xml").write_text(
        f"""<NativeDicomModel><DicomAttribute tag="00080016" vr="UI"><Value number="1">{CLASS}</Value></DicomAttribute><DicomAttribute tag="00080018" vr="UI"><Value number="1">1.2.3</Value></DicomAttribute>
        <DicomAttribute tag="00081115" vr="SQ"><Item number="1"><DicomAttribute tag="0020000E" vr="UI"><Value number="1">8.1</Value></DicomAttribute></Item></DicomAttribute>
        <DicomAttribute tag="00100010" vr="PN"><PersonName number="1"><Alphabetic><FamilyName>Müller</FamilyName><GivenName>Jörg</GivenName></Alphabetic></PersonName></DicomAttribute>
        <DicomAttribute tag="00280010" vr="US"><Value number="1">512</Value></DicomAttribute></NativeDicomModel>"""
    )
    return d, files


def test_every_syntax_and_form(spark, folder):
    d, files = folder
    archive.register(spark)
    rows = {r.path.split("/archive", 1)[1].split("/", 1)[1]: r for r in spark.read.format("archive").schema(SCHEMA).load(str(d)).collect()}
    assert len(rows) == len(files) + 5 and not any("hidden" in p for p in rows)
    images = [[(f"9.{10 * k}", [1, 2]), (f"9.{10 * k + 1}", [1, 2])] for k in (1, 2)]
    for name, (syntax, _, meta) in files.items():
        r = rows[name]
        assert r.error is None and (r.syntax, r.class_uid, r.instance_uid) == (syntax, CLASS, "1.2.3")
        assert r.length == os.path.getsize(d / name) and r.position == ((d / name).read_bytes().index(b"\x08\x00\x05\x00") if meta and syntax not in (BIG_ENDIAN, DEFLATED) else r.position)
        assert r.PatientName == "Müller^Jörg" and r.Rows == 512 and r.WindowCenter == [40.5, -100.0]
        assert [(s.SeriesInstanceUID, [tuple(i) for i in s.ReferencedImageSequence]) for s in r.ReferencedSeriesSequence] == [(f"8.{k + 1}", images[k]) for k in (0, 1)]
    x = rows["a/one.xml"]
    assert (x.position, x.syntax, x.class_uid, x.PatientName, x.Rows, x.ReferencedSeriesSequence[0].SeriesInstanceUID, x.error) == (-1, EXPLICIT, CLASS, "Müller^Jörg", 512, "8.1", None)


def test_bad_files_are_rows(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in spark.read.format("archive").schema(SCHEMA).load(str(folder[0] / "a/b")).collect()}
    assert set(rows) == {"cut.dcm", "text.txt", "empty", "odd.dcm"} and all(r.error for r in rows.values())
    cut = rows["cut.dcm"]  # what stands before the end is there
    assert cut.error.startswith("EOFError") and cut.instance_uid == "1.2.3" and len(cut.ReferencedSeriesSequence) == 2 and cut.PatientName is None
    assert "representation" in rows["odd.dcm"].error and rows["empty"].length == 0
    one = spark.read.format("archive").load(str(folder[0] / "a/b/cut.dcm")).collect()
    assert len(one) == 1 and one[0].error is None  # nothing that lies behind the cut was asked for


class Counting:
    def __init__(self, raw):
        self.raw, self.seen = raw, 0

    def __getattr__(self, name):
        return getattr(self.raw, name)

    def read(self, n=-1):
        data = self.raw.read(n)
        self.seen += len(data)
        return data


def test_only_named_tags_are_read(folder):
    import io

    from pyspark.sql import types as T

    data = whole(EXPLICIT, data_set(EXPLICIT, False))
    for names, most in ((["Modality"], 700), (["PatientName"], 900), (["Rows", "WindowCenter"], 900)):
        stream = Counting(io.BufferedReader(io.BytesIO(data), 16))
        found = archive.read_file(stream, archive.Wanted.of([T.StructField(n, T.StringType()) for n in names]), len(data), False)
        next(found)
        next(found, None)
        assert stream.seen < most < 70_000 < len(data)


def test_partitions_by_bytes(folder):
    reader = archive.ArchiveReader(__import__("pyspark").sql.types.StructType([]), {"path": str(folder[0]), "bytesPerPartition": "100000", "openCost": "1000"})
    parts = reader.partitions()
    files = [p for part in parts for p, _ in part.paths]
    assert len(parts) > 2 and files == sorted(files) and len(set(files)) == len(files)
    assert all(sum(n + 1000 for _, n in part.paths[:-1]) < 100_000 for part in parts)


def test_a_stream_of_arrivals(spark, tmp_path):
    archive.register(spark)
    d, out = tmp_path / "in", tmp_path / "out"
    d.mkdir()
    (d / "1.dcm").write_bytes(whole(EXPLICIT, data_set(EXPLICIT, False, "1.1"), "1.1"))

    def run():
        time.sleep(0.3)
        s = spark.readStream.format("archive").option("settleSeconds", "0.1").schema("instance_uid string, PatientName string").load(str(d))
        s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(out)).awaitTermination()
        return sorted(r.instance_uid for r in spark.read.parquet(str(out)).collect())

    assert run() == ["1.1"]
    (d / "2.dcm").write_bytes(whole(IMPLICIT, data_set(IMPLICIT, True, "1.2"), "1.2"))
    assert run() == ["1.1", "1.2"]
    assert run() == ["1.1", "1.2"]


def stored(place):
    return {str(p.relative_to(place)): p.read_bytes() for p in place.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_sink_writes_each_row_once(spark, tmp_path):
    archive.register(spark)
    place = tmp_path / "store"
    df = spark.range(50).repartition(4).select(F.concat(F.col("id") % 3, F.lit("/"), "id", F.lit(".dcm")).alias("name"), F.encode(F.concat(F.lit("v"), "id"), "UTF-8").alias("content"))
    want = {f"{i % 3}/{i}.dcm": f"v{i}".encode() for i in range(50)}
    df.write.format("archive").mode("append").save(str(place))
    assert stored(place) == want
    with pytest.raises(Exception, match="nothing was written"):
        df.write.format("archive").mode("append").save(str(place))
    assert stored(place) == want
    changed = df.withColumn("content", F.lit(b"w"))
    changed.write.format("archive").mode("append").option("existing", "skip").save(str(place))
    assert stored(place) == want
    changed.where("name like '1/%'").write.format("archive").mode("append").option("existing", "replace").save(str(place))
    assert stored(place) == {k: b"w" if k[0] == "1" else v for k, v in want.items()}
    df.limit(3).coalesce(1).write.format("archive").mode("overwrite").save(str(place))
    assert len(stored(place)) == 3


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    archive.register(spark)
    place = tmp_path / "store"
    place.mkdir()
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") == 17, "../out").otherwise(F.concat("id", F.lit(".dcm"))).alias("name"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="no file name"):
        bad.write.format("archive").mode("append").save(str(place))
    assert stored(place) == {}
    # an attempt that died before its message was sent leaves files that no commit moves
    writer = archive.ArchiveWriter({"path": str(place)}, False)
    import pyarrow as pa

    batch = lambda n: pa.RecordBatch.from_pydict({"name": [f"{n}.dcm"], "content": [b"x"]})

    def dies():
        yield batch(1)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    again = writer.write(iter([batch(1)]))
    writer.commit([again, None])
    assert stored(place) == {"1.dcm": b"x"} and not (place / "_temporary").exists()
    with pytest.raises(Exception, match="two rows"):
        spark.createDataFrame([("a", b""), ("a", b"")], "name string, content binary").coalesce(1).write.format("archive").mode("append").save(str(place))
