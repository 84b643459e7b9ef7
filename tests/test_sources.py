from pyspark.sql import functions as F

from halyard.sources import multipart, tables


def test_reports(spark, tmp_path):
    head = ",".join(tables.REPORT)
    row = lambda file, mpps, psnr: ",".join({"file": file, "dst_ts": "x", "decode_mpps": mpps, "psnr_db": psnr}.get(c, "") for c in tables.REPORT)
    (tmp_path / "r.csv").write_text("\n".join([head, row("a", "1.5", "inf"), row("b", "n/a", " "), row("a", "2.5", "40")]) + "\n")
    got = {r.file: (r.decode_mpps, r.psnr_db) for r in tables.benchmark_report(spark, str(tmp_path)).collect()}
    assert got == {"a": (2.5, 40.0), "b": (None, None)}


def test_property_tables(spark, tmp_path):
    (tmp_path / "p.properties").write_text("# note\n1.2.3 = a, b\n1.2.4:\n\n")
    got = {r.key: r["values"] for r in tables.property_table(spark, str(tmp_path)).collect()}
    assert got == {"1.2.3": ["a", "b"], "1.2.4": []}


def test_files_that_start_like_dicom(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "yes").write_bytes(bytes(128) + b"DICM" + bytes(9))
    (tmp_path / "no").write_bytes(b"DICM")
    got = {r.path.rsplit("/", 1)[1]: r.is_dicom for r in tables.dicom_files(spark, str(tmp_path)).collect()}
    assert got == {"yes": True, "no": False}


def test_boundaries(spark):
    cases = {
        'multipart/related; type="a"; boundary="x y"': "x y",
        "Multipart/Related; boundary=abc; type=b": "abc",
        "multipart/related": None,
        "text/plain; boundary=abc": None,
    }
    for text, want in cases.items():
        assert spark.range(1).select(multipart.boundary(F.lit(text))).first()[0] == want


def test_bodies_without_an_end_or_a_boundary(spark):
    rows = [(1, bytearray(b"pre\r\n--b\r\nA: 1\r\n\r\nx\r\n--b\r\n\r\ny"), "b"), (2, bytearray(b"nothing"), "b"), (3, None, "b"), (4, bytearray(b"--b\r\n\r\nz\r\n--b--"), None)]
    got = multipart.parts(spark.createDataFrame(rows, "id long, body binary, mark string"), "id", "body", "mark").collect()
    assert [(r.part, r.headers, bytes(r.content)) for r in got if r.id == 1] == [(0, {"a": "1"}, b"x"), (1, {}, b"y")]
    assert {r.id for r in got} == {1}


def test_kinds_of_files_and_short_ones(spark, tmp_path):
    (tmp_path / "bare").write_bytes(bytes([8, 0, 5, 0, 67, 83]))
    (tmp_path / "a.xml").write_text("<x/>")
    (tmp_path / "empty").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r.kind for r in tables.dicom_files(spark, str(tmp_path)).collect()}
    assert got == {"bare": "dicom", "a.xml": "xml"}  # Spark lists no empty files


def test_window_presets(spark, tmp_path):
    (tmp_path / "p.xml").write_text(
        '<presets><preset name="A" modality="CT" window="110" level="35.5" key="51"/><preset name="B" modality="MR" window="9" level="1" shape="SIGMOID"/><preset name="C" modality="CT" window="5"/></presets>'
    )
    got = sorted(map(tuple, tables.window_presets(spark, str(tmp_path / "p.xml")).collect()))
    assert got == [("CT", "A", 110.0, 35.5, "LINEAR", 51), ("MR", "B", 9.0, 1.0, "SIGMOID", None)]


def test_tables_of_classes(spark, tmp_path):
    (tmp_path / "p.properties").write_text("1.1 = a, b\n1.2:\n")
    t = tables.property_table(spark, str(tmp_path))
    assert sorted(map(tuple, tables.capabilities(t).collect()), key=str) == [("1.1", "a"), ("1.1", "b"), ("1.2", None)]
    assert sorted(map(tuple, tables.related_classes(t).collect())) == [("a", "1.1"), ("b", "1.1")]
