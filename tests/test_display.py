"""Decisions that queries over the driver's tables can't show."""

import pytest
from pyspark.sql import functions as F

from halyard.functions import attributes, display, geometry, hashing
from halyard.functions.multivalue import Values
from halyard.operators import find, hanging


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_segments():
    assert display.inflate_segments([0, 2, 0x100, 0x200, 1, 2, 0x400], 4) == [1, 2, 3, 4]
    assert display.inflate_segments([0, 1, 0x500, 2, 1, 0, 0], 3) == [5, 5, 0]
    assert display.inflate_segments([0, 1, 0x1000, 1, 3, 0], 4) == [0x10, 0xA, 5, 0]
    for bad in ([1, 2, 5], [0, 3, 1], [0, 5, 1, 2, 3, 4, 5], [7, 1], [0, 1, 9, 2, 1, 3, 0]):
        with pytest.raises(ValueError):
            display.inflate_segments(bad, 4)


def test_tables_of_all_sizes(spark):
    data = F.lit(bytearray(range(200))).cast("binary")
    got = one(spark, display.decode_table(data, F.lit(100), F.lit(16)), display.decode_table(data, F.lit(100), F.lit(17)), display.decode_table(F.lit(None).cast("binary"), F.lit(4), F.lit(8)), display.entries_of(F.lit(0)), display.table_offset(F.lit(65535)))
    assert got[0][1] == (2 + 3 * 256) * 99 // 65535 and got[1] is None and got[2] is None and list(got)[3:] == [65536, -1]


def test_pseudonyms_equal_the_definition(spark):
    key = bytes(range(16))
    import hashlib
    import hmac

    n = int.from_bytes(hmac.new(key, b"1.2.3", hashlib.sha256).digest()[:16], "big")
    n = n & ~(0xF << 76) | 4 << 76
    n = n & ~(3 << 62) | 2 << 62
    assert list(one(spark, hashing.uid_hash(F.lit("1.2.3"), key), hashing.uid_hash(F.lit(" "), key), hashing.decimal_of(F.lit("0" * 31 + "f")), hashing.decimal_of(F.lit("f" * 32)))) == [f"2.25.{n}", None, "15", str((1 << 128) - 1)]


def test_path_templates():
    assert attributes.needs_dataset("{00020010}/{00100020}") and not attributes.needs_dataset("{00020010}/x")


def test_shutters_without_an_area_cover_nothing(spark):
    none = F.array(F.struct(F.lit(0).alias("row"), F.lit(0).alias("column")), F.struct(F.lit(5).alias("row"), F.lit(5).alias("column")))
    circle = F.struct(F.lit(0).alias("row"), F.lit(0).alias("column"), F.lit(0).alias("radius"))
    assert one(spark, display.shutter_contains(F.lit(9.0), F.lit(9.0), circle=circle, polygon=none))[0] is True


def test_definitions_that_point(spark):
    data = hanging.Dataset({"a": Values(F.lit(1))}, {"s": F.array(F.struct(F.lit(5).alias("b")))}, {"g": (F.lit(None).cast("struct<c:int>"), F.array(F.struct(F.lit(7).alias("c"))))}, {"a": "int"})
    pick = lambda **item: hanging.compile_selector(item, data, F.lit(1))
    assert list(one(spark, pick(sequence="s", attribute="b", op="MEMBER_OF", kind="int", params=[5]), pick(functional_group="g", attribute="c", op="LESS_THAN", kind="int", params=[7]))) == [True, False]
    for bad in ({"sequence": "zz", "attribute": "b"}, {"functional_group": "zz", "attribute": "b"}, {"sequence": "s"}, {"attribute": "a", "kind": "string"}):
        with pytest.raises(ValueError):
            pick(**{"op": "MEMBER_OF", "kind": "int", "params": [1], **bad})


def test_plug_in_categories(spark):
    hanging.register_selector("EVEN", lambda item: F.lit(item["of"]) % 2 == 0)
    hanging.register_comparator("BY_SIZE", lambda item: F.lit(item["size"]))
    assert one(spark, hanging.compile_selector({"category": "EVEN", "of": 4}, {}))[0] is True
    assert one(spark, hanging.compile_sort({"category": "BY_SIZE", "size": 3, "direction": "DECREASING"}, {})[0])[0] == 3
    with pytest.raises(ValueError):
        hanging.compile_sort({"category": "NONE", "direction": "INCREASING"}, {})


def test_a_protocol_without_some_of_its_sets(spark):
    definition = {"image_sets": [{}, {}, {}], "display_sets": [{"image_set": 1, "group": 1}, {"image_set": 2, "group": 2}, {"image_set": 3, "group": 2}], "scrolling": [[1, 2], [2], [2, 3]]}
    p = hanging.compile_protocol(definition, {})
    assert p.presentation_groups() == {1: [1], 2: [2, 3]}
    q = p.without_image_set(2)
    assert [(d.number, d.image_set) for d in q.display_sets] == [(1, 1), (2, 2)] and q.scrolling == ((1,), (2,)) and len(q.image_sets) == 2
    assert [d.image_set for d in p.without_display_set(1).display_sets] == [2, 3]


def test_vectors_within_a_tolerance(spark):
    v = lambda *x: F.array(*(F.lit(float(k)) for k in x))
    assert list(one(spark, geometry.close(v(1, 2, 3), v(1, 2, 3.0000001), 1e-6), geometry.close(v(1, 2, 3), v(1, 2, 4), 1e-6))) == [True, False]


def test_definitions_are_written_and_read(spark, tmp_path):
    definition = {"image_sets": [{"selectors": []}], "display_sets": [{"image_set": 1, "sorts": []}]}
    hanging.save_definition(spark, definition, str(tmp_path / "p"))
    assert hanging.load_definition(spark, str(tmp_path / "p")) == definition


@pytest.mark.parametrize("form", ["json", "xml", "csv", "parquet"])
def test_responses_are_written(spark, tmp_path, form):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    find.write_results(rows, str(tmp_path / form), form, single=True)
    reader = spark.read.format(form).schema(rows.schema)
    if form == "xml":
        reader = reader.option("rowTag", "response")
    if form == "csv":
        reader = reader.option("header", True).option("sep", "\t")
    assert sorted(map(tuple, reader.load(str(tmp_path / form)).collect())) == [(1, "a"), (2, "b")]


def test_time_based_sets(spark):
    df = spark.createDataFrame([(1, k, f"2024-01-0{k} 00:00:00") for k in range(1, 8)], "p int, k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    run = lambda item: sorted(r.k for r in hanging.time_based_set(df, ["p"], "t", "2024-01-06 00:00:00", item, ["k"]).collect())
    assert run({"abstract_prior": (0, 0)}) == [6] and run({"abstract_prior": (1, -1)}) == [1, 2, 3, 4, 5] and run({"relative_time": (3, 1, "DAY")}) == [3, 4, 5]
    with pytest.raises(ValueError):
        run({})
