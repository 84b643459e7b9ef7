import pytest
from pyspark.sql import functions as F

from halyard.functions import dates, filters, geometry, hashing, lut, text
from halyard.functions.multivalue import Values
from halyard.operators import hanging


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


NS = 1_000_000_000


@pytest.mark.parametrize(
    "value,want",
    [("123059", (12 * 3600 + 30 * 60 + 59) * NS), ("123059.123456", (12 * 3600 + 30 * 60 + 59) * NS + 123456000), ("12:30:59", (12 * 3600 + 30 * 60 + 59) * NS), ("12", 12 * 3600 * NS), ("2530", None), ("ab", None)],
)
def test_times(spark, value, want):
    assert one(spark, dates.parse_tm(F.lit(value)))[0] == want


@pytest.mark.parametrize("value,extra", [("12", 3600 * NS - 1), ("1230", 60 * NS - 1), ("123059", NS - 1), ("123059.1", NS // 10 - 1), ("123059.12", NS // 100 - 1)])
def test_time_upper_bounds(spark, value, extra):
    low, high = one(spark, dates.parse_tm(F.lit(value)), dates.parse_tm_max(F.lit(value)))
    assert high - low == extra


@pytest.mark.parametrize("most,want", [(6, "123059"), (7, "123059"), (8, "123059.0"), (10, "123059.000"), (13, "123059.000978")])
def test_truncation(spark, most, want):
    assert one(spark, dates.truncate(F.lit("123059.000978"), most))[0] == want


@pytest.mark.parametrize("birth,day,want", [("1970-01-01", "2012-06-01", "042Y"), ("2000-02-29", "2001-02-28", "011M"), ("2001-01-01", "2001-01-10", "009D"), ("2000-02-29", "2012-02-28", "011Y"), ("2000-02-29", "2012-02-29", "012Y")])
def test_ages(spark, birth, day, want):
    assert one(spark, dates.age(F.to_date(F.lit(birth)), F.to_date(F.lit(day))))[0] == want


def test_dates_are_lenient_with_dots(spark):
    got = one(spark, *(dates.parse_da(F.lit(x)) for x in ("20240715", "2024.07.15", "2024.0715", " 20240715 ", "2024-07-15", "20241340", "")))
    assert [str(x) for x in got] == ["2024-07-15"] * 4 + ["None"] * 3


OPS = [
    ("MEMBER_OF", ["A", "B", "C"], 0, ["X", "B"], "string", True),
    ("MEMBER_OF", ["A", "B"], 0, ["X", "Y"], "string", False),
    ("MEMBER_OF", ["A", "B", "C"], 2, ["B"], "string", True),
    ("MEMBER_OF", ["A", "B", "C"], 1, ["B"], "string", False),
    ("NOT_MEMBER_OF", ["A", "B"], 0, ["B"], "string", False),
    ("RANGE_INCL", [5, 6, 7], 0, [5, 7], "int", True),
    ("RANGE_INCL", [5, 8], 0, [5, 7], "int", False),
    ("RANGE_INCL", [99, 6], 2, [5, 7], "int", True),
    ("RANGE_EXCL", [1, 6], 0, [5, 7], "int", False),
    ("RANGE_INCL", [6], 0, [7, 5], "int", False),
    ("GREATER_THAN", [3, 4], 0, [2], "int", True),
    ("LESS_THAN", [3, 4], 0, [4], "int", False),
    ("GREATER_THAN", [-1], 0, [2147483647], "uint", True),
    ("MEMBER_OF", [-1], 0, [4294967295], "uint", False),
    ("MEMBER_OF", [0.1 + 0.2], 0, [0.3], "double", True),
]


@pytest.mark.parametrize("op,values,number,params,kind,want", OPS)
@pytest.mark.parametrize("as_array", [False, True])
def test_operators(spark, op, values, number, params, kind, want, as_array):
    cols = [F.lit(v) for v in values]
    v = Values(array=F.array(*cols)) if as_array else Values(*cols)
    assert one(spark, filters.apply(op, v, params, kind, number))[0] is want


@pytest.mark.parametrize("op,kind,params", [("LIKE", "string", ["a"]), ("RANGE_INCL", "string", ["a", "b"]), ("RANGE_INCL", "int", [1]), ("MEMBER_OF", "int", []), ("MEMBER_OF", "blob", [1])])
def test_operators_that_mean_nothing(op, kind, params):
    with pytest.raises(ValueError):
        filters.check(op, kind, params)


def test_absent_values_take_the_default(spark):
    null = Values(array=F.lit(None).cast("array<int>"))
    empty = Values(array=F.array().cast("array<int>"))
    for v in (null, empty):
        assert list(one(spark, *(hanging.value_selector(v, "LESS_THAN", [1], "int", absent=d) for d in (True, False)))) == [True, False]


@pytest.mark.parametrize(
    "bad",
    [
        {"image_sets": []},
        {"image_sets": [{}], "display_sets": [{"image_set": 2}]},
        {"image_sets": [{}], "display_sets": [{"image_set": 1, "number": 2}]},
        {"image_sets": [{}], "display_sets": [{"image_set": 1, "sorts": [{"attribute": "a"}]}]},
        {"image_sets": [{}], "display_sets": [{"image_set": 1, "filters": [{"attribute": "zz", "op": "MEMBER_OF", "params": [1], "kind": "int"}]}]},
        {"image_sets": [{}], "display_sets": [{"image_set": 1}], "scrolling": [[1, 2]]},
    ],
)
def test_protocols_that_mean_nothing(spark, bad):
    with pytest.raises(ValueError):
        hanging.compile_protocol(bad, {"a": Values(F.lit(1))})


def test_planes(spark):
    v = lambda *x: F.array(*(F.lit(float(k)) for k in x))
    got = one(spark, geometry.plane(v(1, 0, 0), v(0, 1, 0)), geometry.plane(v(1, 0, 0), v(0, 0, -1)), geometry.plane(v(0, 1, 0), v(0, 0, -1)), geometry.plane(v(0.7, 0.7, 0), v(0, 0, 1)))
    assert list(got) == ["TRANSVERSE", "CORONAL", "SAGITTAL", "OBLIQUE"]
    assert list(one(spark, geometry.opposite(F.lit(" h ")), geometry.opposite(F.lit("zz")))) == ["F", None]


def test_colours_go_there_and_back(spark):
    lab = lut.rgb_to_lab(*(F.lit(x) for x in (0, 0, 0)))
    assert one(spark, *lab)[0] == 0
    assert abs(one(spark, *lut.rgb_to_lab(*(F.lit(x) for x in (255, 255, 255))))[0] - 65534) <= 2


def test_rounding_is_half_up(spark):
    assert list(one(spark, lut.half_up(F.lit(-2.5)), lut.half_up(F.lit(2.5)))) == [-2, 3]


def test_templates(spark):
    cases = [("TestText", "$V:l$5$", False, "TestT..."), ("42", "Value: $V units", False, "Value: 42 units"), ("x", None, False, "x")]
    for value, template, decimal, want in cases:
        assert one(spark, text.formatted(F.lit(value), template, decimal))[0] == want
    assert one(spark, text.formatted(F.lit(1.2345), "$V:f$0.00$", True))[0] == "1.23"
    assert one(spark, text.formatted(F.lit(123.5), "$V:f$0.##$", True))[0] == "123.5"


def test_keys():
    assert hashing.show_key(hashing.key_bytes("0x00112233-4455-6677-8899-aabbccddeeff")) == "00112233-4455-6677-8899-aabbccddeeff"
    assert hashing.key_bytes("abc") == b"\x0a\xbc"
