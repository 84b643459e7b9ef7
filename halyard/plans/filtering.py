"""Filter queries: each operator of a hanging protocol on multi-valued attributes of line items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import filters
from halyard.functions.multivalue import Values
from halyard.operators import hanging
from halyard.registry import query

from .common import table, tally, tally_sql

FLAGS = Values("l_returnflag", "l_linestatus")
NUMBERS = Values("l_quantity", lambda: F.col("l_linenumber").cast("double"), lambda: F.col("l_discount") * 100)
INTS = Values("l_linenumber", lambda: F.pmod("l_partkey", F.lit(50)).cast("int"), lambda: F.pmod("l_suppkey", F.lit(9)).cast("int"))
LIST = "[l_quantity, CAST(l_linenumber AS DOUBLE), l_discount * 100]"
INT_LIST = "[l_linenumber, CAST(l_partkey % 50 AS INT), CAST(l_suppkey % 9 AS INT)]"
#: a signed number whose unsigned value is large on every second row
SIGNED = Values(lambda: F.when(F.col("l_orderkey") % 2 == 0, -F.col("l_linenumber")).otherwise(F.col("l_linenumber")).cast("int"))
SIGNED_SQL = "CASE WHEN l_orderkey % 2 = 0 THEN -l_linenumber ELSE l_linenumber END"
UNSIGNED_SQL = f"(CASE WHEN ({SIGNED_SQL}) < 0 THEN ({SIGNED_SQL}) + 4294967296 ELSE ({SIGNED_SQL}) END)"
#: an attribute that is missing on some rows, as an array
SOME = Values(array=lambda: F.when(F.col("l_linenumber") > 3, F.array(F.col("l_linenumber"), (F.col("l_partkey") % 7).cast("int"))))


#: one value or two, and none
UNEVEN = Values(array=lambda: F.when(F.col("l_linenumber") > 4, F.array(F.col("l_linenumber"), (F.col("l_partkey") % 7).cast("int"))).when(F.col("l_linenumber") > 2, F.array("l_linenumber")))
_THERE = "l_linenumber > 2"


def _absent(absent: bool) -> Column:
    """A selector of each value kind on scalar attributes that are null on some rows; all must be met."""
    there = lambda c: Values(lambda: F.when(F.col("l_linenumber") > 2, c()))
    code = lambda: F.struct(F.col("l_linestatus").alias("value"), F.lit("T").alias("scheme"), F.lit(None).cast("string").alias("version"))
    kinds = [
        ("string", there(lambda: F.col("l_returnflag")), "MEMBER_OF", ["A", "N"]),
        ("int", there(lambda: F.col("l_linenumber")), "LESS_THAN", [6]),
        ("uint", there(lambda: (-F.col("l_linenumber")).cast("int")), "GREATER_THAN", [5]),
        ("float", there(lambda: F.col("l_tax").cast("float")), "RANGE_INCL", [0.02, 0.07]),
        ("double", there(lambda: F.col("l_quantity").cast("double")), "GREATER_OR_EQUAL", [5.0]),
        ("code", there(code), "MEMBER_OF", [{"value": m, "scheme": "T"} for m in ("F", "X")]),
    ]
    out = F.lit(True)
    for kind, values, op, params in kinds:
        out = out & hanging.value_selector(values, op, params, kind, absent=absent)
    return out


_SIX = "l_returnflag IN ('A', 'N') AND l_linenumber < 6 AND CAST(l_tax AS FLOAT) >= 0.02 AND CAST(l_tax AS FLOAT) <= 0.07 AND l_quantity >= 5 AND l_linestatus IN ('F', 'X')"


def _all(cond: str, of: str = LIST) -> str:
    return f"len(list_filter({of}, lambda x: NOT ({cond}))) = 0"


def _any(cond: str, of: str = LIST) -> str:
    return f"len(list_filter({of}, lambda x: {cond})) > 0"


CASES: dict[str, tuple[Callable[[], Column], str]] = {
    "hp_member_of_any": (lambda: filters.apply("MEMBER_OF", FLAGS, ["R", "F"], "string"), "l_returnflag IN ('R','F') OR l_linestatus IN ('R','F')"),
    "hp_member_of_pos": (lambda: filters.apply("MEMBER_OF", FLAGS, ["F"], "string", 2), "l_linestatus = 'F'"),
    "hp_not_member_of_any": (lambda: filters.apply("NOT_MEMBER_OF", FLAGS, ["A", "F"], "string"), "NOT (l_returnflag IN ('A','F') OR l_linestatus IN ('A','F'))"),
    "hp_not_member_of_pos": (lambda: filters.apply("NOT_MEMBER_OF", FLAGS, ["A"], "string", 1), "l_returnflag <> 'A'"),
    "hp_member_of_int": (lambda: filters.apply("MEMBER_OF", INTS, [3, 5], "int"), _any("x IN (3, 5)", INT_LIST)),
    "hp_range_incl_all": (lambda: filters.apply("RANGE_INCL", NUMBERS, [1.0, 30.0], "double"), _all("x >= 1 AND x <= 30")),
    "hp_range_incl_pos": (lambda: filters.apply("RANGE_INCL", INTS, [10, 20], "int", 2), "(l_partkey % 50) BETWEEN 10 AND 20"),
    "hp_range_excl_all": (lambda: filters.apply("RANGE_EXCL", INTS, [3, 4], "int"), f"NOT {_any('x BETWEEN 3 AND 4', INT_LIST)}"),
    "hp_range_excl_pos": (lambda: filters.apply("RANGE_EXCL", INTS, [3, 4], "int", 1), "NOT (l_linenumber BETWEEN 3 AND 4)"),
    "hp_ge_all": (lambda: filters.apply("GREATER_OR_EQUAL", NUMBERS, [2.0], "double"), _all("x >= 2")),
    "hp_le_all": (lambda: filters.apply("LESS_OR_EQUAL", NUMBERS, [25.0], "double"), _all("x <= 25")),
    "hp_gt_all": (lambda: filters.apply("GREATER_THAN", INTS, [1], "int"), _all("x > 1", INT_LIST)),
    "hp_lt_all": (lambda: filters.apply("LESS_THAN", INTS, [30], "int"), _all("x < 30", INT_LIST)),
    "hp_gt_pos": (lambda: filters.apply("GREATER_THAN", NUMBERS, [25.0], "double", 1), "l_quantity > 25"),
    "hp_uint_compare": (lambda: filters.apply("GREATER_THAN", SIGNED, [0x7FFFFFFF], "uint"), f"{UNSIGNED_SQL} > 2147483647"),
    "hp_uint_member_raw": (lambda: filters.apply("MEMBER_OF", SIGNED, [4294967295, 2], "uint"), f"({SIGNED_SQL}) IN (4294967295, 2)"),
    "hp_float_member": (lambda: filters.apply("MEMBER_OF", Values("l_discount", "l_tax"), [0.05, 0.02], "double"), "abs(l_discount - 0.05) <= 1e-6 OR abs(l_discount - 0.02) <= 1e-6 OR abs(l_tax - 0.05) <= 1e-6 OR abs(l_tax - 0.02) <= 1e-6"),
    "hp_presence": (lambda: hanging.presence_selector(SOME, "PRESENT"), "l_linenumber > 3"),
    "hp_presence_not": (lambda: hanging.presence_selector(SOME, "NOT_PRESENT"), "NOT (l_linenumber > 3)"),
    "hp_absent_default_true": (lambda: hanging.value_selector(SOME, "GREATER_THAN", [3], "int", absent=True), "CASE WHEN l_linenumber > 3 THEN l_partkey % 7 > 3 ELSE true END"),
    "hp_absent_default_false": (lambda: hanging.value_selector(SOME, "MEMBER_OF", [5, 6], "int", absent=False), "CASE WHEN l_linenumber > 3 THEN l_linenumber IN (5,6) OR l_partkey % 7 IN (5,6) ELSE false END"),
    "hp_short_default": (lambda: hanging.value_selector(UNEVEN, "LESS_THAN", [3], "int", 2, absent=True), "CASE WHEN l_linenumber > 4 THEN l_partkey % 7 < 3 ELSE true END"),
    "hp_absent_scalar_true": (lambda: _absent(True), f"CASE WHEN {_THERE} THEN {_SIX} ELSE true END"),
    "hp_absent_scalar_false": (lambda: _absent(False), f"CASE WHEN {_THERE} THEN {_SIX} ELSE false END"),
    "hp_absent_not_member": (
        lambda: hanging.value_selector(Values(lambda: F.when(F.col("l_linenumber") > 2, F.col("l_returnflag"))), "NOT_MEMBER_OF", ["A", "X"], "string", absent=False),
        "CASE WHEN l_linenumber > 2 THEN l_returnflag NOT IN ('A', 'X') ELSE false END",
    ),
    "hp_absent_trailing": (
        lambda: hanging.value_selector(Values("l_linenumber", lambda: F.when(F.col("l_partkey") % 2 == 0, (F.col("l_suppkey") % 9).cast("int"))), "LESS_THAN", [5], "int", absent=False),
        "l_linenumber < 5 AND (l_partkey % 2 = 1 OR l_suppkey % 9 < 5)",
    ),
    "hp_frame_index": (
        lambda: hanging.value_selector(INTS, "LESS_THAN", [5], "int", "frame", absent=True, frame=F.col("l_linenumber")),
        f"CASE WHEN l_linenumber <= 3 THEN ({INT_LIST})[l_linenumber] < 5 ELSE true END",
    ),
    "hp_frame_index_text": (lambda: hanging.value_selector(FLAGS, "MEMBER_OF", ["A"], "string", "frame", absent=False, frame=F.col("l_linenumber")) | (F.col("l_linenumber") == 2), "l_linenumber = 2"),
    "hp_image_plane": (
        lambda: hanging.image_plane(F.when(F.col("l_linenumber") > 1, F.array(F.col("l_discount") * 10, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))), F.array("l_returnflag", "l_linestatus"), ["TRANSVERSE", "CORONAL"]),
        "CASE WHEN l_linenumber > 1 THEN abs(l_discount * 10) > 0.9 ELSE CASE WHEN l_returnflag IN ('A','R') AND l_linestatus = 'F' THEN l_returnflag = 'R' ELSE true END END",
    ),
}

for _name, (_cond, _sql) in CASES.items():

    def _run(spark: SparkSession, sf_dir: str, cond: Callable[[], Column] = _cond) -> DataFrame:
        return tally(table(spark, sf_dir, "lineitem").where(cond()))

    query(_name, tally_sql(_sql))(_run)


@query(
    "hp_code_member",
    "SELECT p_brand, p_type, count(*) AS n FROM part WHERE (p_brand = 'Brand#11' AND (p_size % 3 = 0 OR p_size % 3 = 1)) OR p_brand = 'Brand#22' GROUP BY ALL",
)
def hp_code_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded values: the version counts only where both sides have one."""
    version = F.when(F.col("p_size") % 3 > 0, (F.col("p_size") % 3).cast("string"))
    code = F.struct(F.col("p_brand").alias("value"), F.lit("TPC").alias("scheme"), version.alias("version"))
    params = [{"value": "Brand#11", "scheme": "TPC", "version": "1"}, {"value": "Brand#22", "scheme": "TPC"}]
    return table(spark, sf_dir, "part").where(filters.apply("MEMBER_OF", Values(code), params, "code")).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "hp_seq_pointer",
    """SELECT o_orderkey, o_custkey FROM orders o WHERE CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
       THEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45 AND l_returnflag = 'R') ELSE true END""",
)
def hp_seq_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selector on the items of a nested sequence: orders with their lines as one."""
    inner = (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")
    return hanging.child_matches(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", inner, absent=True).select("o_orderkey", "o_custkey")


_NESTED = hanging.Dataset(
    {"size": Values("p_size")},
    {"codes": lambda: F.when(F.col("p_size") % 4 > 0, F.array(F.struct(F.col("p_brand").alias("brand")), F.struct(F.col("p_type").alias("brand"))))},
    {"geometry": (lambda: F.when(F.col("p_partkey") % 3 == 0, F.struct(F.col("p_size").alias("depth"))), lambda: F.array(F.struct((F.col("p_size") * 2).alias("depth")), F.struct((F.col("p_size") * 3).alias("depth"))))},
    {"size": "int"},
)


@query(
    "hp_pointer_selectors",
    """SELECT p_partkey FROM part WHERE CASE WHEN p_size % 4 > 0 THEN p_brand = 'Brand#11' OR p_type IN ('ECONOMY', 'Brand#11') ELSE false END
       OR (CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_size % 2 = 0 THEN p_size * 2 ELSE p_size * 3 END BETWEEN 20 AND 60 AND p_size < 25)""",
)
def hp_pointer_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors of a definition that point into a sequence and a functional group."""
    frame = F.when(F.col("p_size") % 2 == 0, 1).otherwise(2)
    pick = lambda **item: hanging.compile_selector(item, _NESTED, frame)
    code = pick(sequence="codes", attribute="brand", op="MEMBER_OF", kind="string", params=["Brand#11", "ECONOMY"], usage="NO_MATCH")
    depth = pick(functional_group="geometry", attribute="depth", op="RANGE_INCL", kind="int", params=[20, 60])
    return table(spark, sf_dir, "part").where(code | (depth & pick(attribute="size", op="LESS_THAN", kind="int", params=[25]))).select("p_partkey")


@query(
    "hp_functional_group",
    """SELECT vec_id, CAST(label AS BIGINT) AS frame FROM embeddings WHERE CASE
         WHEN vec_id % 5 = 0 THEN embedding[1] > 0
         WHEN label = 0 THEN embedding[2] > 0 OR embedding[3] > 0 OR embedding[4] > 0
         WHEN label <= 3 THEN embedding[label + 1] > 0 ELSE true END""",
)
def hp_functional_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared group first, then the frame's, for frame 0 any frame's."""
    e = table(spark, sf_dir, "embeddings")
    group = lambda k: F.struct(F.element_at("embedding", k).alias("v"))
    shared = F.when(F.col("vec_id") % 5 == 0, group(1))
    keep = hanging.functional_group(shared, F.array(group(2), group(3), group(4)), F.col("label").cast("int"), lambda g: g["v"] > 0, absent=True)
    return e.where(keep).select("vec_id", F.col("label").cast("long").alias("frame"))


ATTRIBUTES = {
    "flag": Values("l_returnflag"),
    "status": Values("l_linestatus"),
    "numbers": Values("l_quantity", lambda: F.col("l_discount") * 100),
    "quantity": Values("l_quantity"),
    "price": Values("l_extendedprice"),
    "shipped": Values("l_shipdate"),
}
PROTOCOL = {
    "image_sets": [
        {"selectors": [{"attribute": "flag", "kind": "string", "params": ["R", "A"], "usage": "MATCH"}]},
        {"selectors": [{"attribute": "status", "kind": "string", "params": ["O"], "usage": "NO_MATCH"}]},
    ],
    "display_sets": [
        {"image_set": 1, "filters": [{"attribute": "numbers", "kind": "double", "op": "RANGE_INCL", "params": [2.0, 40.0]}], "sorts": [{"attribute": "price", "direction": "DECREASING"}]},
        {"image_set": 2, "filters": [{"attribute": "quantity", "kind": "double", "op": "GREATER_THAN", "params": [30.0]}], "sorts": [{"attribute": "shipped", "direction": "INCREASING"}, {"attribute": "price", "direction": "INCREASING"}]},
        {"image_set": 2, "sorts": [{"attribute": "quantity", "direction": "DECREASING"}]},
    ],
    "scrolling": [[1, 2]],
}
_TIES = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity"]
_TIE_SQL = ", ".join(_TIES)
_FLAGSHIP_SQL = f"""
WITH s AS (
  SELECT 1 AS display_set, *, -l_extendedprice AS k1, 0.0 AS k2 FROM lineitem WHERE l_returnflag IN ('R','A') AND l_quantity BETWEEN 2 AND 40 AND l_discount * 100 BETWEEN 2 AND 40
  UNION ALL SELECT 2, *, CAST(epoch_us(l_shipdate) AS DOUBLE), l_extendedprice FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 30
  UNION ALL SELECT 3, *, -l_quantity, 0.0 FROM lineitem WHERE l_linestatus = 'O')
SELECT l_orderkey, display_set, row_number() OVER (PARTITION BY l_orderkey, display_set ORDER BY k1, k2, {_TIE_SQL}) AS position, l_partkey, l_extendedprice FROM s"""


@query("hp_display_sets_all", _FLAGSHIP_SQL)
def hp_display_sets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole protocol: image sets, display sets, filters and sorts in one scan and one window, within each study."""
    protocol = hanging.compile_protocol(PROTOCOL, ATTRIBUTES)
    routed = protocol.route(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col(c) for c in _TIES])
    return routed.select("l_orderkey", "display_set", F.col("position").cast("long").alias("position"), "l_partkey", "l_extendedprice")


@query("hp_image_set", tally_sql("l_returnflag IN ('R','A')"))
def hp_image_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    protocol = hanging.compile_protocol(PROTOCOL, ATTRIBUTES)
    return tally(table(spark, sf_dir, "lineitem").where(protocol.image_sets[0]))


@query("hp_categories", "SELECT l_orderkey, count(DISTINCT l_returnflag) AS kinds, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY ALL")
def hp_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of categories within each study."""
    got = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    return got.select("l_orderkey", F.size("f").cast("long").alias("kinds"), F.array_join("f", ",").alias("flags"))


@query(
    "hp_renumbered",
    """SELECT 1 AS display_set, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 30 UNION ALL SELECT 2, count(*) FROM lineitem WHERE l_linestatus = 'O'""",
)
def hp_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A protocol without its first image set: its display set goes, the others are numbered from 1."""
    protocol = hanging.compile_protocol(PROTOCOL, ATTRIBUTES).without_image_set(1)
    routed = protocol.route(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_linenumber")])
    return routed.groupBy("display_set").agg(F.count(F.lit(1)).alias("n"))


@query(
    "hp_scrolling",
    """SELECT 1 AS scrolling_group, 1 AS place, count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_quantity >= 2 AND l_quantity <= 40 AND l_discount * 100 >= 2 AND l_discount * 100 <= 40
       UNION ALL SELECT 1, 2, count(*) FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 30""",
)
def hp_scrolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrolling groups joined to the rows of their display sets."""
    protocol = hanging.compile_protocol(PROTOCOL, ATTRIBUTES)
    routed = protocol.route(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_linenumber")])
    return protocol.scrolled(routed).groupBy("scrolling_group", "place").agg(F.count(F.lit(1)).alias("n"))
