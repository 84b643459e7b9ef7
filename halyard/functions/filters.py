"""The eight filter operators over multi-valued attributes, two-valued as a protocol needs them: every result is true or false."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .multivalue import Values

#: operator -> number of parameters it takes; 0 for a list of any length
OPERATORS = {
    "MEMBER_OF": 0,
    "NOT_MEMBER_OF": 0,
    "RANGE_INCL": 2,
    "RANGE_EXCL": 2,
    "GREATER_OR_EQUAL": 1,
    "LESS_OR_EQUAL": 1,
    "GREATER_THAN": 1,
    "LESS_THAN": 1,
}
KINDS = ("string", "int", "uint", "float", "double", "code")
#: how near two floating values must be to count as equal
TOLERANCE = {"float": 1e-6, "double": 1e-6}
FRAME = 0xFFFF  # a value number that stands for the frame's number


def check(op: str, kind: str, params: Sequence) -> None:
    """Raises what a protocol can't mean: an unknown operator, a numeric one on text, a wrong number of parameters."""
    if op not in OPERATORS:
        raise ValueError(f"unknown filter operator {op}")
    if kind not in KINDS:
        raise ValueError(f"unknown value kind {kind}")
    wanted = OPERATORS[op]
    if wanted and kind in ("string", "code"):
        raise ValueError(f"{op} compares numbers, not {kind} values")
    if (wanted and len(params) != wanted) or not params:
        raise ValueError(f"{op} takes {wanted or 'one or more'} parameters, not {len(params)}")


def unsigned(x: Column) -> Column:
    return x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def code_equals(a: Column, param: dict) -> Column:
    """Value and scheme agree; the version only counts if both sides have one."""
    same = a["value"].eqNullSafe(F.lit(param.get("value"))) & a["scheme"].eqNullSafe(F.lit(param.get("scheme")))
    if param.get("version") is not None:
        same = same & (a["version"].isNull() | (a["version"] == param["version"]))
    return same


def _member(x: Column, kind: str, params: Sequence) -> Column:
    if kind == "code":
        return reduce(lambda a, b: a | b, (code_equals(x, p) for p in params))
    if kind in TOLERANCE:
        return reduce(lambda a, b: a | b, (F.abs(x.cast("double") - F.lit(float(p))) <= TOLERANCE[kind] for p in params))
    return x.isin(*params)  # an unsigned value is not masked here: membership compares the stored number


def _test(op: str, kind: str, params: Sequence):
    masked = unsigned if kind == "uint" else (lambda x: x)
    if kind == "float" and OPERATORS[op]:
        params = [F.lit(float(p)).cast("float") for p in params]  # compared in the values' own precision
    if op in ("MEMBER_OF", "NOT_MEMBER_OF"):
        return lambda x: _member(x, kind, params)
    if op in ("RANGE_INCL", "RANGE_EXCL"):
        return lambda x: masked(x).between(params[0], params[1])
    return {
        "GREATER_OR_EQUAL": lambda x: masked(x) >= params[0],
        "LESS_OR_EQUAL": lambda x: masked(x) <= params[0],
        "GREATER_THAN": lambda x: masked(x) > params[0],
        "LESS_THAN": lambda x: masked(x) < params[0],
    }[op]


def apply(op: str, values: Values, params: Sequence, kind: str = "int", value_number: int | Column = 0) -> Column:
    """The operator on values that are there. Without a value number, membership asks for any value and comparisons for all."""
    check(op, kind, params)
    test = _test(op, kind, params)
    negated = op in ("NOT_MEMBER_OF", "RANGE_EXCL")
    if isinstance(value_number, int) and value_number == 0:
        if op == "MEMBER_OF":
            return values.any(test)
        if negated:
            return ~values.any(test)
        return values.all(test)
    hit = F.coalesce(test(values.at(value_number)), F.lit(False))
    return ~hit if negated else hit
