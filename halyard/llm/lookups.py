"""Joins with a table of counts whose keys may be as skewed as what is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], heavy: Column) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (unique ``keys``, no nulls): entries of ``heavy`` are broadcast, the others meet their rows in a shuffle.

    The caller bounds the heavy entries by what they count: at most n of them hold 1/n of all each. No group of the shuffle then has more
    rows than a light entry counts. ``rows`` should be cheap to read twice.
    """
    of = [f"of_{k}" for k in keys]
    named = table.select(*(F.col(k).alias(o) for k, o in zip(keys, of)), *(c for c in table.columns if c not in keys), heavy.alias("is_heavy"))
    same = [F.col(k) == F.col(o) for k, o in zip(keys, of)]
    few = F.broadcast(named.where("is_heavy").drop("is_heavy"))
    by_few = rows.join(few, same).drop(*of)
    by_rest = rows.join(few, same, "left_anti").join(named.where("NOT is_heavy").drop("is_heavy"), same).drop(*of)
    return by_few.unionByName(by_rest)
