"""Key-based query: keys with values become predicates, keys without become columns, in one plan that is pushed to the scan."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.functions import text

_RANGE = re.compile(r"^(\d{8})?-(\d{8})?$")


@dataclass(frozen=True)
class Key:
    """A column, or a field inside sequences given by their path; no values: return it."""

    name: str
    values: tuple[str, ...] = ()
    path: tuple[str, ...] = ()


def parse_path(expression: str) -> Key:
    """``Sequence/Sequence/Name=value\\value``"""
    place, _, value = expression.partition("=")
    *path, name = place.split("/")
    if not name:
        raise ValueError(f"no name in {expression!r}")
    return Key(name, tuple(value.split("\\")) if value else (), tuple(path))


def matches(c: Column, values: Sequence[str], kind: str) -> Column:
    """One of the values: exact, a date range a-b open at either side, or text with * and ?."""

    def one(v: str) -> Column:
        if kind in ("date", "timestamp", "timestamp_ntz") and (m := _RANGE.match(v)):
            day = c.cast("date")
            low = day >= F.to_date(F.lit(m[1]), "yyyyMMdd") if m[1] else F.lit(True)
            high = day <= F.to_date(F.lit(m[2]), "yyyyMMdd") if m[2] else F.lit(True)
            return low & high
        if kind == "string":
            return text.text_wildcard(c, v)
        return c == F.lit(v).cast(kind)

    return reduce(lambda a, b: a | b, (one(v) for v in values))


def find(df: DataFrame, keys: Sequence[Key], limit: int = 0) -> DataFrame:
    """Rows that match all keys, with the columns of all keys in order. ``limit`` 0 is none."""
    kinds = dict(df.dtypes)
    for k in keys:
        if not k.values:
            continue
        if k.path:
            df = df.where(F.coalesce(_nested(F.col(k.path[0]), k.path[1:], k), F.lit(False)))
        else:
            df = df.where(matches(F.col(k.name), k.values, kinds[k.name].split("(")[0]))
    out = df.select(*dict.fromkeys(k.path[0] if k.path else k.name for k in keys))
    return out.limit(limit) if limit else out


def _nested(sequence: Column, path: Sequence[str], key: Key) -> Column:
    """Some item, down the path, matches."""
    if path:
        return F.exists(sequence, lambda x: F.coalesce(_nested(x[path[0]], path[1:], key), F.lit(False)))
    return F.exists(sequence, lambda x: F.coalesce(matches(x[key.name], key.values, "string"), F.lit(False)))


def merge_keys(file_keys: Mapping[str, Sequence[str]], own: Mapping[str, Sequence[str]], allowed: Sequence[str] | None = None) -> list[Key]:
    """Keys of a file, narrowed to those allowed, then overridden and extended by the caller's."""
    base = {k: tuple(v) for k, v in file_keys.items() if allowed is None or k in allowed}
    return [Key(k, v) for k, v in (base | {k: tuple(v) for k, v in own.items()}).items()]


Tree = Mapping[str, "Sequence[str] | Tree"]


def merge_trees(file_keys: Tree, own: Tree, allowed: Sequence[str] | None = None, deep: bool = False) -> dict:
    """Keys of a file, narrowed to those allowed at the top, then overridden and extended by the caller's. A sequence (a tree inside) that both have keeps its other keys; inside of
    it, sequences are replaced whole, or merged as well if ``deep``.
    """
    out = {k: v for k, v in file_keys.items() if allowed is None or k in allowed}
    for k, v in own.items():
        both = isinstance(v, Mapping) and isinstance(out.get(k), Mapping) and v and out[k]
        out[k] = (merge_trees(out[k], v, deep=True) if deep else {**out[k], **v}) if both else v
    return out


@dataclass(frozen=True)
class Child:
    """A sequence whose items are rows of a table: its column that names the parent, the parent's key, and sequences of its own."""

    table: DataFrame
    of: str
    key: str
    children: Mapping[str, Child] = field(default_factory=dict)


def where_tree(df: DataFrame, tree: Tree, children: Mapping[str, Child] | None = None) -> DataFrame:
    """Rows that match all keys of a tree. A sequence matches if one of its items matches all keys in it, at every depth; it is an array of structs, or a table of ``children``.

    Keys over columns become one predicate, which reaches the scan; a table's items are filtered in the same way, reduced to the parents they name, and semi-joined.
    """
    children = children or {}
    tests = [_tree_test(df.schema[k].dataType, F.col(k), v) for k, v in tree.items() if k not in children and v]
    if tests:
        df = df.where(F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)))
    for k, v in tree.items():
        if k in children and _asks(v):
            c = children[k]
            named = where_tree(c.table, v, c.children).where(F.col(c.of).isNotNull()).select(F.col(c.of).alias("_parent")).distinct()
            df = df.join(named, F.col(c.key) == F.col("_parent"), "left_semi")
    return df


def _asks(tree: Tree) -> bool:
    """Whether a tree has a value anywhere; without one it only says what is to be returned."""
    return any(_asks(v) if isinstance(v, Mapping) else len(v) for v in tree.values())


def _tree_test(kind: T.DataType, c: Column, v) -> Column:
    if not isinstance(v, Mapping):
        return matches(c, tuple(v), kind.simpleString().split("(")[0])
    item = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not _asks(v):
        return F.lit(True)

    def all_of(x: Column) -> Column:
        return F.coalesce(reduce(lambda a, b: a & b, (_tree_test(item[k].dataType, x[k], w) for k, w in v.items() if w)), F.lit(False))

    return F.exists(c, all_of) if isinstance(kind, T.ArrayType) else all_of(c)


#: Levels of the query models, from the top; a query without a level is for studies. Keys of a level above may stand in a query of the one below.
MODELS = {"PatientRoot": ("PATIENT", "STUDY", "SERIES", "IMAGE"), "StudyRoot": ("STUDY", "SERIES", "IMAGE"), "PatientStudyOnly": ("PATIENT", "STUDY")}


@dataclass(frozen=True)
class Level:
    """A level's table, and how its rows name those of the level above: (own column, column above)."""

    table: DataFrame
    above: tuple[str, str] | None = None


def find_level(model: str, levels: Mapping[str, Level], tree: Tree, level: str = "STUDY", limit: int = 0) -> DataFrame:
    """Rows of one level of a query model that match a tree of keys, its own and those of all levels above it, with the columns of all keys in order.

    In the study root a study's patient is part of the study, so keys of patients are taken there too. Levels without a key stay out of the plan.
    """
    if level not in MODELS[model]:
        raise ValueError(f"{model} has no level {level}")
    order = ("PATIENT", "STUDY", "SERIES", "IMAGE")
    above = [n for n in order[: order.index(level) + 1] if n in levels]
    place: dict[str, str] = {}
    for n in reversed(above):  # the lowest level that has a column has the say
        for k in tree:
            if k in levels[n].table.columns:
                place.setdefault(k, n)
    if missing := [k for k in tree if k not in place]:
        raise ValueError(f"no level from {level} up has {', '.join(missing)}")
    top = min(order.index(n) for n in (*place.values(), level))
    used = [n for n in above if order.index(n) >= top]
    parts = {n: where_tree(levels[n].table, {k: v for k, v in tree.items() if place[k] == n}) for n in used}
    out = parts[level]
    for low, high in zip(reversed(used[1:]), reversed(used[:-1])):
        own, other = levels[low].above
        keep = [k for k in tree if place[k] == high]
        up = levels[high].above
        wanted = dict.fromkeys([other, *keep, *([up[0]] if up and high != used[0] else [])])
        out = out.join(parts[high].select(*(F.col(c).alias(f"_up_{c}" if c == other and c not in keep else c) for c in wanted)), F.col(own) == F.col(f"_up_{other}" if other not in keep else other))
    out = out.select(*tree)
    return out.limit(limit) if limit else out


def override(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def suffix_uids(df: DataFrame, columns: Sequence[str], suffix: str) -> DataFrame:
    return df.withColumns({c: F.concat(F.col(c), F.lit(suffix)) for c in columns})


def edit(df: DataFrame, *editors) -> DataFrame:
    """Editors, each a function of a DataFrame, applied in order."""
    return reduce(lambda d, f: d.transform(f), editors, df)


def with_children(parents: DataFrame, children: DataFrame, on: str, child_key: str, keys: Sequence[Key]) -> DataFrame:
    """Parents that have, for each key, some child row that matches it; for sequences that are a table of their own.

    Children are reduced to a truth value for each key before they are shuffled.
    """
    kinds = dict(children.dtypes)
    hits = [F.bool_or(F.coalesce(matches(F.col(k.name), k.values, kinds[k.name].split("(")[0]), F.lit(False))).alias(f"_hit{i}") for i, k in enumerate(keys)]
    rows = children.groupBy(F.col(child_key).alias("_parent")).agg(*hits)
    rows = rows.where(reduce(lambda a, b: a & b, (F.col(f"_hit{i}") for i in range(len(keys))))).select("_parent")
    return parents.join(rows, F.col(on) == F.col("_parent"), "left_semi")


def applicable(instances: DataFrame, references: DataFrame, same: Column, frames: str, frame: Column) -> DataFrame:
    """Instances that some reference applies to: it names the instance, and no frames or this one."""
    return instances.join(references, same & ((F.size(frames) == 0) | F.array_contains(frames, frame)), "left_semi")


def write_results(results: DataFrame, path: str, form: str = "json", single: bool = False) -> None:
    """Responses as files in JSON, XML, CSV or Parquet; ``single`` puts them into one file."""
    out = results.coalesce(1) if single else results
    writer = out.write.mode("errorifexists")
    if form == "xml":
        writer = writer.option("rootTag", "responses").option("rowTag", "response")
    if form == "csv":
        writer = writer.option("header", True).option("sep", "\t")
    writer.format(form).save(path)
