"""The patient, study, series and instance hierarchy: last write wins, removal, pruning, nested and serialised forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions import text


def last_by_struct(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins, without a sort: the greatest (order, rest) of each key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    got = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("m"))
    return got.select(*keys, *(F.col(f"m.{c}").alias(c) for c in (*order, *rest)))


def remove(df: DataFrame, doomed: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(doomed, list(on), "left_anti")


def retain_accession_numbers(studies: DataFrame, numbers: DataFrame, column: str) -> DataFrame:
    """Keeps the studies whose accession number is listed; one without a number goes."""
    return studies.join(numbers, column, "left_semi")


def prune(parents: DataFrame, children: DataFrame, on: Sequence[str]) -> DataFrame:
    """The parents that still have a child."""
    return parents.join(children.select(*on), list(on), "left_semi")


def study_order(moment: Column, description: Column) -> list[Column]:
    """Newest first and undated last, then by description in the root locale's order, without one last."""
    return [moment.desc_nulls_last(), F.collate(description, "UNICODE").asc_nulls_last()]


def instance_order(number: Column, uid: Column) -> list[Column]:
    """By number, without one last, then by identifier with its last part as a number of 64 digits: 5.1 before 5.10.

    This is a key of one instance, so that a sort can use it. Comparing pairs, padding the shorter one's last part to equal total
    length, gives the same order for identifiers that differ in their last part only; with other prefixes it is no order at all.
    """
    last = F.lpad(F.element_at(F.split(uid, r"\."), -1), 64, "0")
    return [number.asc_nulls_last(), F.regexp_replace(uid, r"\.[^.]*$", ""), last]


def empty_rollup(parents: DataFrame, key: str, children: DataFrame, child_parent: str, child_empty: Column) -> DataFrame:
    """(key, is_empty) of each parent: it has no children, or all of them are empty."""
    state = children.groupBy(F.col(child_parent).alias("_parent")).agg(F.bool_and(child_empty).alias("_empty"))
    return parents.join(state, F.col(key) == F.col("_parent"), "left").select(key, F.coalesce("_empty", F.lit(True)).alias("is_empty"))


def with_content(archives: DataFrame, *lists: str) -> DataFrame:
    """Archives that have an item in one of the lists."""
    some = F.lit(False)
    for name in lists:
        some = some | F.coalesce(F.size(name) > 0, F.lit(False))
    return archives.where(some)


def query_mode_attribute(mode: Column) -> Column:
    """The mode as an attribute, left out where it is the default."""
    return F.when(mode != "DICOM", mode)


def nested(instances: DataFrame, levels: Sequence[tuple[str, Sequence[str]]], leaf: Sequence[str], leaf_name: str = "instances") -> DataFrame:
    """One row for each key of the outermost level, the levels below nested as arrays, each ordered by its columns.

    ``levels`` are (name, columns) from the outermost; the innermost is collected first, so a group is never larger than its level.
    Rows are dealt out once by the outermost key, which serves all levels below it.
    """
    instances = instances.repartition(*levels[0][1])
    df, child, below = instances, leaf_name, list(leaf)
    for depth in range(len(levels), 0, -1):
        keys = [c for _, cols in levels[:depth] for c in cols]
        df = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*below))).alias(child))
        below = [*levels[depth - 1][1], child]
        child = levels[depth - 1][0]
    return df


def json_document(*fields: Column) -> Column:
    """JSON without attributes that are null; pass texts through :func:`halyard.functions.text.blank_to_null`, lists through :func:`items`."""
    return F.to_json(F.struct(*fields))


def items(values: Column) -> Column:
    """A list as a level of a document: left out where it is empty."""
    return F.when(F.size(values) > 0, values)


def xml_element(name: str, attributes: dict[str, Column], content: Column | None = None) -> Column:
    """An element with its attributes that are not blank; without content it closes itself."""
    head = F.concat(F.lit(f"<{name}"), text.xml_attributes(attributes))
    if content is None:
        return F.concat(head, F.lit("/>"))
    return F.when(F.length(content) > 0, F.concat(head, F.lit(">"), content, F.lit(f"</{name}>"))).otherwise(F.concat(head, F.lit("/>")))
