"""Hanging protocols: a declarative definition compiled on the driver into column expressions, and one scan that evaluates them all."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from types import FunctionType

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions import dates, filters, geometry
from halyard.functions.multivalue import Values
from halyard.operators import comparison

Attributes = Mapping[str, Values]


@dataclass(frozen=True)
class Dataset:
    """What a definition may name: attributes, sequences of items, functional groups as (shared, per frame), and the kinds of attributes."""

    attributes: Attributes
    sequences: Mapping[str, Column | FunctionType] = field(default_factory=dict)
    groups: Mapping[str, tuple[Column | FunctionType, Column | FunctionType]] = field(default_factory=dict)
    kinds: Mapping[str, str] = field(default_factory=dict)

    def sequence(self, name: str) -> Column:
        if name not in self.sequences:
            raise ValueError(f"unknown sequence {name}")
        return _made(self.sequences[name])

    def group(self, name: str) -> tuple[Column, Column]:
        if name not in self.groups:
            raise ValueError(f"unknown functional group {name}")
        shared, per_frame = self.groups[name]
        return _made(shared), _made(per_frame)


def _made(c: Column | FunctionType) -> Column:
    return c() if isinstance(c, FunctionType) else c


def _dataset(x: Attributes | Dataset) -> Dataset:
    return x if isinstance(x, Dataset) else Dataset(x)


#: plug-in categories: name -> function of the selector item that gives a Column
SELECTOR_CATEGORIES: dict[str, Callable[[Mapping], Column]] = {}
COMPARATOR_CATEGORIES: dict[str, Callable[[Mapping], Column]] = {}
USAGE = {"MATCH": True, "NO_MATCH": False}


def register_selector(name: str, make: Callable[[Mapping], Column]) -> None:
    SELECTOR_CATEGORIES[name] = make


def register_comparator(name: str, make: Callable[[Mapping], Column]) -> None:
    COMPARATOR_CATEGORIES[name] = make


def value_selector(values: Values, op: str, params: Sequence, kind: str, value_number: int | str = 0, absent: bool = False, frame: Column | None = None) -> Column:
    """The operator where enough values are there, else the default for absent values.

    ``value_number='frame'`` takes the frame's number; text and codes have no values by frame, so it is never there for them.
    """
    if value_number == "frame":
        if kind in ("string", "code") or frame is None:
            return F.lit(absent)
        number: int | Column = frame
        enough = values.size() >= F.greatest(frame, F.lit(1))
    else:
        number = 0 if kind == "code" else int(value_number)
        enough = values.size() >= max(number, 1)
    return F.when(F.coalesce(enough, F.lit(False)), filters.apply(op, values, params, kind, number)).otherwise(F.lit(absent))


def presence_selector(values: Values, presence: str) -> Column:
    if presence not in ("PRESENT", "NOT_PRESENT"):
        raise ValueError(f"unknown presence {presence}")
    there = values.size() > 0 if values.array is not None else reduce(lambda a, b: a | b, (c.isNotNull() for c in values.cols))
    return there if presence == "PRESENT" else ~there


def sequence_pointer(sequence: Column, inner: Callable[[Column], Column], absent: bool) -> Column:
    """True if any item of the sequence meets the inner selector; the default if there is no sequence."""
    there = F.coalesce(F.size(sequence) > 0, F.lit(False))
    return F.when(there, F.coalesce(F.exists(sequence, inner), F.lit(False))).otherwise(F.lit(absent))


def functional_group(shared: Column, per_frame: Column, frame: Column, inner: Callable[[Column], Column], absent: bool) -> Column:
    """The shared group if there is one, else the frame's own; for frame 0, any frame's."""
    own = F.try_element_at(per_frame, F.when(frame > 0, frame))
    some = F.coalesce(F.size(per_frame) > 0, F.lit(False))
    return (
        F.when(shared.isNotNull(), F.coalesce(inner(shared), F.lit(False)))
        .when(some & (frame == 0), F.coalesce(F.exists(per_frame, inner), F.lit(False)))
        .when(own.isNotNull(), F.coalesce(inner(own), F.lit(False)))
        .otherwise(F.lit(absent))
    )


def image_plane(orientation: Column, letters: Column, planes: Sequence[str], least_cosine: float = 0.9) -> Column:
    """The plane of a 6-value orientation, else of a pair of axis letters, is one of the planes; true if neither is known."""
    six = F.coalesce(F.size(orientation) >= 6, F.lit(False))
    row, col = (F.slice(orientation, k, 3) for k in (1, 4))
    by_letters = geometry.plane_of_letters(F.try_element_at(letters, F.lit(1)), F.try_element_at(letters, F.lit(2)))
    return F.when(six, geometry.plane(row, col, least_cosine).isin(*planes)).when(by_letters.isNotNull(), by_letters.isin(*planes)).otherwise(F.lit(True))


def child_matches(parents: DataFrame, children: DataFrame, on: str, child_key: str, test: Column, absent: bool) -> DataFrame:
    """Parents of which some child row meets the test, or that have no children if ``absent``; for sequences that are a table of their own.

    Children are reduced to one truth value a parent before they are shuffled; no list of items is made.
    """
    hits = children.groupBy(F.col(child_key).alias("_parent")).agg(F.bool_or(F.coalesce(test, F.lit(False))).alias("_hit"))
    return parents.join(hits, F.col(on) == F.col("_parent"), "left").where(F.coalesce("_hit", F.lit(absent))).drop("_parent", "_hit")


def along_axis(position: Column, row: Column, column: Column) -> Column:
    """The place of an image along the normal of its plane: position . (row x column)."""
    return geometry.dot(position, geometry.cross(row, column))


def acquisition_moment(date: Column, time: Column, moment: Column, content_date: Column, content_time: Column) -> Column:
    """Nanoseconds of the acquisition date and time, else of the acquisition date-time, else of the content date and time."""
    pair = lambda d, t: F.when(d.isNotNull() & t.isNotNull(), dates.combine(d, t))
    return F.coalesce(pair(date, time), moment, pair(content_date, content_time))


def compile_selector(item: Mapping, attributes: Attributes | Dataset, frame: Column | None = None, image_set: bool = False) -> Column:
    """One selector of a definition: a category plug-in, a presence test or an operator on an attribute, which may stand in the items of a
    sequence (some item has to meet it) or in a functional group.

    Image-set selectors are always memberships; the default for absent values is their usage flag. In display sets it is true
    unless the flag says otherwise.
    """
    data = _dataset(attributes)
    attributes = data.attributes
    if "category" in item and not image_set:
        if item["category"] not in SELECTOR_CATEGORIES:
            raise ValueError(f"no selector category {item['category']}")
        return SELECTOR_CATEGORIES[item["category"]](item)
    name = item.get("attribute")
    nested = "sequence" in item or "functional_group" in item
    if not name or (not nested and name not in attributes):
        raise ValueError(f"unknown attribute {name}")
    if data.kinds.get(name, item.get("kind")) != item.get("kind") and "presence" not in item:
        raise ValueError(f"{name} holds {data.kinds[name]} values, not {item.get('kind')}")
    if "presence" in item and not image_set and not nested:
        return presence_selector(attributes[name], item["presence"])
    usage = item.get("usage")
    if usage is None and image_set:
        raise ValueError("an image set selector needs a usage flag")
    if usage is not None and usage not in USAGE:
        raise ValueError(f"unknown usage flag {usage}")
    absent = USAGE.get(usage, True)
    op = "MEMBER_OF" if image_set else item.get("op")

    def test(values: Values) -> Column:
        if "presence" in item and not image_set:
            return presence_selector(values, item["presence"])
        return value_selector(values, op, item["params"], item["kind"], item.get("value_number", 0), absent, frame)

    if "sequence" in item:
        return sequence_pointer(data.sequence(item["sequence"]), lambda x: test(Values(x[name])), absent)
    if "functional_group" in item:
        shared, per_frame = data.group(item["functional_group"])
        return functional_group(shared, per_frame, frame if frame is not None else F.lit(0), lambda x: test(Values(x[name])), absent)
    return test(attributes[name])


def compile_sort(item: Mapping, attributes: Attributes | Dataset, frame: Column | None = None) -> tuple[Column, bool]:
    """A sort key and whether it falls: an attribute, one of the first item of a sequence, one of a functional group (the shared one, else
    the frame's own), or a plug-in's. Missing values come last in either direction, so that the order is total.
    """
    data = _dataset(attributes)
    attributes = data.attributes
    if item.get("direction") not in ("INCREASING", "DECREASING"):
        raise ValueError("a sort needs a direction")
    if "category" in item:
        if item["category"] not in COMPARATOR_CATEGORIES:
            raise ValueError(f"no comparator category {item['category']}")
        key = COMPARATOR_CATEGORIES[item["category"]](item)
    else:
        if not item.get("value_number", 1):
            raise ValueError("a sort needs a value number")
        name = item.get("attribute")
        if name and "sequence" in item:
            return F.get(data.sequence(item["sequence"]), F.lit(0))[name], item["direction"] == "DECREASING"
        if name and "functional_group" in item:
            shared, per_frame = data.group(item["functional_group"])
            own = F.get(per_frame, (frame if frame is not None else F.lit(1)) - 1)
            return F.when(shared.isNotNull(), shared[name]).otherwise(own[name]), item["direction"] == "DECREASING"
        if name not in attributes:
            raise ValueError(f"unknown attribute {name}")
        key = attributes[item["attribute"]].at(item.get("value_number", 1))
    return key, item["direction"] == "DECREASING"


@dataclass(frozen=True)
class DisplaySet:
    number: int
    group: int
    image_set: int
    member: Column
    order: tuple[tuple[Column, bool], ...]


@dataclass(frozen=True)
class Protocol:
    image_sets: tuple[Column, ...]
    display_sets: tuple[DisplaySet, ...]
    scrolling: tuple[tuple[int, ...], ...] = field(default=())

    def without_image_set(self, number: int) -> Protocol:
        """The protocol without an image set and the display sets that show it; what is left is numbered from 1 again."""
        sets = self.image_sets[: number - 1] + self.image_sets[number:]
        shown = [replace(d, image_set=d.image_set - (d.image_set > number)) for d in self.display_sets if d.image_set != number]
        return self._renumbered(sets, shown)

    def without_display_set(self, number: int) -> Protocol:
        return self._renumbered(self.image_sets, [d for d in self.display_sets if d.number != number])

    def _renumbered(self, image_sets: Sequence[Column], display_sets: Sequence[DisplaySet]) -> Protocol:
        new = {d.number: i for i, d in enumerate(display_sets, 1)}
        groups = (tuple(new[n] for n in g if n in new) for g in self.scrolling)
        return Protocol(tuple(image_sets), tuple(replace(d, number=new[d.number]) for d in display_sets), tuple(g for g in groups if g))

    def presentation_groups(self) -> dict[int, list[int]]:
        """Display sets by presentation group; the greatest key is the number of the last group."""
        out: dict[int, list[int]] = {}
        for d in self.display_sets:
            out.setdefault(d.group, []).append(d.number)
        return dict(sorted(out.items()))

    def scrolled(self, routed: DataFrame) -> DataFrame:
        """Rows of :meth:`route` with each scrolling group that their display set is in, and its place there; others go."""
        pairs = [(d, g, i) for g, sets in enumerate(self.scrolling, 1) for i, d in enumerate(sets, 1)]
        groups = routed.sparkSession.createDataFrame(pairs, "_set int, scrolling_group int, place int")
        return routed.join(F.broadcast(groups), F.col("display_set") == F.col("_set")).drop("_set")  # a shuffle would bring all rows of a display set to one task

    def route(self, df: DataFrame, within: Sequence[str], tiebreak: Sequence[Column]) -> DataFrame:
        """One row for each display set that an input row belongs to, and its position there among the rows of its study (``within``).

        All memberships are evaluated in one scan. One window serves all display sets: a set's keys are null in the others.
        """
        sets = F.array_compact(F.array(*(F.when(d.member, F.lit(d.number)) for d in self.display_sets)))
        df = df.withColumn("display_set", F.explode(sets))
        keys = [(F.when(F.col("display_set") == d.number, key), falls) for d in self.display_sets for key, falls in d.order]
        order = [k.desc_nulls_last() if falls else k.asc_nulls_last() for k, falls in keys]
        return df.withColumn("position", F.row_number().over(Window.partitionBy(*within, "display_set").orderBy(*order, *tiebreak)))


def compile_protocol(definition: Mapping, attributes: Attributes | Dataset, frame: Column | None = None) -> Protocol:
    """Checks a definition and compiles it: image sets, then display sets and their filters and sorts, then scrolling groups."""
    image_sets = []
    for s in definition.get("image_sets", []):
        image_sets.append(reduce(lambda a, b: a & b, (compile_selector(x, attributes, frame, image_set=True) for x in s.get("selectors", [])), F.lit(True)))
    if not image_sets:
        raise ValueError("a protocol needs image sets")
    display_sets = []
    for i, d in enumerate(definition.get("display_sets", []), 1):
        if d.get("number", i) != i:
            raise ValueError("display sets are numbered from 1 without gaps")
        if not 1 <= d["image_set"] <= len(image_sets):
            raise ValueError(f"display set {i} names image set {d['image_set']}")
        own = [compile_selector(x, attributes, frame) for x in d.get("filters", [])]
        member = reduce(lambda a, b: a & b, own, image_sets[d["image_set"] - 1])
        display_sets.append(DisplaySet(i, d.get("group", 1), d["image_set"], member, tuple(compile_sort(x, attributes, frame) for x in d.get("sorts", []))))
    for group in definition.get("scrolling", []):
        if any(not 1 <= n <= len(display_sets) for n in group):
            raise ValueError("a scrolling group names a display set that is not there")
    return Protocol(tuple(image_sets), tuple(display_sets), tuple(map(tuple, definition.get("scrolling", []))))


register_comparator("ALONG_AXIS", lambda item: along_axis(*item["columns"]))
register_comparator("BY_ACQ_TIME", lambda item: acquisition_moment(*item["columns"]))


def save_definition(spark: SparkSession, definition: Mapping, path: str) -> None:
    """Writes a definition as one line of JSON."""
    spark.createDataFrame([(json.dumps(definition),)], "value string").coalesce(1).write.text(path)


def load_definition(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def time_based_set(df: DataFrame, patient: Sequence[str], moment: str, now: str, item: Mapping, tiebreak: Sequence[str]) -> DataFrame:
    """Rows of a time-based image set: those in a relative time before ``now``, or priors by number, 1 for the one before the current study.

    ``item`` has ``relative_time`` (start, end, unit) or ``abstract_prior`` (first, last); -1 for last stands for the oldest one.
    """
    if ("relative_time" in item) == ("abstract_prior" in item):
        raise ValueError("a time-based image set has a relative time or a prior's number")
    if "relative_time" in item:
        return comparison.relative_window(df, moment, now, *item["relative_time"])
    first, last = item["abstract_prior"]
    w = Window.partitionBy(*patient).orderBy(F.col(moment).desc(), *tiebreak)
    prior = df.where(F.col(moment) <= F.lit(now).cast("timestamp")).withColumn("_prior", F.row_number().over(w) - 1)
    return prior.where((F.col("_prior") >= first) & (F.lit(last < 0) | (F.col("_prior") <= last))).drop("_prior")
