"""Near-duplicate groups by MinHash.

A document's set is its distinct word shingles. Documents of equal sets form one class, named by a 64-bit key of the set, and go
on as one row. Universal hash minima are banded into buckets; candidate pairs are tested on their signatures, then confirmed on
full sets; groups are connected components found by alternating large-star and small-star rounds.

Within a bucket, members are first compared with the smallest class only. A bucket whose members are all confirmed is finished
and never looked at again. In the others, one drawn member is compared with those of other components. What is then still open are
pairs of one bucket in different components, and these are compared too, unless the order of their rarest shingles rules a link
out. No link between different components is lost, and pairs inside a component, which can't change it, are never made.
Components are one table with a row per class; nothing wider is relabelled.

Defined cases: null or word-free texts have an empty set, are linked with nothing and kept; fewer words than a shingle
make one shingle of all words; rows with equal ids each get a result row by their own text, and their texts are not linked by
the id; null ids are linked with nothing and kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, byte_slices, mix64

_ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


@dataclass(frozen=True)
class NearDupParams:
    """At the similarity asked for, a pair shares no band with probability (1 - s^rows)^bands: 1.1e-6 for 0.8, 6 and 45; unrelated
    texts of similarity 0.05 share one with probability 7e-7, so that buckets stay pure as the corpus grows.
    """

    shingle: int = 5
    percent: int = 80  # links have 100 * intersection >= percent * union
    rows: int = 6
    bands: int = 45
    kept_minima: int = 180  # minima of which 8 bits are kept to test candidate pairs
    seed: int = 20240501
    star_rounds: int = 1  # rounds of comparing one drawn member of a bucket with the rest before all open pairs are compared
    signature_slack: float = 5.0  # standard deviations that a signature may fall short before a pair is dropped unconfirmed

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.rows * self.bands
        return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)

    def least_agreement(self) -> int:
        n, p = self.kept_minima, self.percent / 100
        return int(n * p - self.signature_slack * (n * p * (1 - p)) ** 0.5)


class _WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code


_WORDS = _WordCodes()


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of the word shingles; bytes.lower() turns A-Z only."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, U64)
    codes = np.fromiter(map(_WORDS.__getitem__, words), U64, len(words))
    if len(codes) < size:
        h = np.array([len(codes)], U64)
        for j in range(len(codes)):
            h = mix64(h + codes[j : j + 1] * _ODD[0] + U64(j))
        return h
    n = len(codes) - size + 1
    h = np.zeros(n, U64)
    for j in range(size):
        h = mix64(h + codes[j : j + n] * _ODD[j % len(_ODD)] + U64(j))
    return np.unique(h)


def signature(codes: np.ndarray, params: NearDupParams, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum of each universal hash a*x + b over the codes' upper 32 bits."""
    a, b = tables
    x = (codes >> U64(32)).astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(out, (x[at : at + 512, None] * a + b).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, params: NearDupParams) -> np.ndarray:
    """One 64-bit bucket key for each band, the band's number included."""
    rows = sig.reshape(params.bands, params.rows).astype(U64)
    h = np.arange(1, params.bands + 1, dtype=U64) * _ODD[1]
    for j in range(params.rows):
        h = mix64(h + rows[:, j] * _ODD[0] + U64(j))
    return h.view(np.int64)


def class_key(codes: np.ndarray) -> int:
    """A 64-bit key of a sorted set; of n different sets, n^2 / 2^65 pairs are expected to share one."""
    return int(np.array([xxhash.xxh3_64_intdigest(codes.tobytes())], U64).view(np.int64)[0])


def _describe(src: DataFrame, params: NearDupParams) -> DataFrame:
    """(id, h, n, k, bands, sig) of each row of (id, h, text): set size, class key, bucket keys and 8 bits of each minimum."""
    tables = params.multipliers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in byte_slices(batch, "text"):
                ns, keys, bands, sigs = [], [], [], []
                for t in texts:
                    codes = shingle_set(t, params.shingle)
                    ns.append(len(codes))
                    sig = signature(codes, params, tables) if len(codes) else None
                    keys.append(class_key(codes) if len(codes) else None)
                    bands.append(None if sig is None else band_keys(sig, params))
                    sigs.append(None if sig is None else (sig[: params.kept_minima] >> np.uint32(24)).astype(np.uint8).tobytes())
                own = [batch.column(c).slice(start, stop - start) for c in (0, 1)]
                found = [pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(own + found, names=["id", "h", "n", "k", "bands", "sig"])

    return src.mapInArrow(run, "id long, h long, n long, k long, bands array<long>, sig binary")


def _intersection(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(y):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _confirm(pairs: DataFrame, known: DataFrame, params: NearDupParams, scratch: Scratch, name: str) -> DataFrame:
    """Of pairs (a, b) of classes, the linked ones: sizes and signatures agree enough, and then the full sets do.

    Signatures are joined and looked at first; only pairs that pass fetch texts. Texts are sent, as they compress better than sets.
    """
    least, percent, size = params.least_agreement(), params.percent, params.shingle
    for side in "ab":
        pairs = pairs.join(known.select(F.col("k").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b")

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    near = scratch.save(pairs.mapInArrow(agreeing, "a long, b long"), f"near-{name}")
    both = near.join(known.select(F.col("k").alias("a"), F.col("text").alias("text_a")), "a").join(known.select(F.col("k").alias("b"), F.col("text").alias("text_b")), "b")

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}  # of the classes met last

        def codes(key: int, text: pa.Scalar) -> np.ndarray:
            if key not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[key] = shingle_set(text.as_buffer().to_pybytes(), size)
            return sets[key]

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = codes(a, ta), codes(b, tb)
                common = _intersection(x, y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = scratch.save(both.select("a", "b", "text_a", "text_b").mapInArrow(confirmed, "a long, b long"), f"links-{name}")
    scratch.drop(f"near-{name}")
    return links


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), by alternating large-star and small-star until only stars are left.

    The minima of a round are a written table, so that the joins with them have plain tables on both sides, and a node with
    very many neighbours is a skewed key that adaptive execution splits. One row a round reaches the driver at most.
    """

    def only_stars(df: DataFrame) -> bool:
        """Whether every node has one smaller neighbour, which has none itself."""
        ends = df.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(df.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()

    cur = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    step = 0
    while not only_stars(cur):
        step += 1
        both = cur.union(cur.select("v", "u"))
        low = scratch.save(both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m")), f"{name}-{step}-low")
        large = both.join(low, F.col("u") == F.col("x")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{name}-{step}-large")
        low2 = scratch.save(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")), f"{name}-{step}-low2")
        small = large.join(low2, F.col("u") == F.col("x")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        cur = scratch.save(small.where("u <> v").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}-low", f"{name}-{step}-large", f"{name}-{step}-low2")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _open_pairs(placed: DataFrame, known: DataFrame, params: NearDupParams, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) of open classes (k, component) in different components that can be linked, by their rarest shingles.

    Only shingles that several components have can be common to such a pair. With these in order of how few open classes have them,
    and all others before them, linked sets have one in common among their first ones; what stands before the first common one in
    either set is not common to them, which bounds the intersection. So the larger set of a pair is found by what is within
    its first 1 - s, and the smaller one within (1 - s) / (1 + s). In a large group of near copies, the shingles that tell its
    members apart come first, so that members which differ too much from each other don't meet. Sets meet by shingle
    and size, and the component that has most of a shingle's sets is joined with the others only, not with itself.
    """
    percent, size = params.percent, params.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, texts in byte_slices(batch, "text"):
                sets = [shingle_set(t, size) for t in texts]
                n = np.array([len(c) for c in sets])
                owner = pa.array(np.repeat(np.arange(start, start + len(n)), n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], names=["k", "component", "n", "code"]
                )

    texts = placed.join(known.select("k", "text"), "k").select("k", "component", "text")
    codes = scratch.save(texts.mapInArrow(run, "k long, component long, n long, code long"), "codes")
    kinds = [F.count(F.lit(1)).alias("times"), F.min("component").alias("lo"), F.max("component").alias("hi")]
    shared = scratch.save(codes.groupBy("code").agg(*kinds).where("lo <> hi").select("code", "times"), "shared-codes")
    by_set = Window.partitionBy("k")
    place = F.col("n") - F.count(F.lit(1)).over(by_set) + F.row_number().over(by_set.orderBy("times", "code")) - 1
    first = codes.join(shared, "code").withColumn("place", place).where(100 * F.col("place") <= (100 - percent) * F.col("n"))
    first = scratch.save(first.select("code", "k", "component", "n", "place"), "first-codes")
    scratch.drop("codes", "shared-codes")
    sizes = first.groupBy("code", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("code").agg(F.max(F.struct("size", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    first = first.join(scratch.save(largest, "largest"), "code")
    width = math.log(100 / percent) * (1 + 1e-9) or 1.0
    band = F.floor(F.log("n") / width).cast("int")  # of a linked pair, the larger set is in the smaller one's band or the next
    is_largest = (F.col("component") == F.col("largest")).cast("int")
    larger = first.select("code", band.alias("band"), is_largest.alias("tag"), *(F.col(c).alias(f"{c}_y") for c in ("k", "component", "n", "place")))
    smaller = first.where((100 + percent) * F.col("place") <= (100 - percent) * F.col("n"))
    smaller = smaller.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("tag", F.explode(F.when(is_largest == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    smaller = smaller.select("code", "band", "tag", *(F.col(c).alias(f"{c}_x") for c in ("k", "component", "n", "place")))
    bound = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    close = (
        (F.col("component_x") != F.col("component_y"))
        & ((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("k_x") < F.col("k_y"))))
        & ((100 + percent) * bound >= percent * (F.col("n_x") + F.col("n_y")))
    )
    pairs = smaller.join(larger, ["code", "band", "tag"]).where(close)
    return pairs.select(F.col("k_x").alias("a"), F.col("k_y").alias("b")).distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, params: NearDupParams) -> DataFrame:
    """(id, h, n, group, component) of each row: its text's hash, set size, the key of its group and that group's smallest id; null
    group and component where the set is empty or the id null.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    full = scratch.save(_describe(src.select("id", "h", "text"), params), "described")
    usable = F.col("k").isNotNull() & F.col("id").isNotNull()
    # one row per class: that of its smallest id
    reps = full.where(usable).groupBy("k").agg(F.min(F.struct("id", "h", "n", "bands", "sig")).alias("r")).select("k", "r.*")
    reps = scratch.save(reps, "classes")
    rows = scratch.save(full.select("id", "h", "n", F.when(usable, F.col("k")).alias("k")), "rows")
    scratch.drop("described")

    spread = reps.select("k", F.explode("bands").alias("bucket"))
    shared = scratch.save(spread.groupBy("bucket").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("bucket"), "shared")
    members = scratch.save(spread.join(shared, "bucket"), "members-0")
    # near copies meet in many buckets: of buckets with the same members, one is kept
    center, same = F.min("k").alias("center"), ["center", "last", "size", "x", "y"]
    marks = [center, F.max("k").alias("last"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y")]
    buckets = scratch.save(members.groupBy("bucket").agg(*marks).groupBy(*same).agg(F.min("bucket").alias("bucket")).select("bucket", "center"), "buckets")
    members = scratch.save(members.join(buckets, "bucket").select("bucket", "k", "center"), "members")
    scratch.drop("shared", "members-0", "buckets")
    # texts and signatures of the classes that share a bucket
    involved = scratch.save(reps.join(members.select("k").distinct(), "k", "left_semi").select("id", "h", "k", "n", "sig"), "involved")
    known = scratch.save(src.where("id is not null").join(involved, ["id", "h"]).select("k", "n", "sig", "text").dropDuplicates(["k"]), "known")

    pairs = members.where("k <> center").select(F.col("center").alias("a"), F.col("k").alias("b")).distinct()
    links = _confirm(pairs, known, params, scratch, "0")
    found = connected_components(links, scratch, "cc0")
    # a bucket is finished if all its members are confirmed to be linked with its center
    open_ones = members.where("k <> center").join(links.select(F.col("a").alias("center"), F.col("b").alias("k")), ["center", "k"], "left_anti").select("bucket").distinct()
    placed = scratch.save(members.join(scratch.save(open_ones, "open"), "bucket", "left_semi").select("bucket", "k"), "placed-0")
    for step in range(1, params.star_rounds + 2):
        labels = found.select(F.col("id").alias("k"), "component")
        placed = placed.select("bucket", "k").join(labels, "k", "left").withColumn("component", F.coalesce("component", "k"))
        placed = scratch.save(placed, f"labelled-{step}")
        mixed = scratch.save(placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket"), f"mixed-{step}")
        placed = scratch.save(placed.join(mixed, "bucket", "left_semi"), f"placed-{step}")
        scratch.drop(f"labelled-{step}", f"mixed-{step}", f"placed-{step - 1}")
        if placed.isEmpty():
            break
        if step <= params.star_rounds:  # one drawn member of each bucket against those of other components: this joins what is large
            drawn = F.min(F.struct(F.xxhash64("k", F.lit(step)), "k", "component"))
            drawn = scratch.save(placed.groupBy("bucket").agg(drawn.alias("c")).select("bucket", F.col("c.k").alias("a"), F.col("c.component").alias("of")), f"drawn-{step}")
            pairs = placed.join(drawn, "bucket").where("component <> of").select(F.least("a", "k").alias("a"), F.greatest("a", "k").alias("b")).distinct()
        else:
            pairs = _open_pairs(placed.select("k", "component").distinct(), known, params, scratch)
        links = _confirm(pairs, known, params, scratch, str(step))
        if not links.isEmpty():
            edges = found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links)
            found = connected_components(edges, scratch, f"cc{step}")
    scratch.drop("known", "members", *(f"placed-{k}" for k in range(params.star_rounds + 2)))

    # the smallest id of each component, and of each class
    names = reps.select("k", F.col("id").alias("rep"))
    grouped = found.select(F.col("id").alias("k"), F.col("component").alias("group"))
    named = names.join(grouped, "k", "left").select("k", "rep", F.coalesce("group", "k").alias("group"))
    named = scratch.save(named, "named")
    least = scratch.save(named.groupBy("group").agg(F.min("rep").alias("component")), "least")
    named = scratch.save(named.join(least, "group").select("k", "group", "component"), "groups")
    # rows without a class stand aside: their null keys would meet in one task
    alone = rows.where("k is null").select("id", "h", "n", F.lit(None).cast("long").alias("group"), F.lit(None).cast("long").alias("component"))
    return rows.where("k is not null").join(named, "k").select("id", "h", "n", "group", "component").union(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearDupParams = NearDupParams()) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept (it is that id)."""
    component = F.coalesce("component", "id")
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return _groups(docs, id_col, text_col, params).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearDupParams = NearDupParams()) -> DataFrame:
    """The rows of a table without near-duplicates: of each group the one with the smallest id, columns as they are.

    Rows without words or id all stay. Where rows share that smallest id, the one of the smallest text hash stays; of rows equal in id
    and text, the one that is first as JSON.
    """
    scratch = Scratch(docs.sparkSession, "distinct")
    groups = scratch.save(_groups(docs, id_col, text_col, params), "groups")
    best = groups.where("group is not null").groupBy("group").agg(F.min(F.struct("id", "h")).alias("b")).select("b.id", "b.h")
    best = scratch.save(best, "best")
    again = groups.where("group is not null").groupBy("id", "h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("id", "h")
    again = scratch.save(again.join(best, ["id", "h"], "left_semi"), "again")
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    wordless = F.col("id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    alone, rows = rows.where(wordless).select("row"), rows.where(~wordless)
    kept = rows.join(best, ["id", "h"], "left_semi")
    if not again.isEmpty():
        one = kept.join(again, ["id", "h"], "left_semi").groupBy("id", "h").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
        kept = kept.join(again, ["id", "h"], "left_anti").select("row").union(one)
    return kept.select("row").union(alone).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
