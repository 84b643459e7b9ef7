"""Importance resampling towards a target distribution, by hashed runs of words.

A document is scanned once: a ring keeps the running zlib states of the runs that start at the last ``n`` words, each next word
(with the space before it) extends all of them, and every state on the way is the CRC of a feature. Buckets of features are counted over the
corpus and over the target texts; a document's weight is the sum of its buckets' gains, and the highest weights with Gumbel noise are drawn.

Only sums by bucket (``buckets`` numbers a task) and one short row a document are shuffled; the draw is a rank over written ranges.

Defined cases: a null or empty text has no features and weight 0; long texts are scanned in slices of about ``SLICE`` bytes, between which the
ring is handed on; a null id draws as the empty id and comes last among ties; rows equal in id and score are in the order of their features, equal rows are interchangeable;
an empty corpus gives an empty result, empty target texts give gains against an even target; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators.ranking import ranked

from .common import Scratch, byte_slices

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
SLICE = 1 << 20


class CrcRing:
    """States of the runs that end at the latest word: one for each length below ``n``, as long as the document has as many words."""

    def __init__(self, n: int):
        self.n = n
        self.states: list[int | None] = [None] * n

    def feed(self, words: list[bytes]) -> list[list[int]]:
        """The CRCs of all runs that end at one of these words, a list for each length."""
        out: list[list[int]] = []
        if not words:
            return out
        spaced = [b" " + w for w in words]
        states = list(map(crc32, words))
        skipped = 0  # words of this slice that have too few words before them
        for length in range(self.n):
            out.append(states)
            before, self.states[length] = self.states[length], states[-1] if states else None
            if before is None:
                skipped += 1
                states = list(map(crc32, spaced[skipped:], states))
            else:
                skipped = 0
                states = list(map(crc32, spaced, [before, *states]))
        return out


def _slices(text: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + SLICE)
        stop = gap.end() if gap else len(text)
        yield text[start:stop]
        start = stop


def feature_buckets(text: bytes | None, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end at them), slice by slice."""
    ring = CrcRing(n)
    for piece in _slices((text or b"").lower()):
        words = _WORD.findall(piece)
        if words:
            yield len(words), np.concatenate([np.array(s, np.int64) for s in ring.feed(words)]) % buckets


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = 3, buckets: int = 10_000) -> DataFrame:
    """(bucket, features): how many features of all texts fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, part in byte_slices(batch, "text"):
                for text in part:
                    for _, b in feature_buckets(text, n, buckets):
                        found += np.bincount(b, minlength=buckets)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], names=["bucket", "features"])

    return texts.select(texts[text_col].cast("string").alias("text")).mapInArrow(count, "bucket long, features long").groupBy("bucket").agg(F.sum("features").alias("features"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 * ln of the target's share over the corpus's share) by bucket, shares smoothed by one feature a bucket; ``buckets`` rows reach the driver."""

    def dense(counts: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in counts.collect():  # a row a bucket at most
            out[r["bucket"]] = r["features"]
        return out

    s, t = dense(corpus), dense(target)
    of_s, of_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * of_s / ((a + 1.0) * of_t))) for a, b in zip(s, t)], np.int64)


def weigh_documents(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, part in byte_slices(batch, "text"):
                for text in part:
                    words = features = weight = 0
                    for w, b in feature_buckets(text, n, buckets):
                        words, features, weight = words + w, features + len(b), weight + int(gains[b].sum())
                    rows.append((words, features, weight))
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "n_words", "n_features", "weight"])

    one = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return one.mapInArrow(weigh, f"id {one.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    n: int = 3,
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Every row's id, n_words, n_features, weight and score, and the rank of those drawn: ``percent`` of the rows with at least ``least_words`` words,
    by highest score, ties to smaller ids. The score is the weight plus Gumbel noise of a digest of seed and id.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    gains = bucket_gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_col, n, buckets), buckets)
    rows = weigh_documents(docs, gains, id_col, text_col, n)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = scratch.save(rows.select("id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("may")), "scores")
    drawn = percent * rows.where("may").count() // 100
    order = [F.col("may").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    out = ranked(rows, order, "place", scratch.path("ranges"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.when(F.col("may") & (F.col("place") <= drawn), F.col("place")).alias("rank"))
