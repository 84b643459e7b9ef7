"""Quality classifier: a support vector machine on naive Bayes features.

Indicators of hashed n-grams (bytes and words) are scaled by the log of the ratio of their smoothed class counts; a
linear hinge-loss model is fit on them by dual coordinate descent, and margins become probabilities by a logistic
curve fit on rows that the model did not see.

The model is fit on a bounded sample: at most ``fit_rows`` labelled rows, picked by a hash of the id. Scoring takes every row.

Defined cases: a null or empty text has no features and gets the score of the bias alone; labels that are null are not
used; several labels of one id count as their largest; with fewer than two classes in the sample, every score is that
class's share; copies get equal scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, byte_slices, mix64

_K = U64(0x9E3779B97F4A7C15)


def features_of(text: bytes | None, bits: int) -> np.ndarray:
    """Sorted distinct hashed features of a text: 2-, 3- and 4-byte n-grams, words, and word pairs."""
    if not text:
        return np.zeros(0, np.int64)
    shift = U64(64 - bits)
    found: list[np.ndarray] = []
    b = np.frombuffer(text, np.uint8).astype(U64)
    code = b
    for n in (2, 3, 4):
        if len(b) < n:
            break
        code = code[:-1] | b[n - 1 :] << U64(8 * n - 8)
        found.append((code + U64(n)) * _K >> shift)
    words = text.split()
    if words:
        numbers: dict[bytes, int] = {}
        ids = [numbers.setdefault(w, len(numbers)) for w in words]
        codes = np.fromiter(map(_WORD_CODES.__getitem__, numbers), U64, len(numbers))
        at = np.array(ids)
        pair = mix64(codes[at[:-1]] * U64(3) + codes[at[1:]])
        # how many of the word pairs are a word twice, and how many are new pairs: one indicator for each tenth reached
        doubled = int(10 * (at[:-1] == at[1:]).mean()) if len(at) > 1 else 0
        fresh = int(10 * len(np.unique(pair)) / len(pair)) if len(at) > 1 else 10
        marks = np.array([*range(1, doubled + 1), *range(101 + fresh, 111)], U64)
        found += [codes >> shift, pair >> shift, mix64(marks) >> shift]
    if not found:
        return np.zeros(0, np.int64)
    every = np.concatenate(found).astype(np.int64)
    if len(every) < 1 << (bits - 5):  # sorting few codes costs less than a scan of all flags
        return np.unique(every)
    seen = np.zeros(1 << bits, bool)
    seen[every] = True
    return np.flatnonzero(seen)


class _WordCodes(dict):
    """64-bit codes of words, remembered for the words met most lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code


_WORD_CODES = _WordCodes()


@dataclass(frozen=True)
class NBSVM:
    weights: np.ndarray  # of each feature, naive Bayes scale included
    bias: float
    slope: float
    offset: float
    bits: int

    ratios: np.ndarray

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """Distances to the hyperplane of rows of features, each row scaled to length 1."""
        sizes = np.array([len(x) for x in rows], np.int64)
        out = np.full(len(rows), self.bias)
        full = np.flatnonzero(sizes)
        if len(full):
            every = np.concatenate([rows[i] for i in full])
            at = np.cumsum(sizes[full]) - sizes[full]
            length = np.sqrt(np.add.reduceat(self.ratios[every] ** 2, at))
            out[full] += np.add.reduceat(self.weights[every], at) / np.where(length > 0, length, 1.0)
        return out

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        z = self.slope * self.margins([features_of(t, self.bits) for t in texts]) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, bits: int, smooth: float = 1.0) -> np.ndarray:
    """log of (smoothed share of a feature among class 1's features) over the same of class 0."""
    counts = np.full((2, 1 << bits), smooth)
    for x, y in zip(rows, labels, strict=True):
        counts[int(y), x] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def _unit(v: np.ndarray) -> np.ndarray:
    length = float(np.sqrt(v @ v))
    return v / length if length else v


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, c: tuple[float, float], epochs: int = 30, tol: float = 0.01, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights on scaled indicators, rows of length 1, and the bias that minimise |w|^2/2 + sum of c[y] * hinge loss.

    Each step solves for one row's dual variable, box-bound to [0, c of its class]; rows are visited in a fresh order each epoch.
    """
    w, bias = np.zeros(len(ratios)), 0.0
    values = [_unit(ratios[x]) for x in rows]
    norm = [float(v @ v) + 1.0 for v in values]
    sign = np.where(labels > 0, 1.0, -1.0)
    most = np.where(labels > 0, c[1], c[0])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v, y = rows[i], values[i], sign[i]
            g = y * (float(w[x] @ v) + bias) - 1.0
            a = alpha[i]
            if (a <= 0 and g >= 0) or (a >= most[i] and g <= 0):
                continue
            new = min(max(a - g / norm[i], 0.0), most[i])
            step = (new - a) * y
            if step:
                worst = max(worst, abs(new - a) * norm[i])
                alpha[i] = new
                w[x] += step * v
                bias += step
        if worst < tol:
            break
    return w, bias


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label), with Platt's smoothed targets, by Newton steps."""
    pos, neg = float(labels.sum()), float(len(labels) - labels.sum())
    t = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = float(np.std(margins)) or 1.0
    x = np.stack([margins / scale, np.ones(len(margins))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (t - p) - 1e-3 * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]) / scale, 1e-9), float(beta[1])


def fit_nbsvm(rows: list[np.ndarray], labels: np.ndarray, bits: int, c: float = 1.0) -> NBSVM:
    """Fits on four fifths, bends the margins of the last fifth to probabilities, then refits the margin on all rows."""
    n = len(rows)
    zero = np.zeros(1 << bits)
    if not n or labels.min() == labels.max():
        p = (float(labels.sum()) + 1) / (n + 2)
        return NBSVM(zero, 0.0, 1.0, float(np.log(p / (1 - p))), bits, zero)

    def one(at: np.ndarray) -> NBSVM:
        own, y = [rows[i] for i in at], labels[at]
        ratios = log_count_ratios(own, y, bits)
        each = len(y) / (2 * max(1, len(y) - y.sum())), len(y) / (2 * max(1, y.sum()))  # classes weigh the same in total
        w, bias = dual_coordinate_descent(own, y, ratios, (c * each[0], c * each[1]))
        return NBSVM(w * ratios, bias, 1.0, 0.0, bits, ratios)

    order = np.random.default_rng(1).permutation(n)
    test = order[: max(2, n // 5)]
    train = order[max(2, n // 5) :]
    slope, offset = 1.0, 0.0
    if len(train) and labels[train].min() != labels[train].max() and labels[test].min() != labels[test].max():
        part = one(train)
        slope, offset = _logistic(part.margins([rows[i] for i in test]), labels[test])
    return replace(one(order), slope=slope, offset=offset)


def held_out(id_col: str) -> Column:
    """Rows that no training uses: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 5_000, bits: int = 18) -> NBSVM:
    """Fits on at most ``fit_rows`` labelled rows that are not held out: the bound on what is broadcast and collected.

    Labelled ids come in the order of a hash, then rows of ``docs`` with these ids and different texts do, and both stop at the
    bound; only the texts of these are read. The bound holds for ids that very many rows repeat, too.
    """
    scratch = Scratch(docs.sparkSession, "labels")
    usable = labels.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    usable = usable.groupBy(F.col(id_col).alias("label_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    usable = scratch.save(usable.orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows), "ids")
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    keys = src.join(F.broadcast(usable), F.col("id") == F.col("label_id")).groupBy("id", "h").agg(F.max("y").alias("y"))
    keys = scratch.save(keys.orderBy(F.xxhash64("id", "h"), "id", "h").limit(fit_rows), "rows")
    src = src.join(F.broadcast(keys), ["id", "h"]).select("id", "text", "y", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in byte_slices(batch, "text"):
                feats = [features_of(t, bits).astype(np.int32).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, stop - start) for c in (0, 2, 3)), pa.array(feats, pa.binary())], names=["id", "y", "h", "x"])

    got = src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, y int, h long, x binary").dropDuplicates(["id", "h"]).toArrow()
    got = got.sort_by([("id", "ascending"), ("x", "ascending")])  # reruns see one order
    rows = [np.frombuffer(x, np.int32) for x in got.column("x").to_pylist()]
    return fit_nbsvm(rows, got.column("y").to_numpy(), bits)


def score_quality(docs: DataFrame, model: NBSVM, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score, predicted (1 if the score reaches the threshold) of every row."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for start, stop, texts in byte_slices(batch, "text"):
                s = m.scores(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, score double, predicted int").withColumnRenamed("id", id_col)
