"""Quality rules by repetition coverage.

Word n-grams of several lengths are compared by rolling hashes in numpy; what counts is how many characters lie
inside n-grams and lines that occurred before. Every text is judged on its own, so the operator needs no shuffle.

Defined cases: a null or empty text has no words and fails the base rule; rows are judged one by one, so copies and
ties get equal verdicts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, byte_slices, mix64

_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class RepetitionLimits:
    """Largest allowed share of a text's word characters.

    ``repeated``: n -> share inside n-grams that occurred earlier in the text (the first occurrence is free);
    ``top``: n -> share taken by the most frequent n-gram if it occurs more than once;
    ``line_chars``: share inside lines equal to an earlier line.
    """

    repeated: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    top: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    line_chars: float = 0.20


class _Powers:
    """base^i and base^-i, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1024)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[U64(1), np.full(size - 1, _BASE)])
                self.down = np.cumprod(np.r_[U64(1), np.full(size - 1, _BASE_INV)])


_POWERS = _Powers()


class Windows:
    """Rolling hashes of all n-grams of one text, for any n, from one prefix sum."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        _POWERS.upto(len(ids) + 1)
        codes = mix64(ids.astype(U64) + U64(1))
        self.prefix = np.r_[U64(0), np.cumsum(codes * _POWERS.up[: len(ids)])]

    def groups(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Window starts in an order that has equal n-grams side by side, and for each whether it equals the one before.

        Equal hashes are confirmed word by word.
        """
        count = len(self.ids) - n + 1
        if count < 2:
            return np.arange(max(count, 0)), np.zeros(max(count, 0), bool)
        h = (self.prefix[n:] - self.prefix[:-n]) * _POWERS.down[:count]
        order = np.argsort(h, kind="stable")
        hs = h[order]
        same = np.r_[False, hs[1:] == hs[:-1]]
        if same.any():
            at = np.flatnonzero(same)
            a, b = order[at], order[at - 1]
            ok = np.ones(len(at), bool)
            for j in range(n):
                ok &= self.ids[a + j] == self.ids[b + j]
            same[at] = ok
        return order, same


def _covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which words lie in one of the windows."""
    edges = np.zeros(length + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + n, -1)
    return np.cumsum(edges[:length]) > 0


def judge(text: bytes | None, limits: RepetitionLimits = RepetitionLimits()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, repeat_share, top_share, line_share)."""
    text = text or b""
    words = text.split()
    n_words = len(words)
    n_symbols = len(text) - len(text.translate(None, _SYMBOLS))
    chars = text.translate(None, _CONTINUATION)  # one byte for each code point
    word_chars = len(chars.translate(None, _SPACES))
    seen: set[bytes] = set()
    n_dup_lines = dup_line_chars = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                n_dup_lines += 1
                dup_line_chars += len(line.translate(None, _CONTINUATION + _SPACES))
            elif line.strip():
                seen.add(line)
    if not n_words:
        return 0, 0, n_symbols, 0, 0, True, False, 0.0, 0.0, 0.0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n_words)
    n_repeat = 0
    repeat_share = top_share = 0.0
    kept = True
    if len(numbers) < n_words:
        weight = np.fromiter(map(len, chars.split()), np.int64, n_words)
        ahead = np.r_[0, np.cumsum(weight)]
        windows = Windows(ids)
        with np.errstate(over="ignore"):
            for n, most in limits.top:
                order, same = windows.groups(n)
                if not same.any():
                    break  # longer n-grams don't repeat either
                head = np.flatnonzero(~same)
                times = np.diff(np.r_[head, len(order)])
                lengths = ahead[order[head] + n] - ahead[order[head]]
                share = float((times * lengths)[times > 1].max()) / word_chars
                top_share = max(top_share, share)
                kept &= share <= most
            order, same = windows.groups(5)
            if same.any():
                both = same.copy()
                both[:-1] |= same[1:]
                n_repeat = int(_covered(order[both], 5, n_words).sum())
                for n, most in limits.repeated:
                    if n != 5:
                        order, same = windows.groups(n)
                    if not same.any():
                        break
                    share = float(weight[_covered(order[same], n, n_words)].sum()) / word_chars
                    repeat_share = max(repeat_share, share)
                    kept &= share <= most
    line_share = dup_line_chars / word_chars
    kept &= line_share <= limits.line_chars
    base_failed = n_words < 10 or 100 * n_repeat > 20 * n_words
    return (n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, bool(kept and not base_failed), repeat_share, top_share, line_share)


_OUT = pa.schema(
    [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
    + [(n, pa.float64()) for n in ("repeat_share", "top_share", "line_share")]
)


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: RepetitionLimits = RepetitionLimits()) -> DataFrame:
    """One row per input row: its id, the base measures, the shares the verdict rests on, ``base_failed`` and ``kept``."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in byte_slices(batch, "text"):
                cols = list(zip(*(judge(t, limits) for t in texts), strict=True))
                arrays = [batch.column(0).slice(start, stop - start)] + [pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", *_OUT.names])

    kind = dict(src.dtypes)["id"]
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, repeat_share double, top_share double, line_share double"
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
