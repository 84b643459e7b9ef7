"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one mask of language bits per slot. Adding an n-gram to a language sets that language's bit in
the n-gram's slots; the AND of an n-gram's slots names all languages that contain it, in one look-up for all languages.
A text's languages are scored by how many of its n-grams each contains, corrected for the share that its bits let
through by chance.

An n-gram belongs to a language if its rate there is at least ``min_share`` of its highest rate in any language, if it
was seen ``min_count`` times and at a rate of ``min_rate``; rates come from all training rows. Filters of shorter n-grams, from
4 bytes to 2, are learned in the same pass and decide, longest first, where the longer ones say nothing. The filters' size is a parameter, so what reaches
the driver and the executors is bounded.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a text of which no n-gram of any length
is known gets the first language in order with score 0, and ``accept_languages`` drops it; ties go to the first language; without training rows everything is ``und``; copies get equal predictions;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_slices, mix64

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
SHORTEST = 2
_TO_SPACE = bytes(b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def byte_ngrams(texts: list[str], n: int, starts: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-byte windows of each lower-cased text, all but letters turned into single spaces, and the index of their text.

    With ``starts``, only windows that start a character: few bytes from within one say nothing of its script.
    """
    parts = [b" ".join((b"", *t.lower().encode("utf-8", "replace").translate(_TO_SPACE).split(), b"")) for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts), np.uint8).astype(U64)
    if len(data) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    count = len(data) - n + 1
    codes = data[:count].copy()
    for j in range(1, n):
        codes |= data[j : j + count] << U64(8 * j)
    owner = np.repeat(np.arange(len(parts)), sizes)
    whole = owner[:count] == owner[n - 1 :]
    if starts:
        whole &= data[:count] & U64(0xC0) != U64(0x80)
    return codes[whole], owner[:count][whole]


def slots_of(codes: np.ndarray, hashes: int, bits: int) -> list[np.ndarray]:
    """The slots of each code: double hashing over a table of 2^bits."""
    h = mix64(codes)
    step = mix64(codes ^ U64(0x5851F42D4C957F2D)) | U64(1)
    return [((h + U64(i) * step) >> U64(64 - bits)).astype(np.int64) for i in range(hashes)]


@dataclass(frozen=True)
class LanguageFilter:
    languages: tuple[str, ...]
    masks: np.ndarray  # (2^bits, words of 8 languages)
    n: int
    hashes: int
    shorter: tuple[LanguageFilter, ...] = ()  # longest first
    starts: bool = False

    @property
    def bits(self) -> int:
        return len(self.masks).bit_length() - 1

    def false_rates(self) -> np.ndarray:
        """For each language, the chance that an n-gram it doesn't contain passes: its share of set bits to the number of hashes."""
        fill = [(self.masks[:, i // 8] >> np.uint8(i % 8) & 1).mean() for i in range(len(self.languages))]
        return np.array(fill) ** self.hashes

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language, how many n-grams the language contains; and each text's number of n-grams."""
        codes, owner = byte_ngrams(texts, self.n, self.starts)
        slots = slots_of(codes, self.hashes, self.bits)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for w in range(self.masks.shape[1]):
            column = np.ascontiguousarray(self.masks[:, w])
            found = column[slots[0]]
            for s in slots[1:]:
                found &= column[s]
            table = np.bincount(owner * 256 + found, minlength=256 * len(texts)).reshape(len(texts), 256)
            mine = range(8 * w, min(8 * w + 8, len(self.languages)))
            bit = np.array([[v >> (i - 8 * w) & 1 for i in mine] for v in range(256)])
            out[:, list(mine)] = table @ bit
        return out, np.bincount(owner, minlength=len(texts))

    def _evidence(self, texts: list[str], false_rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language, the n-grams beyond those let through by chance; and whether a text has far more than chance gives."""
        counts, total = self.counts(texts)
        chance = total[:, None] * false_rates
        sure = ((counts >= 3) & (counts > chance + 5 * np.sqrt(chance))).any(axis=1)
        return np.maximum(0.0, (counts - chance) / np.maximum(1e-9, 1 - false_rates)), sure

    def predict(self, texts: list[str | None], false_rates: np.ndarray) -> tuple[list[str], np.ndarray]:
        score = np.zeros(len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), score
        true, sure = self._evidence([t or "" for t in texts], false_rates)
        known = [has_letter(t) for t in texts]
        weak = np.flatnonzero(~sure & known)
        if self.shorter and len(weak):
            some = [texts[i] for i in weak]
            true[weak[self.shorter[-1].counts(some)[0].max(axis=1) == 0]] = 0.0  # what the longer filters let through is chance
            for f in self.shorter:
                none = true[weak].sum(axis=1) == 0
                if none.any():
                    true[weak[none]] = f._evidence([x for x, k in zip(some, none, strict=True) if k], f.false_rates())[0]
        best = true.argmax(axis=1)
        score = true[np.arange(len(texts)), best] / np.maximum(1e-9, true.sum(axis=1))
        score[~np.array(known, bool)] = 0.0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.clip(score, 0.0, 1.0)


def fit_language_filter(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = 5, bits: int = 20, hashes: int = 3, min_share: float = 0.3, min_count: int = 3, min_rate: float = 2e-7
) -> LanguageFilter:
    """Counts the n-grams of all rows by language, of ``n`` bytes and of fewer, and keeps the filters' masks.

    Counts are combined in each task before the shuffle; only the filled slots, at most 2^bits for each length, come to the driver.
    A window has no zero bytes, so its code tells its length.
    """
    lengths = range(n, min(n, SHORTEST) - 1, -1)
    src = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (codes, times) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array([lang] * len(codes)), pa.array(times)], names=["code", "lang", "times"])
            held.clear()

        for batch in batches:
            langs_all = batch.column(1).to_pylist()
            for start, stop, texts in byte_slices(batch, "text", 4 << 20):
                langs = langs_all[start:stop]
                for lang in sorted(set(langs)):
                    mine = [t.decode("utf-8", "replace") for t, x in zip(texts, langs, strict=True) if x == lang]
                    # no window of one length equals one of another: each length is counted alone, shorter codes are smaller
                    parts = [np.unique(byte_ngrams(mine, k, k < n)[0], return_counts=True) for k in reversed(lengths)]
                    codes, times = (np.concatenate(x) for x in zip(*parts, strict=True))
                    if lang in held:
                        old, old_times = held[lang]
                        merged, back = np.unique(np.concatenate([old, codes]), return_inverse=True)
                        codes, times = merged, np.bincount(back, np.concatenate([old_times, times])).astype(np.int64)
                    held[lang] = [codes, times]
                size = sum(len(v[0]) for v in held.values())
                if size > 4_000_000:
                    yield from flush()
        yield from flush()

    counts = src.mapInArrow(count, "code long, lang string, times long").groupBy("code", "lang").agg(F.sum("times").alias("times"))
    totals = {r["lang"]: r["total"] for r in src.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("total")).collect()}  # a row per language
    languages = tuple(sorted(x for x, total in totals.items() if total))
    words = max(1, -(-len(languages) // 8))
    if not languages:
        return LanguageFilter((), np.zeros((1 << bits, words), np.uint8), n, hashes)
    total = F.element_at(F.create_map(*[F.lit(x) for y in languages for x in (y, float(totals[y]))]), F.col("lang"))
    index = F.element_at(F.create_map(*[F.lit(x) for i, y in enumerate(languages) for x in (y, i)]), F.col("lang"))
    rated = counts.where(F.col("times") >= min_count).withColumn("rate", F.col("times") / total).where(F.col("rate") >= min_rate)
    grams = rated.groupBy("code").agg(F.max("rate").alias("top"), F.collect_list(F.struct("rate", index.alias("i"))).alias("langs"))
    grams = grams.select("code", F.expr(f"transform(filter(langs, x -> x.rate >= {min_share} * top), x -> x.i)").alias("langs"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.ascontiguousarray(batch.column(0).to_numpy()).view(U64)
            lists = batch.column(1)
            owner = np.repeat(np.arange(len(codes)), np.diff(lists.offsets.to_numpy()))
            langs = lists.flatten().to_numpy()
            size = sum((codes >= U64(1 << 8 * k)).astype(np.int32) for k in range(1, n)) + 1
            for slots in slots_of(codes, hashes, bits):
                yield pa.RecordBatch.from_arrays([pa.array(size[owner], pa.int32()), pa.array(slots[owner]), pa.array(langs // 8, pa.int32()), pa.array(np.left_shift(1, langs % 8), pa.int32())], names=["n", "slot", "word", "mask"])

    slots = grams.mapInArrow(place, "n int, slot long, word int, mask int").groupBy("n", "slot", "word").agg(F.bit_or("mask").alias("mask"))
    got = slots.toArrow()
    size, slot, word, mask = (got.column(c).to_numpy() for c in ("n", "slot", "word", "mask"))
    masks = {k: np.zeros((1 << bits, words), np.uint8) for k in lengths}
    for k in lengths:
        masks[k][slot[size == k], word[size == k]] = mask[size == k]
    shorter = tuple(LanguageFilter(languages, masks[k], k, hashes, starts=True) for k in lengths[1:])
    return LanguageFilter(languages, masks[n], n, hashes, shorter)


def held_out(id_col: str) -> Column:
    """Rows that no training uses: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All input columns kept under their names by the caller; here: id, lang_pred, score."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, model.false_rates()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt, rates = shared.value
        for batch in batches:
            for start, stop, texts in byte_slices(batch, "text"):
                langs, score = filt.predict([None if t is None else t.decode("utf-8", "replace") for t in texts], rates)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def accept_languages(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is in a learned language; what is ``und``, or of which no n-gram of any length is known, goes."""
    shared = docs.sparkSession.sparkContext.broadcast((model, model.false_rates()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt, rates = shared.value
        for batch in batches:
            keep: list[bool] = []
            for _, _, texts in byte_slices(batch, text_col):
                langs, score = filt.predict([None if t is None else t.decode("utf-8", "replace") for t in texts], rates)
                keep += [x != UNKNOWN and s > 0 for x, s in zip(langs, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
