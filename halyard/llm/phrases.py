"""Mining of phrase collocations over vertical positional inverted lists.

Each task writes its texts as inverted lists: a row for each block of texts and language, with the block's words and their ascending positions;
pieces lie a position apart, so that no phrase leaves its piece. The length of a list is a word's frequency in the block. Frequent phrases of k words grow
by one: their occurrence lists are merge-joined with the lists of adjacent words, and the lengths of the new lists, summed over the blocks, are exact
frequencies. A block extends only what may be frequent in the corpus: a bitmap of fixed size (``slots`` bits, broadcast) marks the phrases of each length
whose hashes are frequent; a false mark costs work, never a count.

One pass over the lists a length gives the frequencies of marked phrases of that length, and the hashes of all phrases a word longer with their counts, from
which the next marks are made. Both are packed, a row for each block and range of hashes: some three bytes of shuffle for a phrase that turns out to be rare. Parts of phrases that hold 1/10,000 of all words each are broadcast for the scores, so no
word or language is one task's work; ranks are taken in parts of a language first.

Defined cases: a null or empty text has no words; a null language is ``und``; a block has whole documents up to ``BLOCK`` bytes, a longer document is cut between pieces,
a piece never; copies count as often as they stand; equal scores and counts go by the phrase's bytes; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import U64, Scratch, byte_slices, mix64
from .lookups import look_up

_WORD_OR_BREAK = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]+")
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
_BREAKS = frozenset(b".,;:!?\n\x0b\x0c\r")
BLOCK = 4 << 20
LISTS = "lang string, words array<string>, lengths array<int>, positions binary"
_STEP = U64(0x9E3779B97F4A7C15)
KEY_BITS = 40  # of a phrase's hash, by which it is counted before it is marked
PER_PART = 4_000_000  # words of the corpus for each part of the hashes


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text, or runs of whole pieces of about ``BLOCK`` bytes."""
    start = 0
    while start < len(text):
        cut = _BREAK.search(text, start + BLOCK)
        stop = cut.end() if cut else len(text)
        yield text[start:stop]
        start = stop


def _invert(lang: str, texts: list[bytes]) -> pa.RecordBatch:
    """One row of inverted lists: words, list lengths, and all positions, list after list, as steps from one to the next."""
    tokens = _WORD_OR_BREAK.findall(b"\n".join(texts).lower())
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    ids = coded.indices.to_numpy()
    is_word = np.array([w[0] not in _BREAKS for w in words], bool)
    positions = np.flatnonzero(is_word[ids]) if len(words) else np.zeros(0, np.int64)
    order = np.argsort(ids[positions], kind="stable")
    lists = positions[order].astype(np.int32)
    lengths = np.bincount(ids[positions], minlength=len(words))[is_word] if len(words) else np.zeros(0, np.int64)
    steps = np.diff(lists, prepend=np.int32(0)).astype(np.int32)
    kept = pa.array([w for w, k in zip(words, is_word) if k], pa.binary()).cast(pa.string())
    row = [pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), pa.array(lengths.astype(np.int32))), pa.array([steps.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(row, names=["lang", "words", "lengths", "positions"])


def inverted_lists(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``LISTS``, one for each block of texts of a language."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, _, part in byte_slices(batch, "text"):
                for i, text in enumerate(part):
                    lang = langs[start + i]
                    for piece in _pieces(text or b""):
                        open_blocks.setdefault(lang, []).append(piece)
                        sizes[lang] = sizes.get(lang, 0) + len(piece)
                        if sizes[lang] >= BLOCK:
                            yield _invert(lang, open_blocks.pop(lang))
                            del sizes[lang]
            while sum(sizes.values()) > 8 * BLOCK:  # many languages: the largest block goes
                lang = max(sizes, key=sizes.get)
                yield _invert(lang, open_blocks.pop(lang))
                del sizes[lang]
        for lang, texts in open_blocks.items():
            yield _invert(lang, texts)

    one = docs.select(docs[text_col].cast("string").alias("text"), F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"))
    return one.mapInArrow(build, LISTS)


class _Marks:
    """A bitmap of what is frequent among the phrases of one length, by the slot of their hash."""

    def __init__(self, bits: np.ndarray, slots: int):
        self.bits, self.slots = bits, slots

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = slot_of(hashes, self.slots)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def slot_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes & U64(slots - 1)).astype(np.int64)


def _extended(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(hashes * _STEP + words)


def _marks(frequent: DataFrame, slots: int) -> _Marks:
    """The bitmap of a table's slots; at most ``slots`` bits reach the driver, whatever the table's size."""
    parts = frequent.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits"))
    bits = np.zeros(max(slots // 8, 4096), np.uint8)
    for r in parts.collect():
        at = (r["part"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return _Marks(bits, slots)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^40, byte by byte so that they compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _from_planes(blob: memoryview, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * n).reshape(5, n).T
    return wide.view("<u8").ravel().astype(np.int64)


def _hash_blocks(keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, block): distinct keys in order as steps, and counts, by ranges of the keys."""
    cuts = np.searchsorted(keys, [(p << KEY_BITS) // parts for p in range(parts + 1)])
    for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if b > a:
            yield p, _planes(np.diff(keys[a:b], prepend=0)) + _planes(counts[a:b])


_GROWN = "part int, block binary, lang string, phrases array<string>, counts array<long>"


def _grown(lists: DataFrame, length: int, marks: list, parts: int, last: bool) -> DataFrame:
    """Rows of ``_GROWN``: phrases of ``length`` words (from 2) that are marked at every length, and how often each occurs in a block of texts; unless
    ``last``, also packed hashes and counts of the phrases one word longer that grow from these.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = [m.value for m in marks]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                lang = row.column(0)[0].as_py()
                words = row.column(1).flatten()
                lengths = row.column(2).flatten().to_numpy()
                at = np.cumsum(np.frombuffer(row.column(3)[0].as_py(), np.int32), dtype=np.int32)
                hashes = _word_hashes(lang, words.to_pylist())
                keep = marked[0](hashes)
                rows = np.repeat(keep, lengths)
                at, word = at[rows], np.repeat(np.arange(len(lengths), dtype=np.int64)[keep], lengths[keep])
                order = np.argsort(at)
                at, word = at[order], word[order]  # the lists of frequent words, merged by position
                start, phrase, h = at, word, hashes[word]
                for k in range(1, length + (not last)):
                    if not len(start):
                        break
                    j = np.searchsorted(at, start + k)  # the adjacent word's posting
                    j[j == len(at)] = 0
                    s = np.searchsorted(start, start + 1)  # the phrase without its first word occurs here too, or the longer one is rare
                    s[s == len(start)] = 0
                    hit = (at[j] == start + k) & (start[s] == start + 1)
                    begin, before, tail = start[hit], phrase[hit], word[j[hit]]
                    longer = _extended(h[hit], hashes[tail])
                    if k == length:
                        held.append(_summed((longer & U64((1 << KEY_BITS) - 1)).astype(np.int64), np.ones(len(longer), np.int64)))
                        count += len(held[-1][0])
                        break
                    may = marked[k](longer)
                    start, h = begin[may], longer[may]
                    _, first, phrase, n = np.unique(before[may] * len(lengths) + tail[may], return_index=True, return_inverse=True, return_counts=True)
                    if k + 1 == length and len(start):
                        part = ((h[first] >> U64(KEY_BITS)) % U64(parts)).astype(np.int64)
                        order = np.argsort(part, kind="stable")
                        where = start[first[order]]
                        text = pc.binary_join_element_wise(*(words.take(pa.array(word[np.searchsorted(at, where + i)])) for i in range(length)), " ")
                        yield from _phrase_rows(lang, part[order], text, n[order])
                if count > 4_000_000:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                    count = len(held[0][0])
                    if count > 3_000_000:
                        yield from _blocks(*held.pop(), parts)
                        count = 0
        if held:
            yield from _blocks(*_summed(*(np.concatenate(x) for x in zip(*held))), parts)

    return lists.mapInArrow(grow, _GROWN)


def _phrase_rows(lang: str, part: np.ndarray, text: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each part that has phrases, which stand in order of parts."""
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = pa.array(np.r_[at, len(part)].astype(np.int32))
    m = len(at)
    lists = [pa.ListArray.from_arrays(ends, x) for x in (text, pa.array(n.astype(np.int64)))]
    yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.nulls(m, pa.binary()), pa.array([lang] * m, pa.string()), *lists], names=["part", "block", "lang", "phrases", "counts"])


def _blocks(keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    found = list(_hash_blocks(keys, counts, parts))
    for a in range(0, len(found), 256):
        p, b = zip(*found[a : a + 256])
        m = len(p)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(b, pa.binary()), pa.nulls(m, pa.string()), pa.nulls(m, pa.list_(pa.string())), pa.nulls(m, pa.list_(pa.int64()))], names=["part", "block", "lang", "phrases", "counts"])


def _frequent(grown: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) of the phrases whose counts sum to ``least``, summed by the phrases themselves."""

    def add(table: pa.Table) -> pa.Table:
        phrases = table.column("phrases").combine_chunks()
        langs = table.column("lang").combine_chunks().take(pc.list_parent_indices(phrases))
        rows = pa.table({"lang": langs, "phrase": pc.list_flatten(phrases), "f": pc.list_flatten(table.column("counts").combine_chunks())})
        sums = rows.group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "f"])
        return sums.filter(pc.greater_equal(sums.column("f"), least))

    return grown.where("phrases IS NOT NULL").select("part", "lang", "phrases", "counts").groupBy("part").applyInArrow(add, "lang string, phrase string, f long")


def _frequent_hashes(grown: DataFrame, least: int, slots: int) -> DataFrame:
    """(slot) of the hashes whose counts sum to ``least``; a part is a range of the hashes."""

    def add(table: pa.Table) -> pa.Table:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for block in table.column("block"):
            blob = memoryview(block.as_buffer())
            n = len(blob) // 10
            held.append((np.cumsum(_from_planes(blob, n)), _from_planes(blob[5 * n :], n)))
            size += n
            if size > 2_000_000:
                keys, counts = _summed(*(np.concatenate(x) for x in zip((keys, counts), *held)))
                held, size = [], 0
        keys, counts = _summed(*(np.concatenate(x) for x in zip((keys, counts), *held)))
        return pa.table({"slot": np.unique(slot_of(keys[counts >= least].astype(U64), slots))})

    return grown.where("block IS NOT NULL").select("part", "block").groupBy("part").applyInArrow(add, "slot long")


def _word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxh64_intdigest(lang.encode()) & 0x7FFFFFFF
    return np.array([xxh64_intdigest(w, seed) for w in words], U64)


def frequent_phrases(docs: DataFrame, scratch: Scratch, text_col: str = "text", lang_col: str = "lang", most_words: int = 5, least: int = 100, slots: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all phrases of up to ``most_words`` words that occur at least ``least`` times, (lang, n) with all words of each language)."""
    spark = docs.sparkSession
    lists = scratch.save(inverted_lists(docs, text_col, lang_col), "lists")
    counted = lists.select("lang", F.inline(F.arrays_zip("words", "lengths"))).toDF("lang", "phrase", "n")
    words = scratch.save(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")), "words")
    totals = scratch.save(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    levels = [words.where(F.col("f") >= least)]
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // PER_PART))
    marks = [spark.sparkContext.broadcast(_marks(_slots(levels[0], slots), slots))]
    for k in range(1, most_words + 1):  # the pass of length 1 gives the hashes of pairs only
        grown = scratch.save(_grown(lists, k, marks, parts, k == most_words), f"grown-{k}")
        if k > 1:
            levels.append(scratch.save(_frequent(grown, least), f"phrases-{k}"))
        if k < most_words:
            marks.append(spark.sparkContext.broadcast(_marks(_frequent_hashes(grown, least, slots), slots)))
        scratch.drop(f"grown-{k}")
    for m in marks:
        m.unpersist()
    scratch.drop("lists")
    out = None
    for k, level in enumerate(levels, 1):
        level = level.select("lang", "phrase", F.lit(k).alias("words"), "f")
        out = level if out is None else out.unionByName(level)
    return out, totals


def _slots(words: DataFrame, slots: int) -> DataFrame:
    """(slot) of each word."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in pc.unique(b.column(0)).to_pylist():
                h = _word_hashes(lang, b.column(1).filter(pa.array(langs == lang)).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(slot_of(h, slots))], names=["slot"])

    return words.select("lang", "phrase").mapInArrow(add, "slot long")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = 5, least: int = 100, top: int = 2000, slots: int = 1 << 26, parts: int = 64
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a (its frequency), l and r (those of the two parts at the cut of the lowest score),
    n (words of the language), score = floor(1000 * a * n / (l * r)).

    A phrase inside a longer frequent one that occurs as often is left out.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    phrases, totals = frequent_phrases(docs, scratch, text_col, lang_col, most_words, least, slots)
    phrases = scratch.save(phrases, "frequent")
    # a phrase that is as frequent as one with a word more is inside it; all longer ones follow from that
    longer = phrases.where("words > 2")
    inner = [F.regexp_extract("phrase", r"(?s)^(.*) [^ ]*$", 1), F.regexp_extract("phrase", r"(?s)^[^ ]* (.*)$", 1)]
    inside = longer.select("lang", F.explode(F.array(*inner)).alias("phrase"), F.lit(0).alias("words"), F.lit(0).alias("f"), F.col("f").alias("longer"))
    own = phrases.where("words > 1").withColumn("longer", F.lit(0).cast("long"))
    free = own.unionByName(inside).groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.max("f").alias("a"), F.max("longer").alias("longer")).where("words > 0 AND longer < a").drop("longer")
    # every cut, with the frequencies of both sides
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")
    cuts = free.select("lang", "phrase", "a", cut, F.split("phrase", " ").alias("w"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("rest"))
    cuts = scratch.save(cuts, "cuts")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("f") * 10_000 > n_words
    parts_of = phrases.where(F.col("words") < most_words)
    for side, name in (("first", "l"), ("rest", "r")):
        table = parts_of.select("lang", F.col("phrase").alias(side), "f")
        cuts = scratch.save(look_up(cuts, table, ["lang", side], heavy).withColumnRenamed("f", name).drop(side), f"cuts-{name}")
    cuts = look_up(cuts, totals, ["lang"], F.col("n") * 10_000 > n_words)
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of two have 38 digits
    score = F.call_function("div", (F.lit(1000) * F.col("n")).cast("decimal(19,0)") * wide("a"), wide("l") * wide("r"))
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r", "n")).alias("low")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), lowest).select("lang", "phrase", "a", "low.score", "low.l", "low.r", "low.n")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
