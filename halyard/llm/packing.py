"""Best-fit packing with Martello-Toth dominance reduction.

Piece lengths are whole numbers from 1 to the capacity, so an instance of any size is described by how many pieces
there are of each length. The reduction and the best fit work on that histogram (at most ``capacity`` numbers, whatever
the corpus), and their plan says how many sequences of which composition there are. Pieces then find their places
in parallel: a piece's rank among those of its length picks its sequence and offset.

Defined cases: a null or empty text is one piece, the end token alone; equal rows are separate documents; an empty
table gives an empty result; extra columns are ignored; a text of any length is cut into pieces.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_slices

END_TOKEN = 2
CAPACITY = 1024


class _Encoder(dict):
    """Token ids (little-endian unsigned 32-bit bytes) of chunks of text, remembered.

    A text is cut where a single space stands between two other characters; the pre-tokenizer always cuts before such
    a space, so chunks can be encoded one by one. Most chunks of a corpus are words seen before.
    """

    MOST = 400_000

    def __init__(self, vocab_path: str):
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(Path(vocab_path).read_text())
        self.library = Tokenizer.from_file(vocab_path)
        self.library.encode_special_tokens = True  # a special token's string in a text is ordinary text
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        to_byte = {c: b for b, c in _byte_alphabet().items()}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        ordered = all(vocab[a] < vocab[b] for a, b in zip(joined, joined[1:], strict=False))
        # ranks in merge order give the ids of the library; any other vocabulary goes through the library itself
        self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.odd = re.compile("[\x1c-\x1f\x85]").search  # white space to one library and not to the other

    def _ids(self, text: str) -> bytes:
        ids = self.fast.encode_ordinary(text) if self.fast else self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.MOST:
            self.clear()
        got = self._ids(chunk)
        if len(chunk) <= 64:
            self[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        if not text or self.fast is None or self.odd(text):
            return self._ids(text) if text else b""
        first, *rest = self.cut(text)
        return self[first] + b"".join([self[" " + c] for c in rest])


def _byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a visible character: printable ones as they are, the others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in kept}
    others = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + i) for i, b in enumerate(others)}


_ENCODERS: dict[str, _Encoder] = {}


def encoder(vocab_path: str) -> _Encoder:
    if vocab_path not in _ENCODERS:
        _ENCODERS[vocab_path] = _Encoder(vocab_path)
    return _ENCODERS[vocab_path]


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, id_col: str, text_col: str, vocab_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. Only documents over the capacity are cut; the first piece takes the odd length."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    end = np.array([END_TOKEN], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_path)
        for batch in batches:
            for first, _, texts in byte_slices(batch, "text"):
                rows, pieces, starts, lengths, sums = [], [], [], [], []
                for k, text in enumerate(texts):
                    ids = memoryview(enc.encode(text.decode("utf-8", "replace") if text else "") + end)
                    n = len(ids) // 4
                    at, piece = 0, 0
                    while at < n:
                        take = min(n, capacity) if (n - at) % capacity == 0 else (n - at) % capacity
                        rows.append(first + k)
                        pieces.append(piece)
                        starts.append(at)
                        lengths.append(take)
                        sums.append(zlib.crc32(ids[4 * at : 4 * (at + take)]))
                        at += take
                        piece += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, piece int, start long, length long, ids_crc32 long")


class _Sizes:
    """A multiset of lengths as counts, with the largest present length at or below any bound."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64).copy()

    def largest(self, upto: int, without: int = 0) -> int:
        """``without``: a length of which one piece is spoken for."""
        for s in range(min(upto, len(self.n) - 1), 0, -1):
            if self.n[s] > (s == without):
                return s
        return 0

    def smallest(self, how_many: int, without: int) -> list[int]:
        out: list[int] = []
        for s in np.flatnonzero(self.n):
            out += [int(s)] * int(min(self.n[s] - (s == without), how_many - len(out)))
            if len(out) == how_many:
                break
        return out


    def two_above(self, s: int, without: int) -> int:
        """Sum of the two shortest pieces longer than ``s``; more than any room if there are none."""
        found: list[int] = []
        for x in np.flatnonzero(self.n[s + 1 :]) + s + 1:
            found += [int(x)] * int(min(self.n[x] - (x == without), 2 - len(found)))
            if len(found) == 2:
                return sum(found)
        return len(self.n) * 2


def dominance_reduction(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Fixes the sets that provably belong to some best packing: (set, how many), and the counts left over.

    For the largest piece j that is not settled yet: if nothing fits beside it, it stays alone; if the largest piece
    that fits fills the sequence, or only one more piece can fit at all, that pair dominates every other set with j;
    if at most two more can fit, the pair dominates if its partner is no shorter than any two pieces that fit, and the
    triple of j, the partner and the largest third piece dominates if no two pieces that fit are both longer than the third.
    Removing settled pieces only removes competitors, so a set is fixed as often as its lengths allow in one step.
    """
    left, fixed = _Sizes(counts), []
    for s in range(capacity, 0, -1):
        while left.n[s] > 0:
            room = capacity - s
            partner = left.largest(room, without=s)
            if not partner:
                times, chosen = int(left.n[s]), (s,)
            else:
                small = left.smallest(3, without=s)
                pair_times = int(left.n[s] // 2) if partner == s else int(min(left.n[s], left.n[partner]))
                if partner == room or len(small) < 2 or small[0] + small[1] > room:
                    times, chosen = pair_times, (s, partner)
                elif len(small) < 3 or sum(small) > room:  # at most two more fit
                    total = max((a + left.largest(min(a, room - a), without=s) for a in range(1, room) if left.n[a] > (a == s)), default=0)
                    third = left.largest(room - partner, without=s)
                    if partner >= total:
                        times, chosen = pair_times, (s, partner)
                    elif third and left.two_above(third, without=s) > room:
                        chosen = (s, partner, third)
                        times = min(int(left.n[x]) // chosen.count(x) for x in chosen)
                        if not times:
                            break
                    else:
                        break
                else:
                    break
            fixed.append((chosen, times))
            for x in chosen:
                left.n[x] -= times
    return fixed, left.n


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit with lengths in falling order: each piece goes to the fullest open sequence that has room.

    Open sequences of equal composition are kept together, so a step handles all pieces of a length that go the same way.
    """
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms = np.zeros(capacity + 1, np.int64)
    for s in range(capacity, 0, -1):
        n = int(counts[s])
        while n:
            fits = np.flatnonzero(rooms[s:])
            if len(fits):
                room = s + int(fits[0])
                made, many = open_by_room[room].pop()
                rooms[room] -= many
                used = min(many, n)
                if many > used:
                    open_by_room[room].append((made, many - used))
                    rooms[room] += many - used
            else:
                room, made, many = capacity, (), n
                each = capacity // s
                if n >= each:  # new sequences filled with this length alone
                    used, made, n = n // each, (s,) * (each - 1), n - (n // each) * (each - 1)
                    room = capacity - s * (each - 1)
                else:
                    used, made, n = 1, (s,) * (n - 1), 1
                    room = capacity - s * len(made)
            n -= used
            open_by_room[room - s].append((made + (s,), used))
            rooms[room - s] += used
    return [x for groups in open_by_room.values() for x in groups]


def plan_packing(counts: np.ndarray, capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, places in a sequence, first offset), by rank."""
    fixed, left = dominance_reduction(counts, capacity)
    plan: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, times in fixed + best_fit(left, capacity):
        at = 0
        for s in sorted(set(lengths), reverse=True):
            places = lengths.count(s)
            plan[s].append((rank[s], sequence, places, at))
            rank[s] += places * times
            at += places * s
        sequence += times
    return {s: np.array(rows, np.int64) for s, rows in plan.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, capacity: int = CAPACITY, rows_per_rank_group: int = 1_000) -> DataFrame:
    """One row per piece with its sequence and offset; sequences are filled without gaps from offset 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = token_pieces(docs, id_col, text_col, vocab_path or default_vocab(), capacity)
    pieces = scratch.save(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")  # the numbers are fixed once they are written
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most as many rows as there are lengths
        counts[row["length"]] = row["count"]
    plan = plan_packing(counts, capacity)

    # rank within a length in two steps, so that a length with a third of all pieces is not one task's work; by number, so that equal rows are spread too
    groups = F.array(*(F.lit(max(1, -(-int(n) // rows_per_rank_group))) for n in counts))
    salt = F.pmod(F.xxhash64("id", "piece", "ids_crc32", "number"), F.element_at(groups, F.col("length").cast("int") + 1))
    pieces = pieces.withColumn("salt", salt)
    per_group = pieces.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per_group = per_group.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32", "start", "number")
    ranked = pieces.withColumn("rn", F.row_number().over(own)).join(per_group, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("rn") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                rows = plan[int(s)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                seq[at] = row[:, 1] + k // row[:, 2]
                off[at] = row[:, 3] + (k % row[:, 2]) * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(pieces.dtypes)["id"]
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
