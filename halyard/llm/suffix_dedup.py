"""Removal of passages that an earlier document has, by enhanced suffix arrays over the places that can repeat.

Removed is each byte covered by a string of ``length`` bytes that also starts in a document with a smaller id. Three steps find
all of these strings without ever sorting the suffixes of the whole corpus:

0. *Frequent anchors.* A pass over all texts counts, in Spark and by anchor, the surroundings that a block of texts has several of; a bitmap marks those
   anchors that too many have to meet in one task. A mark only sends an anchor on another way through step 2, so one too many does no harm.
1. *Anchors.* Every window of ``length`` bytes has one anchor, the position in it whose k-byte string has the smallest hash. Equal
   windows have equal anchors, and one position in about seventeen is one. Anchors meet by hash, packed into binary
   blocks; of equal anchors with equal surroundings (all bytes that a window around the anchor can reach) every one but
   those of the smallest id is settled at once. Tasks settle what meets within them before the shuffle, so that a passage of a third
   of all documents is a few rows. Where a document repeats the same surroundings at steps of up to ``length`` bytes (a long run of one
   character, a ruler, padding), its anchors are one record with a first and a last position.
2. *Suffix arrays.* Anchors that differ in their surroundings are where repeats begin and end. One surrounding of each kind is
   fetched, and what is found in it holds for all places of that document that have the same (its followers, joined by a handle); those of equal anchors form a bucket. A bucket's suffixes are sorted into an enhanced suffix array (suffixes and the
   lengths of common prefixes), and a stack scan walks its common-prefix interval tree: an interval is a group of equal strings
   with all its occurrences, and it is output if the bytes to the left differ (else a longer repeat covers it).
   Where equal anchors meet, their kinds are counted exactly; one with more than ``most`` is frequent as well. A frequent anchor's bucket is split one radix level deeper, by 46 of the 50 bytes of the windows that five neighbouring
   offsets of the anchor have in common, and the same arrays are built. Where even these bytes are those of too many, the last
   level has all 50 bytes as its key: its strings are equal, its tree is one interval, and aggregation finds its smallest id.
3. *Removal.* The ranges of a document are united and cut out.

Defined cases: null texts are empty; texts shorter than ``length`` lose nothing; equal ids are the same document, so none of
their rows is earlier than another; repetitive texts of any length make few records (one a run); null ids lose nothing and take nothing from others; strings are judged on the input; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, byte_slices, mix64, total_bytes

LENGTH = 50
K = 16
REACH = LENGTH - K  # bytes that a window can stand out to the left of its anchor
PAD = 64
_C1, _C2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
SLICE = 1 << 18  # bytes of text that are hashed at once, so that what is computed for each byte stays in the cache
_BLOCK = 1_200_000  # anchors that a task holds before it settles and sends them
LEAST = 2  # surroundings of an anchor in a block of texts from which on they are counted: what is missed is one a block at most
PER_BUCKET = 8_000  # strings that an array has on average
_STRINGS = 100_000  # strings whose windows a task settles at once
STEP = 5  # offsets of an anchor that the deeper radix level puts together


class Buffer:
    """Texts side by side with zeros between them, and the 8 bytes from each position as one number."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = PAD + np.r_[0, np.cumsum(sizes + PAD)][:-1].astype(np.int64)
        self.end = self.start + sizes
        gap = bytes(PAD)
        self.bytes = np.frombuffer(gap + b"".join([x for t in texts for x in (t, gap)]) + gap, np.uint8)
        # the same bytes seen from each of eight offsets, as little-endian numbers
        n = len(self.bytes) - 7
        self.eight = np.empty(n, U64)
        for k in range(8):
            self.eight[k::8] = self.bytes[k : k + (n - k + 7) // 8 * 8].view("<u8")

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of anchors, the index of their text, and the hash of their k bytes."""
        n = len(self.eight) - 8
        h = self.eight[:n] * _C1
        other = self.eight[8 : 8 + n] * _C2
        h += other
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F), (32, None)):  # mix64, in place
            np.right_shift(h, U64(shift), out=other)
            h ^= other
            if factor:
                h *= U64(factor)
        place = U64(max(1, int(n).bit_length()))
        low = h >> place
        low <<= place
        low |= np.arange(n, dtype=U64)  # the leftmost of equal hashes is the smallest
        width, done = REACH + 1, 1
        while done < width:
            step = min(done, width - done)
            m = len(low) - step
            np.minimum(low[:m], low[step:], out=other[:m])
            low, other = other[:m], low
            done += step
        edge = np.zeros(len(low) + 1, np.int64)
        full = self.end - self.start >= LENGTH
        np.add.at(edge, self.start[full], 1)
        np.add.at(edge, self.end[full] - LENGTH + 1, -1)
        inside = np.cumsum(edge[:-1]) > 0
        hit = np.zeros(n, bool)
        hit[(low[inside] & ((U64(1) << place) - U64(1))).astype(np.int64)] = True
        at = np.flatnonzero(hit)
        return at, np.searchsorted(self.start, at, side="right") - 1, h[at]

    def surroundings(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Hashes of all bytes from REACH before to LENGTH after each position, as far as the text goes."""
        left = np.minimum(at - self.start[text], REACH)
        right = np.minimum(self.end[text] - at, LENGTH)
        c = mix64((left * 256 + right).astype(U64) * _C1)
        for off in range(-REACH, LENGTH, 8):
            x = self.eight[at + off]
            if off + 8 > LENGTH:
                x = x & U64((1 << 8 * (LENGTH - off)) - 1)
            c = mix64(c + x * _C2)
        return c

    def window_hash(self, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
        """Hashes of the ``length`` bytes from each position."""
        c = np.full(len(at), length, U64)
        for off in range(0, length, 8):
            x = self.eight[at + off]
            if off + 8 > length:
                x = x & U64((1 << 8 * (length - off)) - 1)
            c = mix64(c + x * _C2)
        return c


def unite(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of each row id made one."""
    if not len(rid):
        return rid, start, end
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order].astype(np.int64), end[order].astype(np.int64)
    new = np.r_[True, rid[1:] != rid[:-1]]
    span = int(end.max()) + 2
    shift = (np.cumsum(new) - 1) * span
    reach = np.maximum.accumulate(end + shift)
    first = new | np.r_[True, start[1:] + shift[1:] > reach[:-1]]
    at = np.flatnonzero(first)
    last = np.r_[at[1:], len(rid)] - 1
    return rid[at], start[at], (reach - shift)[last]


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 4 bytes, byte by byte so that they compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _pack(doc: np.ndarray, rid: np.ndarray, size: np.ndarray, pos: np.ndarray, last: np.ndarray, kh: np.ndarray, ch: np.ndarray) -> bytes:
    """A block of runs of anchors: documents once each, positions in planes; 4 bytes of anchor hash and 5 of surroundings."""
    order = np.argsort(rid, kind="stable")
    rid = rid[order]
    head = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]])
    pick = order[head]
    counts = np.diff(np.r_[head, len(rid)]).astype(np.int32)
    ch = ch[order]
    parts = [np.array([len(head), len(rid)], np.int32), rid[head], doc[pick], size[pick].astype(np.int64), counts, kh[order].astype(np.uint32), ch.astype(np.uint32), (ch >> U64(32)).astype(np.uint8)]
    return b"".join([p.tobytes() for p in parts] + [_planes(pos[order]), _planes(last[order] - pos[order])])


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    docs, n = np.frombuffer(blob, np.int32, 2)
    at = 8
    out = []
    for kind, count in ((np.int64, docs), (np.int64, docs), (np.int64, docs), (np.int32, docs), (np.uint32, n), (np.uint32, n), (np.uint8, n)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += int(count) * np.dtype(kind).itemsize
    pos, more = (np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * n, at + 4 * int(n) * i).reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for i in range(2))
    rid, doc, size, counts, kh, c32, c8 = out
    ch = c32.astype(U64) | c8.astype(U64) << U64(32)
    return np.repeat(doc, counts), np.repeat(rid, counts), np.repeat(size, counts), pos, pos + more, kh, ch


def _first(group: np.ndarray) -> np.ndarray:
    """Where numbers that stand together begin."""
    return np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)


def _numbered_sort(key: np.ndarray) -> np.ndarray:
    """The order of keys by their leading bits, then by position: keys and positions are sorted as one number. Equal keys stand together but for rare others between them."""
    place = U64(max(1, len(key).bit_length()))
    return (np.sort((key >> place << place) | np.arange(len(key), dtype=U64)) & ((U64(1) << place) - U64(1))).astype(np.int64)


def _settle(doc: np.ndarray, kh: np.ndarray, ch: np.ndarray, by_anchor: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group, settled): records by anchor and surroundings, in their own order; settled are those with a smaller document in their group.

    ``by_anchor``: equal anchors stand together, and equal surroundings are one group; else a group may rarely be in two parts, which leaves some records unsettled.
    """
    if by_anchor:  # 32 bits of the anchor, 40 of the surroundings
        key = kh.astype(U64) << U64(32) | ch >> U64(8)
        order = np.argsort(key, kind="stable")
        key = key[order]
        if ((key[1:] == key[:-1]) & (ch[order][1:] != ch[order][:-1])).any():
            order = np.lexsort((ch, kh))
    else:
        order = _numbered_sort(mix64(kh * _C1 + ch))
    k, c, d = kh[order], ch[order], doc[order]
    head = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
    group = np.cumsum(head) - 1
    return order, group, d > np.minimum.reduceat(d, np.flatnonzero(head))[group]


def _ranges(rid: np.ndarray, size: np.ndarray, pos: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the surroundings of runs of anchors cover: they touch, as the steps of a run are no longer than what each covers."""
    return rid, np.maximum(pos - REACH, 0), np.minimum(last + LENGTH, size)


def _runs(order: np.ndarray, head: np.ndarray, rid: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first record, last position) of each run, for records in order of anchor, surroundings, text and position."""
    r, p = rid[order], pos[order]
    new = head.copy()
    step = np.diff(p)
    new[1:] |= (r[1:] != r[:-1]) | (step > LENGTH) | (step < 0)
    at = np.flatnonzero(new)
    return order[at], p[np.r_[at[1:], len(p)] - 1] if len(p) else p


def _representatives(head: np.ndarray, pos: np.ndarray, last: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(handle of the record's group, whether the group has followers); ``seed`` tells the groups apart."""
    group = np.cumsum(head) - 1
    many = np.bincount(group) > 1 if len(group) else np.zeros(0, bool)
    many |= (last > pos)[head]
    return mix64(seed[head] * _C1 + _C2)[group].view(np.int64), many[group]


_HIT = "kind int, rid long, doc long, start long, end long, key long, handle long, follows boolean"
_HIT_ARROW = pa.schema([("kind", pa.int32())] + [(n, pa.int64()) for n in ("rid", "doc", "start", "end", "key", "handle")] + [("follows", pa.bool_())])
#: ``start`` and ``end`` are a range, an anchor's position, or those of the first and last anchor of a run that follows its group's representative.
COVERED, OPEN, FREQUENT, FOLLOWER = 0, 1, 2, 3


def _hits(kind: int, rid: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, handle: np.ndarray | None = None, follows: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(rid)
    cols = [np.full(n, kind, np.int32), *(np.asarray(x).astype(np.int64) for x in (rid, doc, start, end, key, np.zeros(n) if handle is None else handle)), np.zeros(n, bool) if follows is None else follows]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_HIT_ARROW)


class Marks:
    """A bitmap by the leading bits of anchor hashes."""

    def __init__(self, bits: int):
        self.shift = U64(64 - bits)
        self.packed = np.zeros(max(1 << bits >> 3, 4096), np.uint8)

    def __call__(self, kh: np.ndarray) -> np.ndarray:
        slot = (kh >> self.shift).astype(np.int64)
        return (self.packed[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _frequent_anchors(src: DataFrame, many: int, size: int) -> Marks:
    """Marks of anchors with more than ``many`` surroundings, counted over all texts by the anchor's hash.

    Tasks count by blocks of texts and report what a block has several times, so that a count may fall short by
    ``LEAST - 1`` for each block. The bitmap has a bit for some 64 bytes of text, from 2^24 up to 2^30 (128 MB), so that marks of
    unrelated anchors are rare; that many bits at most reach the driver and the tasks.
    """
    bits = min(max(24, (size >> 6).bit_length()), 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            if count:
                kh, ch = (np.concatenate(x) for x in zip(*held, strict=True))
                order = _numbered_sort(kh)
                kh, ch = kh[order], ch[order]
                anchors = kh[_first(kh)]
                group = np.cumsum(_first(kh)) - 1
                # distinct surroundings of each anchor: its number and their leading bits, sorted as one number
                place = U64(64 - max(1, len(anchors).bit_length()))
                pairs = np.sort(group.astype(U64) << place | ch >> (U64(64) - place))
                kinds = np.bincount((pairs[_first(pairs)] >> place).astype(np.int64))
                often = kinds >= LEAST
                yield pa.RecordBatch.from_arrays([pa.array(anchors[often].view(np.int64)), pa.array(kinds[often])], names=["kh", "kinds"])
            held.clear()
            count = 0

        for batch in batches:
            for _, _, texts in byte_slices(batch, "text", SLICE):
                buf = Buffer([t or b"" for t in texts])
                at, text, kh = buf.anchors()
                held.append((kh, buf.surroundings(at, text)))
                count += len(at)
                if count >= _BLOCK:
                    yield from flush()
        yield from flush()

    anchors = src.select("text").mapInArrow(run, "kh long, kinds long").groupBy("kh").agg(F.sum("kinds").alias("kinds")).where(F.col("kinds") > many)
    place = F.shiftrightunsigned("kh", 64 - bits) + 1
    maps = anchors.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    marks = Marks(bits)
    for r in maps.collect():
        marks.packed[(r["bucket"] - 1) * 4096 :][:4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return marks


def _anchor_blocks(src: DataFrame, parts: int, frequent: Marks) -> DataFrame:
    """(part, kind, block): runs of anchors packed by the part of their hash, ranges that are settled already, and frequent anchors with their followers."""
    shared = src.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            if not held:
                return
            doc, rid, size, pos, kh, ch = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            count = 0
            if not len(doc):  # texts too short for an anchor
                return
            order, group, settled = _settle(doc, kh, ch, by_anchor=False)
            gone = order[settled]
            r, s, e = unite(*_ranges(rid[gone], size[gone], pos[gone], pos[gone]))
            rows: list[tuple[int, int, bytes]] = []
            if len(r):
                rows.append((int(r[0] % parts), COVERED, np.concatenate([r, s, e]).astype(np.int64).tobytes()))
            stay, last = _runs(order[~settled], _first(group[~settled]), rid, pos)
            doc, rid, size, pos, kh, ch = (x[stay] for x in (doc, rid, size, pos, kh, ch))
            often = frequent(kh)
            x = np.flatnonzero(often)
            if len(x):
                head = np.r_[True, (kh[x][1:] != kh[x][:-1]) | (ch[x][1:] != ch[x][:-1])]
                handle, follows = _representatives(head, pos[x], last[x], mix64(kh[x] + ch[x] * _C2) ^ (rid[x].view(U64) + pos[x].astype(U64)) * _C1)
                for kind, y in ((FREQUENT, np.flatnonzero(head)), (FOLLOWER, np.flatnonzero(follows))):
                    for a in range(0, len(y), 20_000):
                        b = y[a : a + 20_000]
                        z = x[b]
                        rows.append((int(rid[z[0]] % parts), kind, np.concatenate([rid[z], doc[z], pos[z], last[z], kh[z].view(np.int64), handle[b], follows[b].astype(np.int64)]).astype(np.int64).tobytes()))
            stay = np.flatnonzero(~often)
            part = ((kh[stay] >> U64(32)) % U64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            stay, part = stay[by], part[by]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            for a, b in zip(cuts, np.r_[cuts[1:], len(part)], strict=True):
                x = stay[a:b]
                rows.append((int(part[a]), OPEN, _pack(doc[x], rid[x], size[x], pos[x], last[x], kh[x], ch[x])))
            for at in range(0, len(rows), 256):
                cols = list(zip(*rows[at : at + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["part", "kind", "block"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            rids = batch.column(1).to_numpy()
            for start, _, texts in byte_slices(batch, "text", SLICE):
                buf = Buffer([t or b"" for t in texts])
                at, text, kh = buf.anchors()
                held.append((ids[start + text], rids[start + text], (buf.end - buf.start)[text], at - buf.start[text], kh, buf.surroundings(at, text)))
                count += len(at)
                if count >= _BLOCK:
                    yield from flush()
        yield from flush()

    return src.mapInArrow(run, "part int, kind int, block binary")


def _meet_anchors(blocks: DataFrame, most: int) -> DataFrame:
    """Settles the anchors of each part; what is left are anchors of several documents with several surroundings, one record for each kind and
    followers, and frequent anchors: those marked before and those that turn out to have more than ``most`` kinds."""

    def run(table: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        got: list[tuple[np.ndarray, ...]] = []
        part = table.column("part")[0].as_py()
        for kind, block in zip(table.column("kind").to_pylist(), table.column("block"), strict=True):
            if kind == COVERED:
                r, s, e = np.frombuffer(block.as_buffer(), np.int64).reshape(3, -1)
                out.append(_hits(COVERED, r, r, s, e, r))
            elif kind in (FREQUENT, FOLLOWER):
                r, d, p, e, k, h, f = np.frombuffer(block.as_buffer(), np.int64).reshape(7, -1)
                out.append(_hits(kind, r, d, p, e, k, h, f.astype(bool)))
            else:
                got.append(_unpack(block.as_buffer()))
        if got:
            doc, rid, size, pos, last, kh, ch = (np.concatenate(x) for x in zip(*got, strict=True))
            got.clear()
            order, of, settled = _settle(doc, kh, ch, by_anchor=True)
            gone = order[settled]
            r, s, e = unite(*_ranges(rid[gone], size[gone], pos[gone], last[gone]))
            out.append(_hits(COVERED, r, r, s, e, r))
            k, d = kh[order], doc[order]
            new = np.r_[True, k[1:] != k[:-1]]
            at = np.flatnonzero(new)
            kinds = np.add.reduceat(_first(of).astype(np.int64), at)
            several = (kinds > 1) & (np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at))
            group = np.cumsum(new) - 1
            key = (k.astype(np.int64) << 31) ^ part
            x = np.flatnonzero(several[group] & ~settled)
            if len(x):
                o, head = order[x], _first(of[x])
                handle, follows = _representatives(head, pos[o], last[o], mix64(key[x].view(U64) + ch[o] * _C2))
                often = kinds[group[x]] > most
                for kind, y in ((OPEN, head & ~often), (FREQUENT, head & often), (FOLLOWER, follows)):
                    z = o[y]
                    out.append(_hits(kind, rid[z], doc[z], pos[z], last[z], key[x[y]], handle[y], follows[y]))
        return pa.Table.from_batches(out, schema=_HIT_ARROW)

    return blocks.groupBy("part").applyInArrow(run, _HIT)


_CONTEXT = "kind int, key long, rid long, doc long, start long, follows boolean, bytes binary"


def _fetch_surroundings(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``_CONTEXT``: the surroundings of open anchors, and of frequent ones the part around each run of STEP offsets,
    with the hash of anchor and common bytes as key. Where others follow, ``rid`` is the handle and ``start`` counts from where the surroundings begin."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "key", "handle", F.col("follows").cast("long").alias("follows"))).alias("want"))
    joined = src.join(lists, "rid").select("id", "rid", "text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wants = batch.column(3)
            for begin, stop, texts in byte_slices(batch, "text", SLICE):
                kind, key, rid, doc, start, follows, data = [], [], [], [], [], [], []
                for i, text in enumerate(texts):
                    flat = wants[begin + i].values
                    own = set(zip(*(flat.field(j).to_pylist() for j in range(5))))  # equal rows ask twice
                    n, me, document = len(text), int(rids[begin + i]), int(ids[begin + i])
                    often = np.array([x[1:] for x in own if x[0] == FREQUENT], np.int64).reshape(-1, 4).T
                    for _, p, k, h, f in sorted(x for x in own if x[0] == OPEN):
                        s = max(p - REACH, 0)
                        kind.append(OPEN)
                        key.append(k)
                        rid.append(h if f else me)
                        start.append(0 if f else s)
                        follows.append(bool(f))
                        data.append(text[s : min(p + LENGTH, n)])
                    if often.shape[1]:
                        buf = Buffer([text])
                        p, k, h, f = (np.repeat(x, (REACH + 1) // STEP) for x in often)
                        nearest = np.tile(np.arange(0, REACH + 1, STEP), often.shape[1])
                        farthest = nearest + STEP - 1
                        # the bytes that all windows of these offsets have; where they are not there, no such window is
                        fits = (p - nearest >= 0) & (p + LENGTH - farthest <= n)
                        p, k, h, f, nearest, farthest = (x[fits] for x in (p, k, h, f, nearest, farthest))
                        common = buf.window_hash(buf.start[0] + p - nearest, LENGTH - STEP + 1)
                        key += mix64(common + k.view(U64) * _C1 + nearest.astype(U64)).view(np.int64).tolist()
                        s, e = np.maximum(p - farthest, 0), np.minimum(p + LENGTH - nearest, n)
                        kind += [FREQUENT] * len(s)
                        rid += np.where(f > 0, h, me).tolist()
                        start += np.where(f > 0, s - np.maximum(p - REACH, 0), s).tolist()
                        follows += (f > 0).tolist()
                        data += [text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
                    doc += [document] * (len(kind) - len(doc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind, pa.int32()), *(pa.array(x, pa.int64()) for x in (key, rid, doc, start)), pa.array(follows, pa.bool_()), pa.array(data, pa.binary())],
                    names=["kind", "key", "rid", "doc", "start", "follows", "bytes"],
                )

    return joined.mapInArrow(run, _CONTEXT)


class EnhancedSuffixArray:
    """Suffixes of at least LENGTH bytes of many short strings, those only that share their first LENGTH bytes with another."""

    def __init__(self, strings: list[bytes]):
        buf = Buffer(strings)
        sizes = buf.end - buf.start
        many = np.maximum(sizes - LENGTH + 1, 0)
        string = np.repeat(np.arange(len(strings)), many)
        offset = np.arange(len(string)) - np.repeat(np.cumsum(many) - many, many)
        at = buf.start[string] + offset
        h = buf.window_hash(at)
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        keep = times[back] > 1
        string, offset, at, h = string[keep], offset[keep], at[keep], h[keep]
        length = sizes[string] - offset
        tail = np.zeros((len(at), 40), np.uint8)  # what follows the first LENGTH bytes, zeros beyond the end
        most = int(length.max() - LENGTH) if len(at) else 0
        for j in range(min(most, 40)):
            tail[:, j] = np.where(length > LENGTH + j, buf.bytes[at + LENGTH + j], 0)
        ranks = tail.view(">u8")
        order = np.lexsort((*(ranks[:, j] for j in range(4, -1, -1)), h))
        self.string, self.offset, at, h, length, tail = string[order], offset[order], at[order], h[order], length[order], tail[order]
        same = np.zeros(len(at), bool)
        same[1:] = h[1:] == h[:-1]
        for off in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            x = buf.eight[at + off]
            same[1:] &= x[1:] == x[:-1]
        differs = np.ones((len(at), 41), bool)
        differs[1:, :40] = tail[1:] != tail[:-1]
        common = differs.argmax(axis=1)
        limit = length.copy()
        limit[1:] = np.minimum(length[1:], length[:-1])
        #: bytes in common with the suffix before, 0 if fewer than LENGTH
        self.lcp = np.where(same, np.minimum(LENGTH + common, limit), 0)
        #: the byte to the left; where a string begins, a value that equals no other
        self.left = np.where(self.offset > 0, buf.bytes[at - 1].astype(np.int64), -1 - np.arange(len(at)))

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes (first, last, length) of the common-prefix interval tree at depth LENGTH or more, by one scan with a stack."""
        lcp = self.lcp
        n = len(lcp)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        heads = np.flatnonzero(lcp == 0)
        last = np.r_[heads[1:], n] - 1
        heads, last = heads[last > heads], last[last > heads]
        firsts, lasts, lengths = [], [], []
        if len(heads):  # the least and the greatest common prefix of each run
            bounds = np.stack([heads + 1, last + 1], axis=1).ravel()
            bounds = bounds[:-1] if bounds[-1] == n else bounds
            low, high = np.minimum.reduceat(lcp, bounds)[::2], np.maximum.reduceat(lcp, bounds)[::2]
            flat = low == high  # such a run is one node
            firsts.append(heads[flat])
            lasts.append(last[flat])
            lengths.append(low[flat])
            f, la, le = [], [], []
            for a, b in zip(heads[~flat].tolist(), last[~flat].tolist(), strict=True):
                stack: list[tuple[int, int]] = []  # (length, first)
                values = lcp[a + 1 : b + 1].tolist()
                for i, value in enumerate((*values, 0), a + 1):
                    first = i - 1
                    while stack and stack[-1][0] > value:
                        depth, first = stack.pop()
                        f.append(first)
                        la.append(i - 1)
                        le.append(depth)
                    if value and (not stack or stack[-1][0] < value):
                        stack.append((value, first))
            firsts.append(np.array(f, np.int64))
            lasts.append(np.array(la, np.int64))
            lengths.append(np.array(le, np.int64))
            return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(lengths)
        return (np.zeros(0, np.int64),) * 3

    def maximal_repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals whose occurrences are not all preceded by one and the same byte."""
        first, last, length = self.intervals()
        changes = np.r_[0, np.cumsum(self.left[1:] != self.left[:-1])] if len(self.left) else np.zeros(0, np.int64)
        diverse = changes[last] > changes[first] if len(first) else np.zeros(0, bool)
        return first[diverse], last[diverse], length[diverse]


def repeats_of(strings: list[bytes], doc: np.ndarray, rid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (rid, start, end) of all occurrences of maximal repeats that a smaller document has too."""
    array = EnhancedSuffixArray(strings)
    first, last, length = array.maximal_repeats()
    empty = np.zeros(0, np.int64)
    if not len(first):
        return empty, empty, empty
    doc = doc[array.string]
    many = last - first + 1
    node = np.repeat(np.arange(len(first)), many)
    at = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many) + first[node]
    least = np.minimum.reduceat(doc[at], np.cumsum(many) - many)
    late = doc[at] > least[node]
    at, node = at[late], node[late]
    s = start[array.string[at]] + array.offset[at]
    return unite(rid[array.string[at]], s, s + length[node])


def _scan_buckets(contexts: DataFrame, parts: int) -> DataFrame:
    """(rid, start, end, follows): what the arrays find."""

    def run(table: pa.Table) -> pa.Table:
        rid, start, doc, follows = (table.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "start", "doc", "follows"))
        order = np.lexsort((follows, rid))
        new = np.r_[True, (rid[order][1:] != rid[order][:-1]) | (follows[order][1:] != follows[order][:-1])]
        own = np.empty(len(rid), np.int64)  # numbers of owners, in which a handle differs from a row id of the same value
        own[order] = np.cumsum(new) - 1
        first = order[new]
        r, s, e = repeats_of(table.column("bytes").to_pylist(), doc, own, start)
        return pa.table({"rid": rid[first][r], "start": s.astype(np.int64), "end": e.astype(np.int64), "follows": follows[first][r].astype(bool)})

    bucket = F.pmod(F.xxhash64("key"), F.lit(parts)).alias("bucket")
    return contexts.select(bucket, "rid", "doc", "start", "follows", "bytes").groupBy("bucket").applyInArrow(run, "rid long, start long, end long, follows boolean")


def settled_windows(strings: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place, settled) of each window of ``length`` bytes: settled are those that a string of a smaller document has too. Equal windows meet by hash and are compared byte by byte."""
    buf = Buffer(strings)
    many = np.maximum(buf.end - buf.start - LENGTH + 1, 0)
    string = np.repeat(np.arange(len(strings)), many)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(many) - many, many)
    at = buf.start[string] + offset
    h = buf.window_hash(at)
    order = np.argsort(h, kind="stable")
    string, offset, at, h = string[order], offset[order], at[order], h[order]
    same = h[1:] == h[:-1]
    for off in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        x = buf.eight[at + off]
        same &= x[1:] == x[:-1]
    if not len(string):
        return string, offset, np.zeros(0, bool)
    head = np.r_[True, ~same]
    d = doc[string]
    return string, start[string] + offset, d > np.minimum.reduceat(d, np.flatnonzero(head))[np.cumsum(head) - 1]


def _equal_windows(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """Ranges of windows that a smaller document has, by the windows' own bytes: the last radix level.

    Tasks settle the windows that meet within them, so that of a window of many documents each task sends on its smallest document's only; these meet in Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            data = table.column("bytes").to_pylist()
            rid, doc, first, follows = (table.column(c).to_numpy() for c in ("rid", "doc", "start", "follows"))
            string, place, settled = settled_windows(data, doc, first)
            # ranges of one string touch, so they are united by it
            s, a, b = unite(string[settled], place[settled], place[settled] + LENGTH)
            t, c = string[~settled], place[~settled]
            windows = [data[i][p : p + LENGTH] for i, p in zip(t.tolist(), (c - first[t]).tolist(), strict=True)]
            owner = np.r_[s, t]
            columns = [pa.array(rid[owner]), pa.array(doc[owner]), pa.array(np.r_[a, c].astype(np.int64)), pa.array(np.r_[b, c + LENGTH].astype(np.int64)), pa.array(follows[owner].astype(bool)), pa.array([None] * len(s) + windows, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["rid", "doc", "start", "end", "follows", "window"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _STRINGS:
                yield flush()
        if held:
            yield flush()

    strings = contexts.where(F.length("bytes") >= LENGTH).select("rid", "doc", "start", "follows", "bytes")
    windows = scratch.save(strings.mapInArrow(run, "rid long, doc long, start long, end long, follows boolean, window binary"), "windows")
    rest = windows.where("window is not null")
    least = scratch.save(rest.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("least <> last").drop("last"), "least")
    met = rest.join(least, "window").where("doc > least")
    return windows.where("window is null").select("rid", "start", "end", "follows").union(met.select("rid", "start", "end", "follows"))


def earlier_passages(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, most: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(source, ranges): documents as (id, rid, text), and the byte ranges (rid, start, end) that earlier documents have.

    ``most`` bounds how many strings of one key a task puts into an array.
    """
    spark = docs.sparkSession
    src = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    src = src.select("id", F.xxhash64("id", "text").alias("rid"), "text")
    usable = src.where("id is not null")
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _, size = total_bytes(usable, "text")
    parts = max(wide, -(-size // (32 << 20)))
    frequent = _frequent_anchors(usable, most, size)
    hits = scratch.save(_meet_anchors(_anchor_blocks(usable, parts, frequent), most), "hits")
    wanted = hits.where(F.col("kind").isin(OPEN, FREQUENT)).select("kind", "rid", "start", "key", "handle", "follows")
    contexts = scratch.save(_fetch_surroundings(usable, wanted), "contexts")
    often = contexts.where(F.col("kind") == FREQUENT)
    too_many = scratch.save(often.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"), "too-many")
    arrays = contexts.where(F.col("kind") == OPEN).union(often.join(too_many, "key", "left_anti").select(*contexts.columns))
    scanned = _scan_buckets(arrays, max(wide, -(-contexts.count() // PER_BUCKET)))
    equal = _equal_windows(often.join(too_many, "key", "left_semi").select(*contexts.columns), scratch)
    found = scratch.save(scanned.union(equal), "found")
    covered = hits.where(F.col("kind") == COVERED).select("rid", "start", "end")
    # a run that follows has in each of its places what the representative has
    runs = hits.where(F.col("kind") == FOLLOWER).select("handle", F.col("rid").alias("of"), F.greatest(F.col("start") - REACH, F.lit(0)).alias("first"), F.greatest(F.col("end") - REACH, F.lit(0)).alias("last"))
    relative = found.where("follows").select(F.col("rid").alias("handle"), "start", "end")
    followed = relative.join(runs, "handle").select(F.col("of").alias("rid"), (F.col("first") + F.col("start")).alias("start"), (F.col("last") + F.col("end")).alias("end"))
    return src, covered.union(found.where("NOT follows").select("rid", "start", "end")).union(followed)


def _with_ranges(src: DataFrame, ranges: DataFrame) -> DataFrame:
    lists = ranges.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("cut"))
    return src.join(lists, "rid", "left")


def _cuts(value: pa.Scalar) -> list[tuple[int, int]]:
    if not value.is_valid:
        return []
    s, e = (value.values.field(j).to_numpy() for j in range(2))
    _, s, e = unite(np.zeros(len(s), np.int64), s, e)
    return list(zip(s.tolist(), e.tolist(), strict=True))


def _rest(text: bytes, cuts: list[tuple[int, int]]) -> list[bytes]:
    at, kept = 0, []
    for s, e in cuts:
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return kept


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    scratch = Scratch(docs.sparkSession, "passages")
    src, ranges = earlier_passages(docs, id_col, text_col, scratch)
    joined = _with_ranges(src, ranges).select("id", "text", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in byte_slices(batch, "text"):
                rows = []
                for i, text in enumerate(texts):
                    cuts = _cuts(batch.column(2)[start + i])
                    rows.append((len(text), sum(e - s for s, e in cuts), len(cuts), hashlib.sha256(b"".join(_rest(text, cuts))).hexdigest()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                )

    return joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with the passages cut out of the text; a character of which a byte is removed goes whole."""
    scratch = Scratch(docs.sparkSession, "passages")
    src, ranges = earlier_passages(docs, id_col, text_col, scratch)
    lists = ranges.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("cut"))
    rid = F.xxhash64(docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    joined = docs.select(F.struct("*").alias("row"), docs[text_col].cast("string").alias("text"), rid.alias("rid")).join(lists, "rid", "left").select("row", "text", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in byte_slices(batch, "text"):
                kept = [None if t is None else "".join(x.decode("utf-8", "ignore") for x in _rest(t, _cuts(batch.column(2)[start + i]))) for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(kept, pa.string())], names=["row", "text"])

    got = joined.mapInArrow(run, f"row {joined.schema['row'].dataType.simpleString()}, text string")
    return got.select(*(F.col("text").alias(text_col) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
