"""Media columns: interleaved document sequences.

An HTML page is parsed into an ordered sequence of text and media-reference structs. Media payloads live in a store
keyed by digest, as 8-bit grey PNG images whose samples are the payload's bytes; a join on the digest resolves the
references, and position and caption of each reference stay with it.

Defined cases: malformed tags are read as ``markup.tags`` states, in linear time; null html has an empty sequence; a caption without
end is text; null text is an empty payload (64 zero bytes); a reference whose digest
is not in the store keeps its place with null media fields; equal payloads have one digest and one resolution; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_slices
from .markup import attributes, tags

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
REFERENCE = "media:sha256/"


def payload_of(text: bytes | None) -> bytes:
    """The text's bytes, filled up with zeros to a positive multiple of 64."""
    text = text or b""
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG, 64 samples wide, one sample a byte."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)  # each row starts with its filter type, none
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Samples of an image as written by :func:`encode_png`, checksums verified."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width, rows = 8, [], 0, 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, rows = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, width + 1)
    if raw[:, 0].any():
        raise ValueError("row filters are not used here")
    return np.ascontiguousarray(raw[:, 1:])


def feature_of(samples: np.ndarray) -> str:
    """Size, mean, spread and a 16-bin histogram of the samples in parts per thousand."""
    hist = np.bincount(samples.ravel() >> 4, minlength=16)
    n = samples.size
    total = int(samples.sum(dtype=np.int64))
    spread = int((samples.astype(np.int64) ** 2).sum()) * n - total * total
    return f"{samples.shape[1]}x{samples.shape[0]};mean={1000 * total // n};var={1000 * spread // (n * n)};hist=" + ",".join(str(int(1000 * h // n)) for h in hist)


_BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table tr figure figcaption section article header footer blockquote pre br".split())


def parse_sequence(html: str | None) -> list[dict]:
    """Text blocks and media references of a page in order: dicts of pos, kind, text, digest, caption.

    A figure's caption belongs to its media; a media element without one has its alt text.
    """
    out: list[dict] = []
    text: list[str] = []
    figure: list[dict] = []
    caption: list[str] | None = None

    def flush() -> None:
        block = " ".join(unescape("".join(text)).split())
        text.clear()
        if block:
            out.append({"kind": "text", "text": block, "digest": None, "caption": None})

    at = 0
    html = html or ""
    for start, end, name, closing, given in tags(html):
        (text if caption is None else caption).append(html[at:start])
        at = end
        if name == "figcaption":
            if closing and caption is not None:
                words = " ".join(unescape("".join(caption)).split())
                for item in figure:
                    item["caption"] = words
                caption = None
            elif not closing:
                flush()
                caption = []
        elif name in ("img", "video", "audio", "source") and not closing:
            flush()
            attrs = attributes(given)
            if attrs.get("src", "").startswith(REFERENCE):
                item = {"kind": "media", "text": None, "digest": attrs["src"][len(REFERENCE) :], "caption": attrs.get("alt")}
                out.append(item)
                figure.append(item)
        elif name in _BREAKS:
            if caption is not None and name == "figure":  # a caption without end is text
                text.extend(caption)
                caption = None
            flush()
            if name == "figure":
                figure = []
    (text if caption is None else caption).append(html[at:])
    if caption is not None:
        text.extend(caption)
    flush()
    return [x | {"pos": i} for i, x in enumerate(out)]


SEQUENCE = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
_ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])


def interleaved_sequences(pages: DataFrame, id_col: str, html_col: str, *carried: str) -> DataFrame:
    """(id, carried columns, sequence): the ordered text and media references of each page."""
    src = pages.select(pages[id_col].alias("id"), pages[html_col].cast("string").alias("html"), *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in byte_slices(batch, "html"):
                seqs = [parse_sequence(t.decode("utf-8", "replace") if t else "") for t in texts]
                own = [batch.column(c).slice(start, stop - start) for c in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(seqs, pa.list_(_ITEM))], names=["id", *carried, "sequence"])

    kinds = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("id", *carried)) + f", sequence {SEQUENCE}").withColumnRenamed("id", id_col)


def media_features(store: DataFrame) -> DataFrame:
    """One row per digest of a store (digest, media): read back, checked against the digest, described.

    Bytes never cross the network: each image is decoded where it is read, and only its description is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, blobs in byte_slices(batch, "media"):
                rows = []
                for digest, media in zip(batch.column(0).slice(start, stop - start).to_pylist(), blobs, strict=True):
                    samples = decode_png(media)
                    payload = samples.tobytes()
                    sha = hashlib.sha256(payload).hexdigest()
                    if sha != digest:
                        raise ValueError(f"payload {digest} reads back as {sha}")
                    rows.append((digest, len(payload), sha, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples)))
                cols = zip(*rows, strict=True)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_FEATURES)

    found = store.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.groupBy("digest").agg(*(F.min(c).alias(c) for c in _FEATURES[1:]))


_FEATURES = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def resolve_media(sequences: DataFrame, features: DataFrame, id_col: str, *carried: str) -> DataFrame:
    """One row per media reference with its position, caption and resolved description; a digest that is cited by a third of all pages
    is a skewed join key that adaptive execution splits, as both sides are plain tables.
    """
    refs = sequences.select(id_col, *carried, F.explode("sequence").alias("item")).where("item.kind = 'media'")
    refs = refs.select(id_col, *carried, F.col("item.pos").alias("pos"), F.col("item.caption").alias("caption"), F.col("item.digest").alias("digest"))
    return refs.join(features, "digest", "left")


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every document's text as media, cites it from an HTML page, and resolves the citations.

    One row per document: id, n_bytes, the features read back from the store, pos, caption.
    """
    scratch = Scratch(docs.sparkSession, "media")
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored: set[bytes] = set()  # within a batch, equal payloads are stored once
            for start, stop, texts in byte_slices(batch, "text"):
                sizes, pages, digests, media = [], [], [], []
                ids = batch.column(0).slice(start, stop - start)
                for key, text in zip(ids.to_pylist(), texts, strict=True):
                    payload = payload_of(text)
                    sha = hashlib.sha256(payload)
                    sizes.append(len(text or b""))
                    digests.append(sha.hexdigest())
                    media.append(None if sha.digest() in stored else encode_png(payload))
                    stored.add(sha.digest())
                    pages.append(f'<article><h1>{escape(str(key))}</h1><figure><img src="{REFERENCE}{sha.hexdigest()}"><figcaption>bytes: {sizes[-1]}</figcaption></figure></article>')
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(pages), pa.array(digests), pa.array(media, pa.binary())], names=["id", "n_bytes", "html", "digest", "media"])

    kind = dict(src.dtypes)["id"]
    store = scratch.save(src.mapInArrow(write, f"id {kind}, n_bytes long, html string, digest string, media binary"), "store", "none")
    features = scratch.save(media_features(store.where("media is not null")), "features")
    refs = resolve_media(interleaved_sequences(store, "id", "html", "n_bytes"), features, "id", "n_bytes")
    return refs.select(F.col("id").alias(id_col), "n_bytes", *_FEATURES[1:], "pos", "caption")
