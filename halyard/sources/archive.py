"""Archives of files as a data source: read by tags, written by path.

Reading: ``spark.read.format("archive").schema(...).load(folder)``. The schema says what is read: a column named as a keyword or a tag
holds that element's value; a sequence is an array of structs named in the same way. Other elements are skipped without being read, and a file is
left where the last wanted tag is passed, before its pixels at the latest. Columns of their own: ``path``, ``length``, ``position`` (where the
data set starts, -1 for XML), ``syntax``, ``class_uid``, ``instance_uid`` (file meta information, or what stands for it in the data set) and ``error``.

Partitions are planned by bytes to be read. A file that can't be read, or ends too early, is a row with an error and the values that were
found before it; no file fails a task. ``readStream`` takes files by time of modification, so writers move files in when they are whole.

Writing: rows of (name, content) become files below a folder. Tasks write to a folder of their attempt; the commit of the job moves files into place, its
abort removes them, so a killed task leaves nothing and a repeated one no second copy.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from .elements import BIG_ENDIAN, DEFLATED, EXPLICIT, IMPLICIT, LONG, tag_of

DEFAULT = "path string, length long, position long, syntax string, class_uid string, instance_uid string, error string"
OWN = frozenset("path length position syntax class_uid instance_uid error".split())
PIXELS = 0x7FE00000
ITEM, ITEM_END, SEQUENCE_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
OPEN = 0xFFFFFFFF
# fixed values: character sets by their defined terms
CHARSETS = {"ISO_IR 6": "ascii", "ISO_IR 100": "latin-1", "ISO_IR 101": "iso8859-2", "ISO_IR 109": "iso8859-3", "ISO_IR 110": "iso8859-4", "ISO_IR 144": "iso8859-5", "ISO_IR 127": "iso8859-6", "ISO_IR 126": "iso8859-7", "ISO_IR 138": "iso8859-8", "ISO_IR 148": "iso8859-9", "ISO_IR 13": "shift_jis", "ISO_IR 166": "tis_620", "ISO_IR 192": "utf-8", "GB18030": "gb18030", "GBK": "gbk"}
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "UV": "Q", "SV": "q", "FL": "f", "FD": "d"}
_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@dataclass(frozen=True)
class Wanted:
    """Columns by tag: (column, representation if the tag is known, type, columns inside of a sequence)."""

    columns: dict[int, tuple[str, str | None, T.DataType, Wanted | None]]

    @classmethod
    def of(cls, fields: list[T.StructField]) -> Wanted:
        out = {}
        for f in fields:
            kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            tag, vr = tag_of(f.name)
            out[tag] = (f.name, vr, f.dataType, cls.of(kind.fields) if isinstance(kind, T.StructType) else None)
        return cls(out)

    @property
    def last(self) -> int:
        return max(self.columns, default=-1)


class _Inflated(io.RawIOBase):
    """A deflated data set, inflated as it is read."""

    def __init__(self, source):
        self._source, self._inflate, self._rest = source, zlib.decompressobj(-15), b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self._rest and not self._inflate.eof:
            data = self._inflate.unconsumed_tail or self._source.read(1 << 16)
            if not data:
                break
            self._rest = self._inflate.decompress(data, 1 << 16)
        n = min(len(target), len(self._rest))
        target[:n], self._rest = self._rest[:n], self._rest[n:]
        return n


class Elements:
    """Walks through the elements of a stream and keeps what is wanted."""

    def __init__(self, stream, explicit: bool, little: bool = True, seekable: bool = True, room: int | None = None):
        """``room``: the bytes that are left of the file, if that is known."""
        self.stream, self.explicit, self.end, self.seekable, self.room = stream, explicit, "<" if little else ">", seekable, room
        self.charset, self.at = "utf-8", 0

    def take(self, n: int) -> bytes:
        data = self.stream.read(n) if self.room is None or self.at + n <= self.room else b""
        if len(data) < n:
            raise EOFError(f"the file ends inside an element of {n} bytes")
        self.at += n
        return data

    def skip(self, n: int) -> None:
        if not self.seekable:
            while n:
                n -= len(self.take(min(n, 1 << 16)))
            return
        if self.room is not None and self.at + n > self.room:
            raise EOFError(f"the file ends inside an element of {n} bytes")
        self.stream.seek(n, 1)
        self.at += n

    def head(self, stop: int = 0xFFFFFFFF) -> tuple[int, str | None, int] | None:
        """(tag, representation, length) of the next element, None at the end of the stream; beyond ``stop`` the tag only."""
        raw = self.stream.read(4)
        self.at += len(raw)
        if not raw:
            return None
        if len(raw) < 4:
            raise EOFError("the file ends inside a tag")
        group, number = struct.unpack(self.end + "HH", raw)
        tag = group << 16 | number
        if tag > stop:
            return tag, None, 0
        if not self.explicit or group == 0xFFFE:
            return tag, None, struct.unpack(self.end + "I", self.take(4))[0]
        vr = self.take(2)
        if not _LETTERS.issuperset(vr):
            raise ValueError(f"no value representation at tag {tag:08X}")
        name = vr.decode()
        if name in LONG:
            self.take(2)
            return tag, name, struct.unpack(self.end + "I", self.take(4))[0]
        return tag, name, struct.unpack(self.end + "H", self.take(2))[0]

    def read(self, wanted: Wanted, out: dict, stop: int | None = None, size: int | None = None) -> None:
        """Elements up to the wanted ones' last, or, inside an item, to its end."""
        begin = self.at
        while size is None or self.at - begin < size:
            before = self.at
            found = self.head() if stop is None else self.head(min(stop, PIXELS - 1))
            if found is None:
                if stop is None:
                    raise EOFError("the file ends inside a sequence")
                return
            tag, vr, length = found
            if tag == ITEM_END and stop is None:
                return
            if stop is not None and tag > min(stop, PIXELS - 1):
                if self.seekable:
                    self.stream.seek(before - self.at, 1)
                return
            name, known, kind, inner = wanted.columns.get(tag, (None, None, None, None))
            vr = vr if vr and vr != "UN" else known or vr
            if vr == "SQ" or length == OPEN:
                rows = self.sequence(inner or Wanted({}), length, keep=name is not None)
                if name is not None:
                    out[name] = rows if isinstance(kind, T.ArrayType) else (rows[0] if rows else None)
            elif tag == 0x00080005:
                raw = self.take(length)
                terms = raw.decode("ascii", "replace").strip(" \0").split("\\")
                self.charset = CHARSETS.get(terms[-1].strip().replace("ISO 2022 IR", "ISO_IR"), "latin-1" if terms[-1].strip() else "ascii")
                if name is not None:
                    out[name] = self.value(raw, "CS", kind)
            elif name is not None:
                out[name] = self.value(self.take(length), vr, kind)
            else:
                self.skip(length)

    def sequence(self, wanted: Wanted, length: int, keep: bool) -> list[dict]:
        rows: list[dict] = []
        if not keep and length != OPEN:
            self.skip(length)
            return rows
        begin = self.at
        while length == OPEN or self.at - begin < length:
            found = self.head()
            if found is None:
                raise EOFError("the file ends inside a sequence")
            tag, _, size = found
            if tag == SEQUENCE_END:
                break
            if tag != ITEM:
                raise ValueError(f"tag {tag:08X} where an item should be")
            row = dict.fromkeys(c[0] for c in wanted.columns.values())
            if not keep and size != OPEN:
                self.skip(size)
            else:
                self.read(wanted, row, size=None if size == OPEN else size)
            rows.append(row)
        return rows

    def value(self, raw: bytes, vr: str | None, kind: T.DataType):
        """The element's value as the column's type: numbers of their representation, else text; several values of a scalar text column stay joined."""
        many = isinstance(kind, T.ArrayType)
        one = kind.elementType if many else kind
        if isinstance(one, T.BinaryType):
            return [raw] if many else raw
        if vr is None or vr == "UN":
            vr = {2: "US", 4: "UL"}.get(len(raw), "LO") if isinstance(one, T.IntegralType) else "LO"
        if vr in NUMBERS:
            width = struct.calcsize(NUMBERS[vr])
            values = list(struct.unpack(f"{self.end}{len(raw) // width}{NUMBERS[vr]}", raw[: len(raw) // width * width]))
        elif vr == "AT":
            parts = struct.unpack(f"{self.end}{len(raw) // 4 * 2}H", raw[: len(raw) // 4 * 4])
            values = [f"{g:04X}{e:04X}" for g, e in zip(parts[::2], parts[1::2])]
        else:
            text = raw.decode(self.charset, "replace").rstrip(" \0")
            values = [text] if vr in ("LT", "ST", "UT", "UR") else [v.strip(" \0") for v in text.split("\\")] if text else []
        if not many and isinstance(one, T.StringType):
            return "\\".join(map(str, values)) if values else None
        cast = [_as(v, one) for v in values]
        return cast if many else next(iter(cast), None)


def _as(value, kind: T.DataType):
    if value == "":
        return None
    if isinstance(kind, T.StringType):
        return str(value)
    if isinstance(kind, T.IntegralType):
        return int(value) if not isinstance(value, str) else int(value.strip())
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    raise ValueError(f"columns of {kind.simpleString()} are not read from elements")


def read_file(stream, wanted: Wanted, length: int, with_identity: bool = True) -> Iterator[dict]:
    """Yields one dictionary that is filled on the way, so that an error leaves what was found before it."""
    out: dict = dict.fromkeys(c[0] for c in wanted.columns.values())
    yield out
    start = stream.read(132)
    if start[128:] == b"DICM":
        position = 132
    elif start[:4] in (b"\x02\x00\x00\x00", b"\x02\x00\x01\x00", b"\x02\x00\x10\x00") or start[:1] == b"\x08" or start[:2] == b"\x00\x08":
        position = 0
    else:
        raise ValueError("neither a prefix nor a leading tag")
    stream.seek(position)
    meta_columns = Wanted.of([T.StructField(n, T.StringType()) for n in ("MediaStorageSOPClassUID", "MediaStorageSOPInstanceUID", "TransferSyntaxUID")])
    meta_columns = Wanted(meta_columns.columns | {t: c for t, c in wanted.columns.items() if t >> 16 == 2})
    meta: dict = {}
    group = stream.peek(2)[:2]
    if group == b"\x02\x00":
        Elements(stream, True).read(meta_columns, meta, stop=0x0002FFFF)
    out |= {k: v for k, v in meta.items() if k in out}
    out["position"] = position = stream.tell()
    syntax = meta.get("TransferSyntaxUID")
    head = stream.peek(6)[:6]
    if syntax is None:
        little = head[:1] != b"\x00"
        syntax = (EXPLICIT if _LETTERS.issuperset(head[4:6]) else IMPLICIT) if little else BIG_ENDIAN
    out["syntax"] = syntax
    out["class_uid"], out["instance_uid"] = meta.get("MediaStorageSOPClassUID"), meta.get("MediaStorageSOPInstanceUID")
    source = io.BufferedReader(_Inflated(stream)) if syntax == DEFLATED else stream
    elements = Elements(source, syntax != IMPLICIT, syntax != BIG_ENDIAN, syntax != DEFLATED, None if syntax == DEFLATED else length - position)
    asked = dict(wanted.columns)
    lacking = with_identity and not (out["class_uid"] and out["instance_uid"])
    if lacking:
        for name in ("SOPClassUID", "SOPInstanceUID"):
            tag, vr = tag_of(name)
            asked.setdefault(tag, (name, vr, T.StringType(), None))
    data_set = Wanted({t: c for t, c in asked.items() if t >> 16 != 2})
    values = _Into(out)
    if data_set.columns:
        elements.read(data_set, values, stop=data_set.last)
    if lacking:
        by_tag = {t: c[0] for t, c in asked.items()}
        out["class_uid"] = out["class_uid"] or values.get(by_tag[0x00080016])
        out["instance_uid"] = out["instance_uid"] or values.get(by_tag[0x00080018])


class _Into(dict):
    """Values that reach the row as soon as they are read."""

    def __init__(self, row: dict):
        super().__init__()
        self._row = row

    def __setitem__(self, key, value) -> None:
        super().__setitem__(key, value)
        self._row[key] = value


def read_xml(data: bytes, wanted: Wanted) -> Iterator[dict]:
    """A data set in the native XML form."""
    out: dict = dict.fromkeys(c[0] for c in wanted.columns.values())
    yield out
    if b"<!DOCTYPE" in data[:4096]:
        raise ValueError("document types are not read")

    def walk(node, wanted: Wanted) -> dict:
        row = dict.fromkeys(c[0] for c in wanted.columns.values())
        for a in node.iterfind("{*}DicomAttribute"):
            name, _, kind, inner = wanted.columns.get(int(a.get("tag", "0"), 16), (None, None, None, None))
            if name is None:
                continue
            if inner is not None:
                rows = [walk(i, inner) for i in a.iterfind("{*}Item")]
                row[name] = rows if isinstance(kind, T.ArrayType) else (rows[0] if rows else None)
                continue
            values = ["".join(v.itertext()) for v in a.iterfind("{*}Value")]
            values += ["=".join("^".join("".join(c.itertext()) for c in g) for g in p) for p in a.iterfind("{*}PersonName")]
            many = isinstance(kind, T.ArrayType)
            if not many and isinstance(kind, T.StringType):
                row[name] = "\\".join(values) or None
            else:
                cast = [_as(v, kind.elementType if many else kind) for v in values]
                row[name] = cast if many else next(iter(cast), None)
        return row

    identity = Wanted.of([T.StructField(n, T.StringType()) for n in ("MediaStorageSOPClassUID", "MediaStorageSOPInstanceUID", "TransferSyntaxUID", "SOPClassUID", "SOPInstanceUID")])
    root = ElementTree.fromstring(data)
    out |= walk(root, wanted)
    own = walk(root, identity)
    out["position"], out["syntax"] = -1, own["TransferSyntaxUID"] or EXPLICIT
    out["class_uid"] = own["MediaStorageSOPClassUID"] or own["SOPClassUID"]
    out["instance_uid"] = own["MediaStorageSOPInstanceUID"] or own["SOPInstanceUID"]


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _listed(path: str) -> list[fs.FileInfo]:
    """Files at or below a path, in order of their names; names that begin with a dot or an underscore are no part of the archive."""
    system, place = _open(path)
    info = system.get_file_info(place)
    found = system.get_file_info(fs.FileSelector(place, recursive=True)) if info.type == fs.FileType.Directory else [info]
    inside = lambda p: p[len(place) :].strip("/").split("/") if p != place else []
    return sorted((f for f in found if f.type == fs.FileType.File and not any(part[:1] in "._" for part in inside(f.path))), key=lambda f: f.path)


def _planned(files: list[fs.FileInfo], options: dict) -> list[Files]:
    """Partitions of about ``bytesPerPartition`` bytes; of a file, ``bytesPerFile`` at most are thought to be read, and opening one counts as ``openCost`` bytes."""
    target, most, cost = (int(options.get(k, d)) for k, d in (("bytesperpartition", 32 << 20), ("bytesperfile", 256 << 10), ("opencost", 16 << 10)))
    out: list[Files] = []
    size = 0
    for f in files:
        if not out or size >= target:
            out.append(Files([]))
            size = 0
        out[-1].paths.append((f.path, f.size))
        size += min(f.size, most) + cost
    return out


class _FileReader:
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, {k.lower(): v for k, v in options.items()}
        self.path = self.options["path"]
        self.wanted = Wanted.of([f for f in schema.fields if f.name not in OWN])
        self.identity = any(f.name in ("class_uid", "instance_uid") for f in schema.fields)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        arrow = to_arrow_schema(self.schema)
        rows: list[dict] = []
        for path, length in partition.paths:
            row: dict = {}
            try:
                with system.open_input_file(path) as raw:
                    if path.lower().endswith(".xml"):
                        found = read_xml(raw.read(), self.wanted)
                    else:
                        found = read_file(io.BufferedReader(raw, 1 << 15), self.wanted, length, self.identity)
                    row = next(found)
                    next(found, None)
            except Exception as e:  # whatever a file holds, it costs its own row only
                row["error"] = f"{type(e).__name__}: {e}"[:500]
            row |= {"path": path, "length": length}
            rows.append({n: row.get(n) for n in self.schema.names})
            if len(rows) == 1024:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


class ArchiveReader(_FileReader, DataSourceReader):
    def partitions(self) -> list[Files]:
        return _planned(_listed(self.path), self.options)


class ArchiveStreamReader(_FileReader, DataSourceStreamReader):
    """Offsets are times of modification; files of the same moment come together, and none of the last ``settleSeconds``."""

    def initialOffset(self) -> dict:
        return {"upto": -1}

    def latestOffset(self) -> dict:
        import time

        before = time.time_ns() - int(float(self.options.get("settleseconds", "1")) * 1e9)
        return {"upto": max((f.mtime_ns for f in _listed(self.path) if f.mtime_ns < before), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _planned([f for f in _listed(self.path) if start["upto"] < f.mtime_ns <= end["upto"]], self.options)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class ArchiveWriter(DataSourceArrowWriter):
    """``existing`` says what becomes of a file that is there already: error (none is moved), replace or skip."""

    def __init__(self, options: dict, overwrite: bool):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.overwrite, self.existing = options["path"].rstrip("/"), overwrite, options.get("existing", "error")
        if self.existing not in ("error", "replace", "skip"):
            raise ValueError("existing is error, replace or skip")
        self.job = uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str]:
        system, place = _open(self.path)
        return system, place.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, place = self._place()
        folder = f"{place}/_temporary/{self.job}/{uuid.uuid4().hex}"  # of this attempt alone
        made: set[str] = set()
        files = 0
        for batch in iterator:
            names, contents = (batch.column(batch.schema.get_field_index(c)) for c in ("name", "content"))
            for name, content in zip(names.to_pylist(), contents):
                steps = (name or "").split("/")
                if not name or any(s in ("", ".", "..") or s[0] in "._" for s in steps):
                    raise ValueError(f"no file name: {name!r}")
                parent = "/".join([folder, *steps[:-1]])
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                if system.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound:
                    raise ValueError(f"two rows are named {name}")
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                files += 1
        return Written(folder, files)

    def _tree(self, system: fs.FileSystem, folder: str) -> list[str]:
        """Names of an attempt's files; one attempt's at a time reach the driver."""
        if system.get_file_info(folder).type != fs.FileType.Directory:
            return []
        return [f.path[len(folder) + 1 :] for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File]

    def commit(self, messages: list[Written | None]) -> None:
        system, place = self._place()
        done = [m for m in messages if m is not None]
        if self.overwrite:
            old = [f for f in _listed(self.path)] if system.get_file_info(place).type == fs.FileType.Directory else []
            for f in old:
                system.delete_file(f.path)
        with ThreadPoolExecutor(16) as pool:
            if self.existing == "error":
                there = lambda name: system.get_file_info(f"{place}/{name}").type != fs.FileType.NotFound
                for m in done:
                    names = self._tree(system, m.folder)
                    if any(pool.map(there, names)):
                        raise ValueError("files of these names are there already; nothing was written")
            moved: set[str] = set()  # folders that are there

            def move(folder: str, name: str) -> None:
                target = f"{place}/{name}"
                parent = target.rsplit("/", 1)[0]
                if parent not in moved:
                    system.create_dir(parent, recursive=True)
                    moved.add(parent)
                if system.get_file_info(target).type != fs.FileType.NotFound and self.existing == "skip":
                    return
                system.move(f"{folder}/{name}", target)

            for m in done:
                list(pool.map(lambda name, folder=m.folder: move(folder, name), self._tree(system, m.folder)))
        self._clear(system, place)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._place())

    def _clear(self, system: fs.FileSystem, place: str) -> None:
        temporary = f"{place}/_temporary"
        if system.get_file_info(f"{temporary}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{temporary}/{self.job}")
        if system.get_file_info(temporary).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(temporary)):
            system.delete_dir(temporary)


class Archive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return DEFAULT

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(schema, dict(self.options))

    def streamReader(self, schema: T.StructType) -> ArchiveStreamReader:
        return ArchiveStreamReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("an archive is written from columns name and content")
        return ArchiveWriter(dict(self.options), overwrite)


def register(spark) -> None:
    """Makes the format ``archive`` known to a session."""
    spark.dataSource.register(Archive)
