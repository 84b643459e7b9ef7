"""Attributes of a data set as columns: getters with defaults, derived texts, identifiers and small decisions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dates, hashing, text


def text_of(values: Column) -> Column:
    """All values of an attribute as one text, null if there is none."""
    return F.when(F.size(values) > 0, F.array_join(values, "\\"))


def texts_of(values: Column, default: Column | None = None) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(default if default is not None else F.lit(None))


def number_of(values: Column, kind: str, default: float | None = None) -> Column:
    """The first value as a number; the default where there is none or it is no number."""
    return F.coalesce(F.try_element_at(values, F.lit(1)).try_cast(kind), F.lit(default).cast(kind))


def numbers_of(values: Column, kind: str, default: Column | None = None) -> Column:
    """All values as numbers; the default where there are none or one of them is no number."""
    got = F.transform(values, lambda v: v.try_cast(kind))
    good = (F.size(values) > 0) & ~F.exists(got, lambda v: v.isNull())
    return F.when(good, got).otherwise(default if default is not None else F.lit(None))


def date_of(values: Column, default: Column | None = None) -> Column:
    day = dates.parse_da(F.try_element_at(values, F.lit(1)))
    return F.coalesce(day, default) if default is not None else day


def nearest(name: str, *datasets: Column) -> Column:
    """An attribute of the innermost data set that has it not blank, then of those around it."""
    return F.coalesce(*(text.blank_to_null(d[name]) for d in datasets))


def shown(values: Column, separator: str = "\\") -> Column:
    """Values as a display text: texts with a backslash between them, numbers and dates with a comma."""
    return F.array_join(values.cast("array<string>"), separator)


def medium_date(day: Column) -> Column:
    """A date as en-US shows it at medium length."""
    return F.date_format(day, "MMM d, yyyy")


def medium_datetime(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy, h:mm:ss a")


def xml_datetime(c: Column) -> Column:
    """The moment of an XML dateTime, null if it isn't one."""
    good = F.trim(c).rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$")
    return F.when(good, F.try_to_timestamp(F.trim(c)))


def patient_age(existing: Column, birth: Column, days: Sequence[Column], only_if_absent: bool = True) -> Column:
    """The age that is there, if asked for, else that at the first of the days that is known; null without it or a birth date."""
    day = F.coalesce(*days)
    computed = F.when(day.isNotNull() & birth.isNotNull(), dates.age(birth, day))
    return F.coalesce(text.blank_to_null(existing), computed) if only_if_absent else computed


def patient_key(identifier: Column, issuer: Column) -> Column:
    """Identifier and issuer side by side, for display; group by the pair, as different pairs can look the same."""
    return F.concat(identifier, F.coalesce(issuer, F.lit("")))


def severity(c: Column) -> Column:
    level = F.lower(F.coalesce(c, F.lit("")))
    return F.when(level.isin("warning", "warn"), "WARN").when(level.isin("error", "err"), "ERROR").otherwise("INFO")


def viewer_message(level: Column, title: Column, message: Column) -> Column:
    names = F.when(level == "WARN", "Warning").when(level == "ERROR", "Error").otherwise("Info")
    return F.format_string("[%s] %s: %s", names, title, message)


def query_mode(c: Column) -> Column:
    mode = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(mode == "DICOM_WEB", mode).otherwise("DICOM")


def paired(frame_laterality: Column, image_laterality: Column, modifiers: Column) -> Column:
    """Whether an anatomic region has a side: a laterality that is known, or a modifier that names one."""
    side = F.coalesce(frame_laterality, image_laterality)
    sided = F.exists(F.coalesce(modifiers, F.array().cast("array<string>")), lambda m: F.coalesce(m.isin("LEFT", "RIGHT", "BILATERAL"), F.lit(False)))
    return F.coalesce((F.length(F.trim(side)) > 0) & (side != "U"), F.lit(False)) | sided


def region_text(meaning: Column, modifiers: Column) -> Column:
    inner = F.array_join(modifiers, ", ")
    return F.when(F.length(F.trim(F.coalesce(inner, F.lit("")))) > 0, F.concat(meaning, F.lit(" ("), inner, F.lit(")"))).otherwise(meaning)


def progress_text(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%d %% (%d remaining)", F.floor(100 * done / total), total - done)).otherwise("0 % (0 remaining)")


_PLACE = re.compile(r"\{([^{}]+)\}")


def path_template(pattern: str, attributes: Mapping[str, Column], now: Column | None = None) -> Column:
    """A path with each {name} replaced by the attribute, unknown ones by nothing; what can't stand in a path becomes an underscore.

    A name may have a format: ``{StudyDate,date,yyyy/MM}`` and ``{now,date,...}`` by a date pattern, ``upper``, ``slice,from[,to]`` (counted from the end
    if negative), ``number,000`` (zeros in front), ``offset,n`` (a number moved by n), ``hash`` (8 digits of the 31-fold rolling hash of the text's
    16-bit units), ``md5``, ``uid`` (a decimal identifier of the text's SHA-256). Of a null attribute, hash, md5 and uid are those of an empty text; other formats give nothing.
    """
    parts, at = [], 0
    for m in _PLACE.finditer(pattern):
        name, *form = m[1].split(",")
        value = now if name == "now" else attributes.get(name)
        parts += [F.lit(pattern[at : m.start()]), _formatted(value if value is not None else F.lit(None).cast("string"), form)]
        at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))


def _plain(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(value.cast("string"), r"[\\/:*?\"<>|\x00-\x1F]", "_"), F.lit(""))


def _formatted(value: Column, form: list[str]) -> Column:
    if not form:
        return _plain(value)
    kind, *rest = form
    text = value.cast("string")
    known = F.coalesce(text, F.lit(""))
    if kind == "date":
        day = F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd")), F.try_to_timestamp(text))
        return F.coalesce(F.regexp_replace(F.date_format(day, ",".join(rest)), r"[\\:*?\"<>|\x00-\x1F]", "_"), F.lit(""))
    if kind == "upper":
        return _plain(F.upper(text))
    if kind == "slice":
        ends = [F.lit(int(x)) for x in rest] + ([F.length(text)] if len(rest) == 1 else [])
        a, b = (F.greatest(F.when(e < 0, F.length(text) + e).otherwise(e), F.lit(0)) for e in ends)
        return _plain(F.substring(text, a + 1, F.greatest(b - a, F.lit(0))))
    if kind == "number":
        number = text.try_cast("long")
        return F.coalesce(F.when(F.length(number.cast("string")) >= len(rest[0]), number.cast("string")).otherwise(F.lpad(number.cast("string"), len(rest[0]), "0")), F.lit(""))
    if kind == "offset":
        return F.coalesce((text.try_cast("long") + int(rest[0])).cast("string"), F.lit(""))
    if kind == "hash":
        units = F.hex(F.encode(known, "UTF-16BE"))
        codes = F.transform(F.sequence(F.lit(0), F.greatest((F.length(units) / 4).cast("int") - 1, F.lit(0))), lambda i: F.coalesce(F.conv(F.substring(units, 4 * i + 1, F.lit(4)), 16, 10).cast("long"), F.lit(0).cast("long")))
        rolled = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32))
        return F.lpad(F.hex(F.when(F.length(known) > 0, rolled).otherwise(0).cast("long")), 8, "0")
    if kind == "md5":
        return F.md5(known.cast("binary"))
    if kind == "uid":
        return F.concat(F.lit("2.25."), F.conv(F.substring(F.sha2(known.cast("binary"), 256), 1, 15), 16, 10))
    raise ValueError(f"{kind} is no format of a path template")


def needs_dataset(pattern: str) -> bool:
    """Whether a path template names an attribute outside of the file's meta information (group 0002)."""
    names = [name.split(",")[0] for name in _PLACE.findall(pattern)]
    return any(name != "now" and not name.startswith("0002") for name in names)


def frame_path(path: Column, frame: Column, frames: Column) -> Column:
    """A file name with a frame's number in front of the extension, as many digits as the number of frames has; one frame has none."""
    digits = F.when(frames > 1, F.floor(F.log10(frames)).cast("int") + 1)
    name = F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1)
    numbered = F.concat(name, F.lit("-"), F.lpad(frame.cast("string"), digits, F.lit("0")), F.regexp_extract(path, r"(\.[^./]*)?$", 1))
    return F.when(frames > 1, numbered).otherwise(path)


def fragments(size: Column, most: int = 4_294_967_294) -> Column:
    """(start, length, padded) of the fragments of a code stream: at most ``most`` bytes, each padded to an even length."""
    n = F.greatest(F.ceil(size / most), F.lit(1))

    def one(i: Column) -> Column:
        length = F.least(size - i * most, F.lit(most))
        return F.struct((i * most).alias("start"), length.alias("length"), (length + length % 2).alias("padded"))

    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), one)


def required(character_set: Column, uids: Mapping[str, Column], seed: Column, key: bytes, now: str) -> dict[str, Column]:
    """Attributes that an object needs: what is there, else a default; missing identifiers come from a seed, so reruns agree; the
    creation date and time are always those of ``now``.
    """
    made = {name: F.coalesce(text.blank_to_null(c), hashing.uid_hash(F.concat_ws("/", F.lit(name), seed.cast("string")), key)) for name, c in uids.items()}
    moment = F.lit(now).cast("timestamp")
    return {"character_set": F.coalesce(text.blank_to_null(character_set), F.lit("ISO_IR 192")), **made, "creation_date": F.date_format(moment, "yyyyMMdd"), "creation_time": F.date_format(moment, "HHmmss")}


#: fixed values: attributes whose identifiers a pseudonymising edit replaces
UID_ATTRIBUTES = (
    "StudyInstanceUID",
    "SeriesInstanceUID",
    "SOPInstanceUID",
    "AffectedSOPInstanceUID",
    "FailedSOPInstanceUIDList",
    "MediaStorageSOPInstanceUID",
    "ReferencedSOPInstanceUID",
    "ReferencedSOPInstanceUIDInFile",
    "RequestedSOPInstanceUID",
    "MultiFrameSourceSOPInstanceUID",
)


def pseudonymise(c: Column, kind: T.DataType, key: bytes, names: Sequence[str] = UID_ATTRIBUTES) -> Column:
    """A data set (a struct, with arrays of structs as sequences to any depth) with the identifiers of all named attributes
    replaced; lists of identifiers one by one, blank ones stay.
    """

    def hashed(x: Column) -> Column:
        return F.coalesce(hashing.uid_hash(x, key), x)

    def field(x: Column, f: T.StructField) -> Column:
        if f.name in names and isinstance(f.dataType, T.StringType):
            return hashed(x)
        if f.name in names and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            return F.transform(x, hashed)
        return pseudonymise(x, f.dataType, key, names)

    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(field(c[f.name], f).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: pseudonymise(x, kind.elementType, key, names))
    return c


def macro(sequence: Column, **fields: str) -> Column:
    """Items of a sequence as records of the fields named; an absent sequence has none."""
    return F.coalesce(F.transform(sequence, lambda x: F.struct(*(x[source].alias(name) for name, source in fields.items()))), F.array())


def without_item(sequence: Column, index: Column) -> Column:
    """A sequence without its item of a 0-based index."""
    return F.filter(sequence, lambda x, i: i != index)


def with_item(sequence: Column, index: Column, item: Column) -> Column:
    """A sequence with its item of a 0-based index replaced."""
    return F.transform(sequence, lambda x, i: F.when(i == index, item).otherwise(x))


def authorised(aet: Column, host: Column, nodes: Sequence[tuple[str, str | None]]) -> Column:
    """Whether a node may send: its title is listed, and its host too where one is given; without a list, all may."""
    if not nodes:
        return F.lit(True)
    return F.coalesce(reduce(lambda a, b: a | b, ((aet == t) & (host == h if h is not None else F.lit(True)) for t, h in nodes)), F.lit(False))


def metadata(file_meta: Column, dataset: Column, descriptor: Mapping[str, Column]) -> Column:
    """One column of what is known of an object: its file's meta information, its data set, its image descriptor, and its syntax."""
    return F.struct(file_meta.alias("file_meta"), dataset.alias("dataset"), F.struct(*(c.alias(n) for n, c in descriptor.items())).alias("descriptor"), file_meta["transfer_syntax"].alias("transfer_syntax"))


def decodable(rows: Column, columns: Column, has_pixels: Column) -> Column:
    return F.coalesce((rows > 0) & (columns > 0) & has_pixels, F.lit(False))
