"""Transfer syntaxes: what an identifier means, and the decisions that follow from it. Identifiers are columns of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "1.2.840.10008.1.2"
IMPLICIT, EXPLICIT = ROOT, f"{ROOT}.1"
# fixed values: registered transfer syntaxes by type, as what follows the root
TYPES = {
    "NATIVE": ["", ".1", ".2"],
    "DEFLATED": [".1.99"],
    "JPEG_BASELINE": [".4.50"],
    "JPEG_EXTENDED": [".4.51"],
    "JPEG_SPECTRAL": [".4.53"],
    "JPEG_PROGRESSIVE": [".4.55"],
    "JPEG_LOSSLESS": [".4.57", ".4.70"],
    "JPEG_LS": [".4.80", ".4.81"],
    "JPEG_2000": [".4.90", ".4.91", ".4.92", ".4.93", ".4.201", ".4.202", ".4.203"],
    "JPIP": [".4.94", ".4.95", ".4.204", ".4.205"],
    "MPEG": [f".4.{n}{f}" for n in range(100, 107) for f in ("", ".1")] + [".4.107", ".4.108"],
    "JPEG_XL": [".4.110", ".4.111", ".4.112"],
    "RLE": [".5"],
}
# fixed values: type -> encapsulated, a frame may span fragments, can carry a sign, most bits stored, planar configuration
PROPERTIES = {
    "NATIVE": (False, False, True, 16, 0),
    "DEFLATED": (False, False, True, 16, 0),
    "JPEG_BASELINE": (True, True, False, 8, 0),
    "JPEG_EXTENDED": (True, True, False, 12, 0),
    "JPEG_SPECTRAL": (True, True, False, 12, 0),
    "JPEG_PROGRESSIVE": (True, True, False, 12, 0),
    "JPEG_LOSSLESS": (True, True, True, 16, 0),
    "JPEG_LS": (True, True, True, 16, 0),
    "JPEG_2000": (True, True, True, 16, 0),
    "JPIP": (False, False, True, 16, 0),
    "MPEG": (True, False, False, 8, 0),
    "JPEG_XL": (True, True, True, 24, 0),
    "RLE": (True, False, True, 16, 1),
    "UNKNOWN": (False, False, True, 16, 0),
}
_OF = {f"{ROOT}{end}": kind for kind, ends in TYPES.items() for end in ends}
UIDS = tuple(_OF)
#: the pixel types of an image, in the order that "at most" refers to
DEPTHS = ("8U", "8S", "16U", "16S", "32S", "32F", "64F")


def _ends(*ends: str) -> list[str]:
    return [f"{ROOT}{e}" for e in ends]


ADAPTABLE = _ends(".4.50", ".4.51", ".4.53", ".4.55")
LOSSY = [*ADAPTABLE, *_ends(".4.81", ".4.91", ".4.93", ".4.203", ".4.111", ".4.112", *TYPES["MPEG"])]
YBR = [*ADAPTABLE, *_ends(".4.90", ".4.91", ".4.201", ".4.202", ".4.203", ".4.111")]
WRITABLE = _ends("", ".1", ".4.50", ".4.51", ".4.53", ".4.55", ".4.57", ".4.70", ".4.80", ".4.81", ".4.90", ".4.91", ".4.110", ".4.111", ".4.112")
READABLE = [*WRITABLE, *_ends(".2", ".5", ".4.92", ".4.93")]
#: the syntaxes that the XL test names: lossless JPEG 2000 is among them and lossless XL is not
XL_NAMED = _ends(".4.90", ".4.111", ".4.112")


def dimension(spark: SparkSession) -> DataFrame:
    """A row for each registered syntax: uid, type, its properties and classes. Join it where many rows share few syntaxes."""
    rows = []
    for uid, kind in _OF.items():
        classes = (kind == "NATIVE", kind == "MPEG", kind == "JPEG_2000", *(uid in x for x in (XL_NAMED, LOSSY, YBR, READABLE, WRITABLE, ADAPTABLE)))
        rows.append((uid, kind, *PROPERTIES[kind], *classes))
    flags = ", ".join(f"{c} boolean" for c in ("native", "video", "jpeg2000", "jpeg_xl", "lossy", "ybr", "readable", "writable", "adaptable"))
    return spark.createDataFrame(rows, f"uid string, type string, encapsulated boolean, spans_fragments boolean, carries_sign boolean, max_bits int, planar int, {flags}")


def type_of(uid: Column) -> Column:
    out = F.lit("UNKNOWN")
    for kind, ends in TYPES.items():
        out = F.when(uid.isin(_ends(*ends)), kind).otherwise(out)
    return out


def transcode_needed(original: Column, wanted: Column) -> Column:
    """Not the same syntax, and not both native."""
    native = _ends(*TYPES["NATIVE"])
    return (original != wanted) & ~(original.isin(native) & wanted.isin(native))


def suitable(uid: Column, depth: Column, bits_stored: Column) -> Column:
    """The syntax to write instead of the one asked for, if that can't hold the pixels. ``depth`` indexes DEPTHS."""
    lossless_or = lambda most: F.when(depth <= most, F.lit(f"{ROOT}.4.70")).otherwise(EXPLICIT)
    return (
        F.when(uid.isin(IMPLICIT, EXPLICIT), EXPLICIT)
        .when(uid == f"{ROOT}.4.50", F.when(depth <= 1, uid).otherwise(lossless_or(3)))
        .when(uid.isin(_ends(".4.51", ".4.53", ".4.55")), F.when((depth <= 2) & (bits_stored <= 12), uid).otherwise(lossless_or(3)))
        .when(uid.isin(_ends(".4.57", ".4.70", ".4.80", ".4.81", ".4.90", ".4.91", ".4.201", ".4.202", ".4.203")), F.when(depth <= 3, uid).otherwise(EXPLICIT))
        .when(uid == f"{ROOT}.4.110", F.when(depth <= 5, uid).otherwise(EXPLICIT))
        .when(uid.isin(_ends(".4.111", ".4.112")), F.when(depth <= 1, uid).when(depth <= 5, f"{ROOT}.4.110").otherwise(EXPLICIT))
        .otherwise(uid)
    )


def bits_for_twelve(kind: Column, bits_stored: Column) -> Column:
    """Bits stored where a type of 12 bits at most holds 9 to 11."""
    twelve = [k for k, p in PROPERTIES.items() if p[3] == 12]
    return F.when(kind.isin(twelve) & (bits_stored > 8) & (bits_stored < 12), 12).otherwise(bits_stored)


def converts_to_rgb(photometric: Column, uid: Column, header_says_rgb: Column, header_lossless: Column, keep_rgb: bool = False) -> Column:
    """Whether decoded pixels are luma and chroma that have to be turned into colours."""
    by_header = F.lit(False) if keep_rgb else ~header_lossless & ~header_says_rgb
    return (
        F.when(photometric.isin("MONOCHROME1", "MONOCHROME2", "PALETTE COLOR", "PALETTE_COLOR", "YBR_ICT", "YBR_RCT"), False)
        .when(uid.isin(ADAPTABLE), (photometric != "RGB") | by_header)
        .otherwise(photometric.startswith("YBR"))
    )


# fixed values: bits of the decoder's flags
SIGNED, TO_RGB, BIG_ENDIAN, FLOAT, RLE, FORCE_RGB = 1, 2, 4, 8, 16, 32


def decode_flags(uid: Column, signed: Column, fragments: Column, to_rgb: Column, big_endian: Column, floating: Column) -> Column:
    """The decoder's flags as bits. The sign counts only where the type carries one; raw pixels are never converted."""
    kind = type_of(uid)
    unsigned = [k for k, p in PROPERTIES.items() if not p[2]]
    raw = ~fragments | kind.isin("NATIVE", "RLE")
    convert = ~raw & to_rgb
    flag = lambda c, bit: F.when(c, bit).otherwise(0)
    return flag(signed & ~kind.isin(unsigned), SIGNED) + flag(convert, TO_RGB) + flag(convert & (kind == "JPEG_LS"), FORCE_RGB) + flag(big_endian, BIG_ENDIAN) + flag(floating, FLOAT) + flag(kind == "RLE", RLE)


def bits_to_read(bits_stored: Column, bits_allocated: Column) -> Column:
    """Up to 8 bits in a wider cell are read as 9."""
    return F.when((bits_stored <= 8) & (bits_allocated > 8), 9).otherwise(bits_stored)


def encoder_bits(kind: Column, bits: Column, allocated: Column, signed: Column, predictor: Column) -> Column:
    """The depth that an encoder is told."""
    jpeg = F.when(bits <= 8, 8).when(bits <= 12, F.when(signed & (predictor > 1), 16).otherwise(12)).otherwise(16)
    return F.when((kind == "JPEG_LS") & signed, 16).when(kind == "JPEG_2000", bits).when((bits == 8) & (allocated == 16), 12).otherwise(jpeg)


def compression_settings(uid: Column, quality: Column, asked_quality: Column, factor: Column, asked_factor: Column) -> tuple[Column, Column]:
    """(quality, ratio factor): 85 where a quality is used and none is asked for; a factor only if both are positive; lossless XL stays as it is."""
    q = F.when((quality > 0) & (uid != f"{ROOT}.4.110"), F.when(asked_quality <= 0, 85).otherwise(asked_quality)).otherwise(quality)
    return q, F.when((factor > 0) & (asked_factor > 0), asked_factor).otherwise(factor)


# fixed values: names of compression methods
METHODS = {"JPEG_2000": "ISO_15444_1", "JPEG_LS": "ISO_14495_1", "JPEG_XL": "ISO_18181_1"}


def lossy_history(uid: Column, methods: Column, ratios: Column, ratio: Column) -> tuple[Column, Column]:
    """(methods, ratios) after a lossy compression: the method is added, blank ones become ``unknown``; the ratio only if it is positive and finite."""
    kind = type_of(uid)
    method = F.lit("ISO_10918_1")
    for k, name in METHODS.items():
        method = F.when(kind == k, name).otherwise(method)
    lossy = uid.isin(LOSSY)
    known = F.transform(F.concat(F.coalesce(methods, F.array().cast("array<string>")), F.array(method)), lambda m: F.when(F.length(F.trim(F.coalesce(m, F.lit("")))) > 0, m).otherwise("unknown"))
    usable = (ratio > 0) & ~F.isnan(ratio) & (ratio < float("inf"))
    added = F.concat(F.coalesce(ratios, F.array().cast("array<double>")), F.array(ratio))
    return F.when(lossy, known).otherwise(methods), F.when(lossy & usable, added).otherwise(ratios)
