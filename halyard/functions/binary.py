"""Headers of encoded images: a short Arrow function, as markers chain through the bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: frame markers without a frame meaning
_NOT_FRAMES = {0xC4, 0xC8, 0xCC}


def _jpeg(data: bytes | None) -> tuple | None:
    """(rows, columns, bits, samples, lossless, rgb) of the first frame header; null if there is none."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at, jfif, adobe = 2, False, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE0 and body[:5] == b"JFIF\0":
            jfif = True
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif (0xC0 <= marker <= 0xCF and marker not in _NOT_FRAMES) or marker == 0xF7:
            if len(body) < 6:
                return None
            names = bytes(body[6::3][: body[5]])
            lossless = marker in (0xC3, 0xC7, 0xCB, 0xCF, 0xF7)
            rgb = body[5] == 3 and (lossless or (not jfif and names == b"RGB") or adobe == 0)
            return int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[0], body[5], lossless, rgb
        elif marker == 0xDA:
            return None
        at += 2 + size
    return None


_JPEG = T.StructType([T.StructField(n, T.IntegerType()) for n in ("n_rows", "n_columns", "bits", "samples")] + [T.StructField(n, T.BooleanType()) for n in ("lossless", "rgb")])


@F.pandas_udf(_JPEG)
def jpeg_header(data: pd.Series) -> pd.DataFrame:
    rows = [_jpeg(bytes(x) if x is not None else None) or (None,) * 6 for x in data]
    out = pd.DataFrame(rows, columns=["n_rows", "n_columns", "bits", "samples", "lossless", "rgb"])
    return out.astype({"n_rows": "Int32", "n_columns": "Int32", "bits": "Int32", "samples": "Int32", "lossless": "boolean", "rgb": "boolean"})
