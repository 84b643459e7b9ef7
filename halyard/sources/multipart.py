"""Multipart bodies as rows: one row per part, with its headers parsed by SQL functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boundary(content_type: Column, kind: str = "multipart/related") -> Column:
    """The boundary parameter of a content type of the given kind, without its quotes."""
    quoted = F.regexp_extract(content_type, r'(?i);\s*boundary="([^"]+)"', 1)
    plain = F.regexp_extract(content_type, r"(?i);\s*boundary=([^\s;\"]+)", 1)
    found = F.when(F.length(quoted) > 0, quoted).when(F.length(plain) > 0, plain)
    return F.when(F.lower(F.trim(F.split(content_type, ";")[0])) == kind, found)


def header_map(block: Column) -> Column:
    """Header lines as a map of lower-case names: folded lines joined, repeated names joined by a comma."""
    unfolded = F.regexp_replace(block, r"\r?\n[ \t]+", " ")
    lines = F.filter(F.split(unfolded, r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]), ",")))


def field_parameters(value: Column) -> Column:
    """Parameters of a header field as a map: outer quotes stripped, a flag without = has a null value. Semicolons inside quotes don't split."""
    parts = F.transform(F.split(value, r';(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.trim(x))
    pairs = F.transform(
        F.filter(parts, lambda x: F.length(x) > 0),
        lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.when(F.instr(x, "=") > 0, F.regexp_replace(F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))), '^"(.*)"$', "$1")).alias("v")),
    )
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), 1)["v"]))


def parts(df: DataFrame, id_col: str, body: str, mark: str) -> DataFrame:
    """(id, part, headers, content) of each body; what stands before the first boundary and after the last is left out."""
    src = df.select(F.col(id_col).alias("id"), F.col(body).cast("binary").alias("body"), F.col(mark).alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, heads, contents = [], [], [], []
            for i, (data, name) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if data is None or name is None:
                    continue
                pieces = (b"\r\n" + data).split(b"\r\n--" + name.encode())
                for k, piece in enumerate(pieces[1:]):
                    if piece.startswith(b"--"):
                        break
                    piece = piece.removeprefix(b"\r\n")
                    head, content = (b"", piece[2:]) if piece.startswith(b"\r\n") else piece.partition(b"\r\n\r\n")[::2]
                    owner.append(i)
                    number.append(k)
                    heads.append(head.decode("utf-8", "replace"))
                    contents.append(content)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(heads, pa.string()), pa.array(contents, pa.binary())], names=["id", "part", "head", "content"]
            )

    rows = src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, part int, head string, content binary")
    return rows.select(F.col("id").alias(id_col), "part", header_map(F.col("head")).alias("headers"), "content")


def assemble(content_type: Column, content: Column, mark: str) -> Column:
    """One part of a multipart body, its boundary line first."""
    return F.concat(F.concat(F.lit(f"\r\n--{mark}\r\nContent-Type: "), content_type, F.lit("\r\n\r\n")).cast("binary"), content)
