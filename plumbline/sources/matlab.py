"""Struct arrays of MATLAB files (level 5): a row an element, scalars as values and vectors as arrays of any length.

The reader goes by the published file format; only what such records hold is read: numbers, text, and a struct array of them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.files import shipped

# The format's number types, and its codes of a matrix, a compressed element, a struct and text.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1"}
MATRIX, PACKED, STRUCT, TEXT = 14, 15, 2, 4


def elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(type, content) of the elements that follow one another; each begins at a multiple of eight bytes."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small element: its size in the upper half, up to four bytes of content in the tag itself
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        content = data[at + 8 : at + 8 + size]
        yield from elements(zlib.decompress(content), order) if kind == PACKED else [(kind, content)]
        at += 8 + size + (-size % 8 if kind != PACKED else 0)


def numbers(kind: int, content: bytes, order: str) -> np.ndarray:
    return np.frombuffer(content, order + NUMBERS[kind])


def value(content: bytes, order: str):
    """(name, value) of a matrix: a list of dicts for a struct array, text, a number for a single one, else a flat array."""
    parts = elements(content, order)
    flags = numbers(*next(parts), order)
    numbers(*next(parts), order)  # the dimensions; arrays are taken flat
    name = next(parts)[1].decode()
    if flags[0] & 0xFF == STRUCT:
        width = int(numbers(*next(parts), order)[0])
        fields = next(parts)[1]
        names = [fields[i : i + width].split(b"\0")[0].decode() for i in range(0, len(fields), width)]
        cells = [value(c, order)[1] if c else None for _, c in parts]
        return name, [dict(zip(names, cells[i : i + len(names)], strict=True)) for i in range(0, len(cells), len(names))]
    kind, body = next(parts, (9, b""))
    if flags[0] & 0xFF == TEXT:
        return name, body.decode("utf-16-le" if kind in (4, 17) else "utf-8")
    flat = numbers(kind, body, order).astype(float)
    return name, float(flat[0]) if len(flat) == 1 else flat


def read_bytes(data: bytes) -> dict:
    """name -> value of the variables of a file."""
    order = "<" if data[126:128] == b"IM" else ">"
    return dict(value(c, order) for kind, c in elements(data[128:], order) if kind == MATRIX)


def struct_array(spark: SparkSession, path: str, name: str, scalars: list[str], channels: list[str]) -> DataFrame:
    """records() of the files below `path`."""
    shipped(spark)
    return records(spark.read.format("binaryFile").load(path).select("content"), name, scalars, channels)


def records(files: DataFrame, name: str, scalars: list[str], channels: list[str]) -> DataFrame:
    """idx (from 1 in its file) and the named fields of a struct array of files (content): scalars as doubles (null where
    missing or not a number), channels as arrays of doubles.  A file is read by one task; a missing field is null."""
    schema = "idx long, " + ", ".join([f"`{c}` double" for c in scalars] + [f"`{c}` array<double>" for c in channels])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for i, record in enumerate(read_bytes(bytes(content)).get(name, []), 1):
                    one = [record.get(c) if isinstance(record.get(c), float) and record[c] == record[c] else None for c in scalars]
                    many = [None if record.get(c) is None else np.atleast_1d(record[c]).tolist() for c in channels]
                    rows.append((i, *one, *many))
                yield pd.DataFrame(rows, columns=["idx", *scalars, *channels])

    return files.select("content").mapInPandas(run, schema)


def _element(kind: int, content: bytes) -> bytes:
    return struct.pack("<II", kind, len(content)) + content + b"\0" * (-len(content) % 8)


def _matrix(name: str, kind: int, size: int, rest: bytes) -> bytes:
    return _element(MATRIX, _element(6, struct.pack("<II", kind, 0)) + _element(5, struct.pack("<ii", size, 1)) + _element(1, name.encode()) + rest)


def file_bytes(name: str, records: list[dict], packed: bool = True) -> bytes:
    """A file with one struct array; values are numbers, arrays of them, or none (an empty array)."""
    names = list(records[0]) if records else []
    fields = _element(5, struct.pack("<i", 32)) + _element(1, b"".join(n.encode().ljust(32, b"\0") for n in names))
    flat = lambda v: np.atleast_1d(np.array([] if v is None else v, "<f8"))
    cells = b"".join(_matrix("", 6, len(flat(r[n])), _element(9, flat(r[n]).tobytes())) for r in records for n in names)
    whole = _matrix(name, STRUCT, len(records), fields + cells)
    body = struct.pack("<II", PACKED, len(z := zlib.compress(whole))) + z if packed else whole
    return b"MATLAB 5.0 MAT-file".ljust(124, b" ") + struct.pack("<H", 0x0100) + b"IM" + body
