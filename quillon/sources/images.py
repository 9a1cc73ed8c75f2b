"""Sizes of images from their headers (S15): no pixel is decoded."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of a JPEG file that begin a frame, and those that stand alone.
FRAMES = frozenset({*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC})
ALONE = frozenset({0x01, *range(0xD0, 0xD9)})


def _jpeg(b: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(b) and b[at] == 0xFF:
        mark = b[at + 1]
        if mark == 0xFF or mark in ALONE:  # fill bytes, and markers without a length
            at += 1 if mark == 0xFF else 2
            continue
        if mark in FRAMES:
            height, width = struct.unpack(">HH", b[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    return None


def _tiff(b: bytes) -> tuple[int, int] | None:
    order = "<" if b[:2] == b"II" else ">"
    (at,) = struct.unpack(order + "I", b[4:8])
    (n,) = struct.unpack(order + "H", b[at : at + 2])
    found = {}
    for k in range(n):
        tag, kind, _ = struct.unpack(order + "HHI", b[at + 2 + 12 * k : at + 10 + 12 * k])
        if tag in (256, 257):  # width and height, of 16 or 32 bits
            place = at + 10 + 12 * k
            (found[tag],) = struct.unpack(order + ("H" if kind == 3 else "I"), b[place : place + (2 if kind == 3 else 4)])
    return (found[256], found[257]) if len(found) == 2 else None


def dimensions(b: bytes | None) -> tuple[int, int] | None:
    """Width and height that a header tells; None where it is cut short or of another kind."""
    b = b or b""
    try:
        if b.startswith(b"\x89PNG\r\n\x1a\n"):
            return struct.unpack(">II", b[16:24])
        if b.startswith(b"BM"):
            width, height = struct.unpack("<ii", b[18:26])
            return width, abs(height)  # rows from the top down have a negative height
        if b.startswith(b"\xff\xd8\xff"):
            return _jpeg(b)
        if b[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(b)
    except struct.error:
        pass
    return None


def size(content: Column) -> Column:
    """A struct (width, height), null where dimensions() is."""

    @F.pandas_udf("width long, height long")
    def read(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dimensions(b) or (None, None) for b in column], columns=["width", "height"]).astype("Int64")

    return read(content)
