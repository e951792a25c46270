"""Geometries of coordinate columns as well-known text or binary, and back."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT, LINE, POLYGON = 1, 2, 3


def _pairs(coords: Column) -> Column:
    return F.array_join(F.transform(coords, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")


def line_wkt(coords: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), _pairs(coords), F.lit(")"))


def polygon_wkt(coords: Column) -> Column:
    return F.concat(F.lit("POLYGON (("), _pairs(coords), F.lit("))"))


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def encode_wkb(kind: int, xy: list[tuple[float, float]]) -> bytes:
    """Little-endian WKB of a point, a line, or a polygon's outer ring."""
    flat = [v for p in xy for v in p]
    body = struct.pack(f"<{len(flat)}d", *flat)
    if kind == POINT:
        return struct.pack("<BI", 1, POINT) + body
    return struct.pack("<BI", 1, kind) + (struct.pack("<I", 1) if kind == POLYGON else b"") + struct.pack("<I", len(xy)) + body


def decode_wkb(data: bytes) -> tuple[int, list[tuple[float, float]]]:
    """(kind, coordinates) of a point, line or outer ring; z and m values are left out."""
    e = "<" if data[0] == 1 else ">"
    code = struct.unpack_from(e + "I", data, 1)[0]
    at, dims = 5, 2 + ((code & 0x80000000) > 0) + ((code & 0x40000000) > 0)
    if code & 0x20000000:
        at += 4
    code &= 0xFFFF
    dims, kind = (dims + (code // 1000 in (1, 2)) + 2 * (code // 1000 == 3), code % 1000)
    n = 1
    if kind == POLYGON:
        at += 4
    if kind != POINT:
        n, at = struct.unpack_from(e + "I", data, at)[0], at + 4
    v = struct.unpack_from(f"{e}{n * dims}d", data, at)
    return kind, [(v[i], v[i + 1]) for i in range(0, n * dims, dims)]


def wkb(kind: int):
    """A function of a column of array<struct<x, y>> that gives WKB."""

    @F.pandas_udf("binary")
    def to_wkb(coords: pd.Series) -> pd.Series:
        return coords.map(lambda ps: None if ps is None else encode_wkb(kind, [(p["x"], p["y"]) for p in ps]))

    return to_wkb
