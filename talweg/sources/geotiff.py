"""GeoTIFF rasters as cell relations.

``spark.read.format("geotiff").load(path)`` reads band 1, one task for some blocks (strips or tiles)
of the file; blocks are skipped that filters on row and col exclude.  Writing
encodes tiles on the executors; the file itself is one stream, so tiles
pass the driver one at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from talweg.grid import GridMeta, nodata_to_null
from talweg.plans.tiles import TILE, Tile, in_tiles

#: Tag numbers of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, FORMAT, SCALE, TIE, MATRIX, GEO_KEYS, NODATA_TEXT = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
RAW, DEFLATE, OLD_DEFLATE, ZSTD = 1, 8, 32946, 50000
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_SPARK = {"u1": "smallint", "u2": "int", "u4": "long", "u8": "decimal(20,0)", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "long", "f4": "float", "f8": "double"}
BLOCKS_PER_TASK = 64


def _open(path: str):
    fs, p = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs.open_input_file(p)


@dataclass
class Layout:
    meta: GridMeta
    dtype: str
    order: str
    block: tuple[int, int]
    across: int
    at: list[int]
    size: list[int]
    compression: int
    predictor: int


def read_layout(path: str) -> Layout:
    """Header of the first image in a classic or big TIFF file."""
    with _open(path) as f:
        head = f.read(16)
        e = "<" if head[:2] == b"II" else ">"
        big = struct.unpack_from(e + "H", head, 2)[0] == 43
        first = struct.unpack_from(e + ("Q" if big else "I"), head, 8 if big else 4)[0]
        f.seek(first)
        n = struct.unpack(e + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        entries, step = f.read(n * (20 if big else 12)), 20 if big else 12
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind = struct.unpack_from(e + "HH", entries, k * step)
            count = struct.unpack_from(e + ("Q" if big else "I"), entries, k * step + 4)[0]
            if kind not in _TYPES:
                continue
            code = f"{e}{count}s" if kind == 2 else e + _TYPES[kind] * count
            room = 8 if big else 4
            where = k * step + (12 if big else 8)
            if struct.calcsize(code) <= room:
                data = entries[where : where + room]
            else:
                f.seek(struct.unpack_from(e + ("Q" if big else "I"), entries, where)[0])
                data = f.read(struct.calcsize(code))
            tags[tag] = struct.unpack_from(code, data)
    one = lambda t, d=None: tags[t][0] if t in tags else d
    w, h = one(WIDTH), one(HEIGHT)
    kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)] + str(one(BITS, 8) // 8)
    if one(SAMPLES, 1) != 1:
        raise ValueError("only single-band rasters are read")
    if TILE_AT in tags:
        block, at, size = (one(TILE_HEIGHT), one(TILE_WIDTH)), tags[TILE_AT], tags[TILE_BYTES]
    else:
        block, at, size = (min(one(ROWS_PER_STRIP, h), h), w), tags[STRIP_AT], tags[STRIP_BYTES]
    gt = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    if MATRIX in tags:
        m = tags[MATRIX]
        gt = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif SCALE in tags and TIE in tags:
        sx, sy = tags[SCALE][:2]
        i, j, _, x, y = tags[TIE][:5]
        gt = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    keys = tags.get(GEO_KEYS, ())
    geo = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4) if keys[k + 1] == 0}
    crs = f"EPSG:{geo[3072]}" if 3072 in geo else f"EPSG:{geo[2048]}" if 2048 in geo else ""
    text = one(NODATA_TEXT)
    nodata = float(text.rstrip(b"\0 ").decode()) if text else None
    unit = {9001: 1.0, 9002: 0.3048, 9003: 1200 / 3937}.get(geo.get(3076), 1.0)
    meta = GridMeta(h, w, tuple(map(float, gt)), crs, geo.get(1024) == 2, nodata, unit)
    return Layout(meta, kind, e, block, -(-w // block[1]), list(at), list(size), one(COMPRESSION, 1), one(PREDICTOR, 1))


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == RAW:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == ZSTD:
        return pa.Codec("zstd").decompress(data, size, asbytes=True)
    raise ValueError(f"compression {compression} is not read")


def read_block(f, lay: Layout, k: int) -> np.ndarray:
    bh, bw = lay.block
    dt = np.dtype(lay.order + lay.dtype)
    rows = bh if TILE_HEIGHT and bw != lay.meta.ncols else min(bh, lay.meta.nrows - (k // lay.across) * bh)
    if not lay.size[k]:
        return np.full((rows, bw), lay.meta.nodata if lay.meta.nodata is not None else 0, dt)
    f.seek(lay.at[k])
    raw = _unpack(f.read(lay.size[k]), lay.compression, rows * bw * dt.itemsize)
    rows = len(raw) // (bw * dt.itemsize)
    if lay.predictor == 3:
        a = np.frombuffer(raw, np.uint8).reshape(rows, bw * dt.itemsize)
        a = np.cumsum(a, axis=1, dtype=np.uint8).reshape(rows, dt.itemsize, bw)
        return np.ascontiguousarray(a.transpose(0, 2, 1)).view(np.dtype(">" + lay.dtype)).reshape(rows, bw)
    a = np.frombuffer(raw, dt).reshape(rows, bw)
    return np.cumsum(a, axis=1, dtype=dt) if lay.predictor == 2 else a


class _Blocks(InputPartition):
    def __init__(self, first: list[int]) -> None:
        self.blocks = first


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.lay = path, read_layout(path)
        self.bounds = {"row": [0, self.lay.meta.nrows - 1], "col": [0, self.lay.meta.ncols - 1]}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of row and col with numbers choose blocks; Spark still checks every row."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in self.bounds and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                b = self.bounds[name]
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    b[0] = max(b[0], f.value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    b[1] = min(b[1], f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        (bh, bw), keep = self.lay.block, []
        for k in range(len(self.lay.at)):
            r, c = k // self.lay.across * bh, k % self.lay.across * bw
            if r <= self.bounds["row"][1] and r + bh > self.bounds["row"][0] and c <= self.bounds["col"][1] and c + bw > self.bounds["col"][0]:
                keep.append(k)
        return [_Blocks(keep[i : i + BLOCKS_PER_TASK]) for i in range(0, len(keep), BLOCKS_PER_TASK)] or [_Blocks([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        lay = self.lay
        with _open(self.path) as f:
            for k in partition.blocks:
                r0, c0 = k // lay.across * lay.block[0], k % lay.across * lay.block[1]
                a = read_block(f, lay, k)[: lay.meta.nrows - r0, : lay.meta.ncols - c0]
                row, col = np.indices(a.shape)
                kind = {"u1": "i2", "u2": "i4", "u4": "i8"}.get(lay.dtype, lay.dtype)
                yield pa.RecordBatch.from_arrays([pa.array((row + r0).ravel().astype("i8")), pa.array((col + c0).ravel().astype("i8")), pa.array(a.ravel().astype(kind))], names=["row", "col", "value"])


class GeoTiff(DataSource):
    """Band 1 of a GeoTIFF as (row, col, value)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return f"row long, col long, value {_SPARK[read_layout(self.options['path']).dtype]}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)


def read_grid(spark: SparkSession, path: str, value: str = "z") -> tuple[DataFrame, GridMeta]:
    """A raster's cells, nodata as null, and its metadata."""
    register(spark)
    meta = read_layout(path).meta
    df = spark.read.format("geotiff").load(path).withColumnRenamed("value", value)
    return nodata_to_null(df, value, meta.nodata), meta


def _tags(meta: GridMeta, dtype: str, side: int, at: list[int], size: list[int], nodata: float | None) -> list[tuple[int, int, tuple]]:
    g = meta.gt
    kind = {"u": 1, "i": 2, "f": 3}[dtype[0]]
    code = int(meta.crs.partition(":")[2]) if meta.crs.upper().startswith("EPSG:") else None
    keys = (1, 1, 0, 2 + (code is not None), 1024, 0, 1, 2 if meta.is_geographic else 1, 1025, 0, 1, 1)
    if code is not None:
        keys += (2048 if meta.is_geographic else 3072, 0, 1, code)
    tags = [(WIDTH, 4, (meta.ncols,)), (HEIGHT, 4, (meta.nrows,)), (BITS, 3, (int(dtype[1]) * 8,)), (COMPRESSION, 3, (ZSTD,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (1,)), (TILE_WIDTH, 4, (side,)), (TILE_HEIGHT, 4, (side,)),
            (TILE_AT, 16, tuple(at)), (TILE_BYTES, 16, tuple(size)), (FORMAT, 3, (kind,)), (MATRIX, 12, (g[1], g[2], 0.0, g[0], g[4], g[5], 0.0, g[3], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)), (GEO_KEYS, 3, keys)]
    if nodata is not None:
        tags.append((NODATA_TEXT, 2, (f"{nodata:g}".encode() + b"\0",)))
    return tags


def write_grid(df: DataFrame, value: str, path: str, meta: GridMeta, dtype: str = "f4", nodata: float | None = None, side: int = 256) -> None:
    """A tiled, zstd-compressed BigTIFF of (row, col, value); nulls and missing cells become nodata."""
    fill = 0 if nodata is None else nodata

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        tr, tc = key[0].as_py(), key[1].as_py()
        t = Tile(table, (tr, tc), side, [value])
        a = np.full((side, side), fill, "<" + dtype)
        v = t.own(t.data[value])
        a[t.rows - tr * side, t.cols - tc * side] = np.where(np.isnan(v), fill, v) if v.dtype.kind == "f" else v
        return pa.table({"tr": [tr], "tc": [tc], "data": [pa.Codec("zstd").compress(a.tobytes(), asbytes=True)]})

    tiles = in_tiles(df.select("row", "col", value), 0, side).groupBy("__tr", "__tc").applyInArrow(pack, "tr long, tc long, data binary").orderBy("tr", "tc")
    across, down = -(-meta.ncols // side), -(-meta.nrows // side)
    at, size = [0] * (across * down), [0] * (across * down)
    fs, p = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    blank = pa.Codec("zstd").compress(np.full((side, side), fill, "<" + dtype).tobytes(), asbytes=True)
    # the directory stands first, as object stores cannot rewrite; its size is known, its numbers follow from the tiles' sizes
    parts = [(r["tr"] * across + r["tc"], len(r["data"])) for r in tiles.select("tr", "tc", "data").toLocalIterator()]
    for k, n in parts:
        size[k] = n
    missing = [k for k in range(len(size)) if not size[k]]
    for k in missing:
        size[k] = len(blank)
    head = _directory(_tags(meta, dtype, side, at, size, nodata))
    where = len(head)
    for k in range(len(size)):
        at[k], where = where, where + size[k]
    with fs.open_output_stream(p) as out:
        out.write(_directory(_tags(meta, dtype, side, at, size, nodata)))
        have = tiles.toLocalIterator()
        nxt = next(have, None)
        for k in range(len(size)):
            if nxt is not None and nxt["tr"] * across + nxt["tc"] == k:
                out.write(bytes(nxt["data"]))
                nxt = next(have, None)
            else:
                out.write(blank)


def _directory(tags: list[tuple[int, int, tuple]]) -> bytes:
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16)
    n = len(tags)
    rest_at, rest, rows = 16 + 8 + 20 * n + 8, b"", b""
    for tag, kind, values in tags:
        data, count = (values[0], len(values[0])) if kind == 2 else (struct.pack("<" + _TYPES[kind] * len(values), *values), len(values))
        if len(data) <= 8:
            rows += struct.pack("<HHQ", tag, kind, count) + data.ljust(8, b"\0")
        else:
            rows += struct.pack("<HHQQ", tag, kind, count, rest_at + len(rest))
            rest += data + b"\0" * (-len(data) % 8)
    return head + struct.pack("<Q", n) + rows + struct.pack("<Q", 0) + rest
