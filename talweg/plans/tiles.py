"""Tiles: groups of neighbouring cells as dense arrays, with a halo.

A grid relation is dealt once by tile; cells near a border go to each tile they are
a halo of.  A kernel sees NumPy arrays and returns columns for the tile's own
cells, so results do not depend on the tile size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.grid import STEPS

#: Cells on a tile's side: about 10 MB for each value column in the worst case.
TILE = 512


class Tile:
    """Dense arrays over the bounding box of a group's cells, one empty cell wider on each side."""

    def __init__(self, table: pa.Table, key: tuple[int, int] | None = None, size: int = TILE, values: Sequence[str] = ()) -> None:
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        self.r0, self.c0 = int(row.min()) - 1, int(col.min()) - 1
        self.shape = (int(row.max()) - self.r0 + 2, int(col.max()) - self.c0 + 2)
        i, j = row - self.r0, col - self.c0
        self.present = np.zeros(self.shape, bool)
        self.present[i, j] = True
        own = np.ones(len(row), bool) if key is None else (row // size == key[0]) & (col // size == key[1])
        self.i, self.j = i[own], j[own]
        self.core = np.zeros(self.shape, bool)
        self.core[self.i, self.j] = True
        self.data: dict[str, np.ndarray] = {}
        for name in values:
            column = table.column(name)
            v = column.to_numpy()
            if v.dtype.kind == "f" or column.null_count:
                v = v.astype(np.float64)  # nulls are NaN
                dense = np.full(self.shape, np.nan)
            elif v.dtype.kind in "bO":
                v, dense = v.astype(bool), np.zeros(self.shape, bool)
            else:
                dense = np.zeros(self.shape, v.dtype)
            dense[i, j] = v
            self.data[name] = dense

    @property
    def rows(self) -> np.ndarray:
        return self.i + self.r0

    @property
    def cols(self) -> np.ndarray:
        return self.j + self.c0

    def own(self, a: np.ndarray) -> np.ndarray:
        """Values of a dense array at the tile's own cells."""
        return a[self.i, self.j]

    def ids(self, ncols: int) -> np.ndarray:
        """Global cell numbers of every place of the arrays."""
        r = np.arange(self.shape[0], dtype=np.int64) + self.r0
        c = np.arange(self.shape[1], dtype=np.int64) + self.c0
        return r[:, None] * ncols + c


def neighbour(a: np.ndarray, d: int, fill) -> np.ndarray:
    """Each cell's neighbour in direction d; ``fill`` beyond the array."""
    dr, dc = STEPS[d]
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = a[max(0, dr) : h + min(0, dr), max(0, dc) : w + min(0, dc)]
    return out


def in_tiles(df: DataFrame, halo: int, size: int = TILE) -> DataFrame:
    """Add __tr, __tc; cells near a border come once for each tile within ``halo``."""
    r, c = F.col("row"), F.col("col")
    own = F.struct(F.floor(r / size).cast("long").alias("r"), F.floor(c / size).cast("long").alias("c"))
    if not halo:
        return df.select("*", own["r"].alias("__tr"), own["c"].alias("__tc"))
    near = F.array_distinct(F.array(*(F.struct(F.floor((r + a) / size).cast("long").alias("r"), F.floor((c + b) / size).cast("long").alias("c")) for a in (0, -halo, halo) for b in (0, -halo, halo))))
    inside = (F.pmod(r, F.lit(size)) >= halo) & (F.pmod(r, F.lit(size)) < size - halo) & (F.pmod(c, F.lit(size)) >= halo) & (F.pmod(c, F.lit(size)) < size - halo)
    return df.withColumn("__t", F.explode(F.when(inside, F.array(own)).otherwise(near))).select("*", F.col("__t.r").alias("__tr"), F.col("__t.c").alias("__tc")).drop("__t")


Kernel = Callable[[Tile], dict[str, np.ndarray] | None]


def tile_map(df: DataFrame, values: Sequence[str], kernel: Kernel, schema: str, halo: int = 0, size: int = TILE) -> DataFrame:
    """Rows that ``kernel`` makes of each tile; the tile's arrays are those of ``values``.

    ``schema`` names the columns of the kernel's result.  A kernel may return None for no rows.
    """
    assert halo <= size

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = Tile(table, (key[0].as_py(), key[1].as_py()), size, values)
        out = kernel(t) if len(t.i) else None
        return as_table(out, schema)

    return in_tiles(df.select("row", "col", *values), halo, size).groupBy("__tr", "__tc").applyInArrow(run, schema)


def tile_join(df: DataFrame, values: Sequence[str], other: DataFrame, kernel: Callable[[Tile, pa.Table], dict[str, np.ndarray] | None], schema: str, halo: int = 0, size: int = TILE, only: DataFrame | None = None) -> DataFrame:
    """Like ``tile_map``, with the rows of ``other`` (which has __tr, __tc) of the same tile.

    ``only`` (__tr, __tc) restricts the tiles.
    """

    def run(key: tuple, table: pa.Table, extra: pa.Table) -> pa.Table:
        if not table.num_rows:
            return as_table(None, schema)
        t = Tile(table, (key[0].as_py(), key[1].as_py()), size, values)
        return as_table(kernel(t, extra) if len(t.i) else None, schema)

    cells = in_tiles(df.select("row", "col", *values), halo, size)
    if only is not None:
        cells = cells.join(only, ["__tr", "__tc"], "left_semi")
    return cells.groupBy("__tr", "__tc").cogroup(other.groupBy("__tr", "__tc")).applyInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "tinyint": pa.int8(), "double": pa.float64(), "boolean": pa.bool_()}


def as_table(out: dict[str, np.ndarray] | None, schema: str) -> pa.Table:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    if out is None:
        out = {n: np.zeros(0) for n, _ in fields}
    cols = []
    for n, t in fields:
        a = np.asarray(out[n])
        # NaN is nodata, which relations hold as null
        cols.append(pa.array(a, _ARROW[t], from_pandas=True) if t == "double" else pa.array(a.astype({"long": "i8", "int": "i4", "tinyint": "i1", "boolean": "?"}[t])))
    return pa.table(cols, names=[n for n, _ in fields])
