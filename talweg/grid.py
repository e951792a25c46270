"""The data model: grids as relations of cells, and their metadata.

A grid is a DataFrame with ``row``, ``col`` (long) and one value column.  A cell without
a row lies outside the raster; a null value is nodata.  Both count as the lowest
terrain.  Directions are D8 codes: 0..7 counter-clockwise from east, 8 undefined, 9 nodata.
"""

from __future__ import annotations

import enum
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FlowDirection(enum.IntEnum):
    EAST, NORTH_EAST, NORTH, NORTH_WEST, WEST, SOUTH_WEST, SOUTH, SOUTH_EAST, UNDEFINED, NODATA = range(10)


#: Row and column step of each direction; row 0 is the top.
STEPS = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))
UNDEFINED, NODATA = 8, 9
ACC_NODATA, LENGTH_NODATA = -9999, -1.0


@dataclass(frozen=True)
class GridMeta:
    """Size, affine transform (six numbers), and coordinate system of a grid."""

    nrows: int
    ncols: int
    gt: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    crs: str = ""
    is_geographic: bool = False
    nodata: float | None = None
    linear_unit: float = 1.0  # metres of a map unit
    semi_major: float = 6378137.0
    extra: dict = field(default_factory=dict, compare=False)

    def cell_id(self, row: Column, col: Column) -> Column:
        return row * F.lit(self.ncols) + col


def nodata_to_null(df: DataFrame, value: str, nodata: float | None) -> DataFrame:
    """NaN and the nodata value become null, so no NaN reaches a comparison."""
    v = F.col(value)
    kind = dict(df.dtypes)[value]
    bad = F.isnan(v) if kind in ("float", "double") else F.lit(False)
    if nodata is not None and nodata == nodata:
        bad = bad | (v == F.lit(nodata).cast(kind))
    return df.withColumn(value, F.when(~bad, v))


def step_row(direction: Column) -> Column:
    return F.get(F.array(*(F.lit(r) for r, _ in STEPS)), direction.cast("int")).cast("long")


def step_col(direction: Column) -> Column:
    return F.get(F.array(*(F.lit(c) for _, c in STEPS)), direction.cast("int")).cast("long")


def cell_xy(meta: GridMeta, row: Column, col: Column) -> tuple[Column, Column]:
    """Map coordinates of cell centres."""
    g = meta.gt
    x = F.lit(float(g[0])) + (col + 0.5) * F.lit(float(g[1])) + row * F.lit(float(g[2]))
    y = F.lit(float(g[3])) + col * F.lit(float(g[4])) + (row + 0.5) * F.lit(float(g[5]))
    return x, y


def xy_cell(meta: GridMeta, x: Column, y: Column) -> tuple[Column, Column]:
    """Row and column of a point: inverse transform, cut towards zero."""
    a, b, c, d, e, f = map(float, meta.gt)
    det = b * f - c * e
    if abs(det) < 1e-10:
        raise ValueError("the geotransform cannot be inverted")
    dx, dy = x - F.lit(a), y - F.lit(d)
    col = (dx * F.lit(f) - dy * F.lit(c)) / F.lit(det)
    row = (dy * F.lit(b) - dx * F.lit(e)) / F.lit(det)
    return row.cast("long"), col.cast("long")
