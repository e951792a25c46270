"""Unit conversions of a grid's metadata."""

from __future__ import annotations

import math

from talweg.grid import GridMeta

FOOT, SQUARE_MILE = 0.3048, 2589988.11


def metres_per_unit(meta: GridMeta) -> float:
    """Metres of a map unit; for degrees those of a degree of longitude on the web Mercator sphere, at any latitude."""
    return meta.semi_major * math.pi / 180 if meta.is_geographic else meta.linear_unit


def feet_to_cells(feet: float, meta: GridMeta) -> int:
    return int(feet * FOOT / (meta.gt[1] * metres_per_unit(meta)))


def square_miles_to_cells(square_miles: float, meta: GridMeta) -> int:
    u = metres_per_unit(meta)
    return int(square_miles * SQUARE_MILE / ((meta.gt[1] * u) * (-meta.gt[5] * u)))
