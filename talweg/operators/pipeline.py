"""Elevations to streams and basins, without files between the stages."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from talweg.grid import GridMeta
from talweg.operators import breach as breach_ops
from talweg.operators import direction, fill, network
from talweg.plans.flowgraph import accumulation
from talweg.plans.session import cut
from talweg.plans.tiles import TILE


def pipeline(dem: DataFrame, meta: GridMeta, search_radius: int = 200, max_cost: float = math.inf, threshold: int = 5, fill_holes: bool = False, basins: bool = False, size: int = TILE) -> dict[str, DataFrame]:
    """breached, filled, fdr, fac, streams, junctions and, if asked, basins, basin_graph and points.

    What several stages read is checkpointed; the rest is lazy.  Radius and threshold count cells;
    a radius of 0 leaves breaching out.  Basins are those of the junctions.
    """
    out: dict[str, DataFrame] = {}
    if search_radius > 0:
        dem = out["breached"] = cut(breach_ops.breach(dem, search_radius, max_cost, size))
    out["filled"] = cut(fill.fill(dem, meta, fill_holes, size))
    out["fdr"] = cut(direction.flow_direction(out["filled"], meta, True, size))
    out["fac"] = cut(accumulation(out["fdr"], meta, size))
    out["streams"], out["junctions"] = network.streams(out["fac"], out["fdr"], meta, threshold, size)
    if basins:
        from pyspark.sql import functions as F

        points = network.last_wins(out["junctions"].select((F.col("row") * meta.ncols + F.col("col") + 1).alias("fid"), "row", "col"))
        out["basins"], out["basin_graph"] = network.basins(out["fdr"], meta, points, True, size)
        out["points"] = network.update_points(points, out["basins"], out["basin_graph"], meta)
    return out
