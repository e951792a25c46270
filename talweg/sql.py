"""The operators for SQL users: temp views in, temp views out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talweg.grid import GridMeta
from talweg.operators import breach as breach_ops
from talweg.operators import direction, fill, network
from talweg.plans.flowgraph import accumulation


def _streams(meta, fac, fdr, threshold=5):
    lines, junctions = network.streams(fac, fdr, meta, threshold)
    return {"": lines, "_junctions": junctions}


def _basins(meta, fdr, points=None, all_basins=True):
    labels, graph = network.basins(fdr, meta, points, all_basins)
    return {"": labels, "_graph": graph}


#: Operator name -> function of (meta, input tables ..., options ...).
OPERATORS: dict[str, Callable[..., DataFrame | dict[str, DataFrame]]] = {
    "d8": lambda meta, dem: direction.d8(dem),
    "pits": lambda meta, dem: direction.pits(dem),
    "flow_direction": lambda meta, dem, resolve_flats=True: direction.flow_direction(dem, meta, resolve_flats),
    "resolve_flats": lambda meta, dem, fdr: direction.resolve_flats(dem, fdr, meta),
    "fill": lambda meta, dem, fill_holes=False: fill.fill(dem, meta, fill_holes),
    "breach": lambda meta, dem, search_radius=200, max_cost=float("inf"): breach_ops.breach(dem, search_radius, max_cost),
    "breach_single_cell": lambda meta, dem: breach_ops.breach_single_cell(dem),
    "accumulation": lambda meta, fdr: accumulation(fdr, meta),
    "basins": _basins,
    "basin_polygons": lambda meta, labels, graph: network.basin_polygons(labels, graph, meta),
    "flow_length": lambda meta, fdr, points: network.flow_length(fdr, meta, points),
    "longest_flow_paths": lambda meta, fdr, points: network.longest_flow_paths(fdr, meta, points),
    "snap_points": lambda meta, points, fac, radius=0: network.snap_points(points, fac, radius),
    "streams": _streams,
}


def run(spark: SparkSession, operator: str, meta: GridMeta, inputs: dict[str, str], output: str, **options) -> list[str]:
    """Apply an operator to temp views or tables and register what it gives; returns the new views' names.

    ``inputs`` maps the operator's table parameters to view names.  Operators with several results add a
    suffix to ``output``.
    """
    made = OPERATORS[operator](meta, **{k: spark.table(v) for k, v in inputs.items()}, **options)
    made = made if isinstance(made, dict) else {"": made}
    for suffix, df in made.items():
        df.createOrReplaceTempView(output + suffix)
    return [output + s for s in made]
