"""File-level functions: rasters and point layers in, rasters and layers out."""

from __future__ import annotations

import math
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions.geometry import LINE, POINT, POLYGON
from talweg.grid import ACC_NODATA, LENGTH_NODATA, NODATA, GridMeta
from talweg.operators import breach as breach_ops
from talweg.operators import direction, network
from talweg.operators import fill as fill_ops
from talweg.plans import flowgraph
from talweg.plans.session import cut
from talweg.sources.geotiff import read_grid, read_layout, write_grid
from talweg.sources.vector import read_points, write_gpkg

Progress = Callable[[str], None]


def _srs(meta: GridMeta) -> int:
    return int(meta.crs.partition(":")[2]) if meta.crs.upper().startswith("EPSG:") else -1


def _tell(progress: Progress | None, text: str) -> None:
    if progress:
        progress(text)


def _points(spark: SparkSession, path: str, meta: GridMeta, layer: str | None, fac_path: str | None, snap_radius: int) -> DataFrame:
    cells = network.drainage_cells(read_points(spark, path, layer), meta)
    if fac_path and snap_radius > 1:
        cells = network.snap_points(cells, read_grid(spark, fac_path, "acc")[0], snap_radius)
    return cut(cells)


def breach(spark: SparkSession, input_path: str, output_path: str, search_radius: int = 200, max_cost: float = math.inf, progress: Progress | None = None) -> None:
    dem, meta = read_grid(spark, input_path)
    _tell(progress, "breaching")
    write_grid(breach_ops.breach(dem, search_radius, max_cost), "z", output_path, meta, "f4", meta.nodata)


def fill(spark: SparkSession, input_path: str, output_path: str | None = None, fill_holes: bool = False, progress: Progress | None = None) -> None:
    """Without an output path the result replaces the input, once it is written whole."""
    lay = read_layout(input_path)
    if lay.meta.nodata is None:
        raise ValueError("the raster must define a nodata value")
    dem, meta = read_grid(spark, input_path)
    _tell(progress, "filling")
    target = output_path or f"{input_path}.new"
    write_grid(fill_ops.fill(dem, meta, fill_holes), "z", target, meta, lay.dtype, meta.nodata)
    if output_path is None:
        Path(target).replace(input_path)


def flow_direction(spark: SparkSession, input_path: str, output_path: str, resolve_flats: bool = True, progress: Progress | None = None) -> None:
    dem, meta = read_grid(spark, input_path)
    _tell(progress, "flow direction")
    write_grid(direction.flow_direction(dem, meta, resolve_flats), "dir", output_path, meta, "u1", NODATA)


def _read_directions(spark: SparkSession, path: str) -> tuple[DataFrame, GridMeta]:
    fdr, meta = read_grid(spark, path, "dir")
    return fdr.withColumn("dir", F.coalesce(F.col("dir").cast("int"), F.lit(NODATA))), meta


def accumulation(spark: SparkSession, input_path: str, output_path: str, progress: Progress | None = None) -> None:
    fdr, meta = _read_directions(spark, input_path)
    _tell(progress, "accumulation")
    write_grid(flowgraph.accumulation(fdr, meta), "acc", output_path, meta, "i8", ACC_NODATA)


def basins(spark: SparkSession, fdr_path: str, points_path: str, output_path: str, all_basins: bool = False, fac_path: str | None = None, snap_radius: int = 0, layer: str | None = None, progress: Progress | None = None) -> None:
    """Writes the labels, and beside them a GeoPackage with the layers ``basins`` and ``drainage_points``."""
    fdr, meta = _read_directions(spark, fdr_path)
    points = _points(spark, points_path, meta, layer, fac_path, snap_radius)
    labels, graph = network.basins(fdr, meta, points, all_basins)
    labels = cut(labels)
    _tell(progress, "basins")
    write_grid(labels, "basin_id", output_path, meta, "i8", 0)
    out = network.update_points(points, labels, graph, meta)
    from talweg.grid import cell_xy

    x, y = cell_xy(meta, F.col("row"), F.col("col"))
    write_gpkg(str(Path(output_path).with_suffix(".gpkg")), {"basins": (network.basin_polygons(labels, graph, meta), POLYGON), "drainage_points": (out.withColumns({"x": x, "y": y}).select("fid", "x", "y", "basin_id", "ds_basin_id"), POINT)}, _srs(meta))


def streams(spark: SparkSession, fac_path: str, fdr_path: str, output_dir: str, threshold: int = 5, progress: Progress | None = None) -> None:
    """Writes streams.tif, and streams.gpkg with the layers ``streams`` and ``junctions``."""
    fdr, meta = _read_directions(spark, fdr_path)
    fac, _ = read_grid(spark, fac_path, "acc")
    _tell(progress, "streams")
    lines, junctions = network.streams(fac, fdr, meta, threshold)
    Path(output_dir).mkdir(parents=True, exist_ok=True)
    write_grid(network.stream_cells(fac, threshold).select("row", "col", F.lit(1).alias("on")), "on", f"{output_dir}/streams.tif", meta, "u1", 0)
    write_gpkg(f"{output_dir}/streams.gpkg", {"streams": (lines.select("coords", "n_cells"), LINE), "junctions": (junctions.select("x", "y"), POINT)}, _srs(meta))


def flow_length(spark: SparkSession, fdr_path: str, points_path: str, output_raster: str, output_vector: str | None = None, fac_path: str | None = None, snap_radius: int = 0, layer: str | None = None, progress: Progress | None = None) -> None:
    fdr, meta = _read_directions(spark, fdr_path)
    fdr = cut(fdr)
    points = _points(spark, points_path, meta, layer, fac_path, snap_radius)
    length = cut(network.flow_length(fdr, meta, points))
    _tell(progress, "flow length")
    write_grid(length, "dist", output_raster, meta, "f4", LENGTH_NODATA)
    if output_vector:
        paths = cut(network.longest_flow_paths(fdr, meta, points, length))
        write_gpkg(output_vector, {"longest_flow_paths": (network.flow_path_lines(fdr, meta, paths), LINE)}, _srs(meta))
