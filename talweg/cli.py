"""Command line: one verb for each operator, and the whole pipeline."""

from __future__ import annotations

import argparse
import math
from pathlib import Path

from pyspark.sql import SparkSession

from talweg import api
from talweg.functions.units import feet_to_cells, square_miles_to_cells
from talweg.sources.geotiff import read_layout


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("talweg", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *files: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for f in files:
            v.add_argument(f"--{f}", required=True)
        return v

    v = verb("breach", "input_file", "output_file")
    v.add_argument("--search_radius_ft", type=float, default=200)
    v.add_argument("--max_cost", type=float, default=math.inf)
    v = verb("fill", "input_file")
    v.add_argument("--output_file")
    v.add_argument("--fill_holes", action="store_true")
    v = verb("flow-direction", "input_file", "output_file")
    v.add_argument("--no_flats", action="store_true")
    verb("accumulation", "input_file", "output_file")
    v = verb("basins", "fdr_file", "dp_file", "output_file")
    v.add_argument("--all_basins", action="store_true")
    for v in (v, verb("flow-length", "fdr_file", "dp_file", "output_raster")):
        v.add_argument("--fac_file")
        v.add_argument("--snap_radius_ft", type=float, default=0)
        v.add_argument("--dp_layer")
    v.add_argument("--output_vector")
    v = verb("streams", "fac_file", "fdr_file", "output_dir")
    v.add_argument("--threshold", type=int, default=5)
    v = verb("pipeline", "dem_file", "output_dir")
    v.add_argument("--search_radius_ft", type=float, default=200)
    v.add_argument("--max_cost", type=float, default=math.inf)
    v.add_argument("--da_sqmi", type=float, default=1)
    v.add_argument("--basins", action="store_true")
    v.add_argument("--fill_holes", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("talweg").getOrCreate()
    cells = lambda feet, path: feet_to_cells(feet, read_layout(path).meta)
    if a.verb == "breach":
        api.breach(spark, a.input_file, a.output_file, cells(a.search_radius_ft, a.input_file), a.max_cost, print)
    elif a.verb == "fill":
        api.fill(spark, a.input_file, a.output_file, a.fill_holes, print)
    elif a.verb == "flow-direction":
        api.flow_direction(spark, a.input_file, a.output_file, not a.no_flats, print)
    elif a.verb == "accumulation":
        api.accumulation(spark, a.input_file, a.output_file, print)
    elif a.verb == "basins":
        api.basins(spark, a.fdr_file, a.dp_file, a.output_file, a.all_basins, a.fac_file, cells(a.snap_radius_ft, a.fdr_file), a.dp_layer, print)
    elif a.verb == "flow-length":
        api.flow_length(spark, a.fdr_file, a.dp_file, a.output_raster, a.output_vector, a.fac_file, cells(a.snap_radius_ft, a.fdr_file), a.dp_layer, print)
    elif a.verb == "streams":
        api.streams(spark, a.fac_file, a.fdr_file, a.output_dir, a.threshold, print)
    else:
        run_pipeline(spark, a)


def run_pipeline(spark: SparkSession, a: argparse.Namespace) -> None:
    """dem_breached.tif, dem_filled.tif, fdr.tif, accum.tif, the streams and, if asked, basins of the junctions."""
    out, meta, source = Path(a.output_dir), read_layout(a.dem_file).meta, a.dem_file
    out.mkdir(parents=True, exist_ok=True)
    name = lambda f: str(out / f)
    if (radius := feet_to_cells(a.search_radius_ft, meta)) > 0:
        api.breach(spark, source, name("dem_breached.tif"), radius, a.max_cost, print)
        source = name("dem_breached.tif")
    api.fill(spark, source, name("dem_filled.tif"), a.fill_holes, print)
    api.flow_direction(spark, name("dem_filled.tif"), name("fdr.tif"), True, print)
    api.accumulation(spark, name("fdr.tif"), name("accum.tif"), print)
    api.streams(spark, name("accum.tif"), name("fdr.tif"), str(out), square_miles_to_cells(a.da_sqmi, meta), print)
    if a.basins:
        api.basins(spark, name("fdr.tif"), name("streams.gpkg"), name("basins.tif"), True, layer="junctions", progress=print)


if __name__ == "__main__":
    main()
