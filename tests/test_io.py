"""Rasters, vector layers, units, SQL and the command line."""

import numpy as np
import pytest

from grids import dense, grid
from talweg import cli, sql
from talweg.functions import units
from talweg.functions.geometry import LINE, POINT, POLYGON, decode_wkb, encode_wkb, line_wkt, wkb
from talweg.grid import GridMeta
from talweg.sources import geotiff, vector
from talweg.streaming.arrivals import each_grid

META = GridMeta(40, 33, (100.0, 10.0, 0.0, 500.0, 0.0, -10.0), "EPSG:32610", False, -9999.0)


@pytest.mark.parametrize("dtype", ["f4", "f8", "i4", "i8"])
def test_raster_round_trip(spark, tmp_path, dtype):
    z = np.random.default_rng(1).integers(0, 100, (40, 33)).astype(float)
    z[3, 4] = np.nan
    dem = grid(spark, [[-9999 if np.isnan(v) else v for v in line] for line in z.tolist()], "z", "double", -9999)
    path = str(tmp_path / "a.tif")
    geotiff.write_grid(dem, "z", path, META, dtype, -9999, side=16)
    got, meta = geotiff.read_grid(spark, path)
    assert meta == META
    np.testing.assert_array_equal(dense(got, "z", z.shape), z)
    assert got.filter("row = 7 AND col < 5").count() == 5


def test_raster_blocks_are_pruned(spark, tmp_path):
    path = str(tmp_path / "a.tif")
    geotiff.write_grid(grid(spark, [[1.0] * 33] * 40, "z", "double"), "z", path, META, "f4", -9999, side=16)
    reader = geotiff._Reader(path)
    from pyspark.sql.datasource import LessThan

    list(reader.pushFilters([LessThan(("row",), 16)]))
    assert sum(len(p.blocks) for p in reader.partitions()) < len(reader.lay.at)


def test_geopackage_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    points = spark.createDataFrame([(3, 1.5, 2.5, "a"), (9, -1.0, 0.0, None)], "fid long, x double, y double, name string")
    line = spark.createDataFrame([([{"x": 0.0, "y": 1.0}, {"x": 2.0, "y": 3.0}], 7)], "coords array<struct<x: double, y: double>>, n long")
    vector.write_gpkg(path, {"points": (points, POINT), "lines": (line, LINE)}, 4326)
    assert vector.layers(path) == ["points", "lines"]
    assert sorted(vector.read_points(spark, path, "points").collect()) == [(3, 1.5, 2.5), (9, -1.0, 0.0)]


def test_wkb(spark):
    for kind, xy in ((POINT, [(1.0, 2.0)]), (LINE, [(0.0, 1.0), (2.0, 3.0)]), (POLYGON, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)])):
        assert decode_wkb(encode_wkb(kind, xy)) == (kind, xy)
    df = spark.createDataFrame([([{"x": 0.5, "y": 1.0}, {"x": 2.0, "y": 3.0}],)], "c array<struct<x: double, y: double>>")
    text, data = df.select(line_wkt(df.c), wkb(LINE)(df.c)).first()
    assert text == "LINESTRING (0.5 1.0, 2.0 3.0)" and decode_wkb(bytes(data))[1] == [(0.5, 1.0), (2.0, 3.0)]


def test_units():
    assert units.feet_to_cells(200, META) == 6
    assert units.square_miles_to_cells(1, META) == 25899
    assert abs(units.metres_per_unit(GridMeta(1, 1, is_geographic=True)) - 111319.49079327357) < 1e-6


def test_sql_views(spark):
    grid(spark, [[3, 2, 1], [3, 2, 1]], "z", "double").createOrReplaceTempView("dem")
    meta = GridMeta(2, 3)
    assert sql.run(spark, "flow_direction", meta, {"dem": "dem"}, "fdr") == ["fdr"]
    sql.run(spark, "accumulation", meta, {"fdr": "fdr"}, "fac")
    assert spark.sql("SELECT sum(acc) AS s FROM fac").first().s >= 6
    assert sql.run(spark, "basins", meta, {"fdr": "fdr"}, "b") == ["b", "b_graph"]


def test_command_line_pipeline(spark, tmp_path):
    z = np.add.outer(np.arange(40) * 3, np.abs(np.arange(33) - 16)).astype(float)
    dem = str(tmp_path / "dem.tif")
    geotiff.write_grid(grid(spark, z.tolist(), "z", "double"), "z", dem, META, "f4", -9999)
    out = tmp_path / "out"
    cli.main(["pipeline", "--dem_file", dem, "--output_dir", str(out), "--search_radius_ft", "100", "--da_sqmi", "0.002", "--basins"])
    assert {p.name for p in out.iterdir()} >= {"dem_breached.tif", "dem_filled.tif", "fdr.tif", "accum.tif", "streams.tif", "streams.gpkg", "basins.tif", "basins.gpkg"}
    assert vector.layers(str(out / "streams.gpkg")) == ["streams", "junctions"]
    cli.main(["flow-length", "--fdr_file", str(out / "fdr.tif"), "--dp_file", str(out / "streams.gpkg"), "--dp_layer", "junctions", "--output_raster", str(out / "len.tif"), "--output_vector", str(out / "len.gpkg")])
    assert vector.layers(str(out / "len.gpkg")) == ["longest_flow_paths"]


def test_streamed_grids(spark, tmp_path):
    from talweg.operators.direction import d8

    a = grid(spark, [[2, 1], [2, 1]], "z", "double").selectExpr("1 AS grid_id", "*")
    a.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
    each_grid(stream, d8, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
