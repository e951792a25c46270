"""The terrain operators applied to grids made of the ``events`` table, with equivalent DuckDB SQL.

An event is a cell: its number gives row and column of a square grid, its value the
elevation.  Elevations are whole numbers, so both engines round alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.grid import NODATA, UNDEFINED, GridMeta
from talweg.operators import breach as breach_ops
from talweg.operators import direction, fill, network
from talweg.operators.pipeline import pipeline
from talweg.plans.flowgraph import accumulation
from talweg.plans.session import cut

THRESHOLD = 60
SNAP_RADIUS = 3
#: Tiles of these small grids; the operators' own default suits large rasters.
SIZE = 64


def terrain(spark: SparkSession, sf_dir: str, kind: str, holes: bool = False) -> tuple[DataFrame, GridMeta]:
    """(row, col, z) and its metadata: ``rough``, ``slope`` or ``valley``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    n = events.count()
    w = math.isqrt(max(n - 1, 0)) + 1
    i = F.col("event_id")
    row, col = F.floor(i / w).cast("long"), (i % w).cast("long")
    z = {
        "rough": F.floor("value"),
        "slope": F.floor(F.col("value") / 8) + row + F.abs(col - F.floor(F.lit(w) / 2)),
        "valley": F.floor(F.col("value") / 64) + 4 * row + 2 * F.abs(col - F.floor(F.lit(w) / 2)),
    }[kind].cast("double")
    if holes:
        z = F.when(i % 97 != 0, z)
    return events.select(row.alias("row"), col.alias("col"), z.alias("z")), GridMeta(-(-n // w), w, (0.0, 10.0, 0.0, 0.0, 0.0, -10.0))


def points(spark: SparkSession, sf_dir: str, meta: GridMeta, table: str = "supplier") -> DataFrame:
    """(fid, row, col): suppliers have cells of their own, customers share them."""
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    key, place = ("s_suppkey", lambda k: (k * 7919) % n) if table == "supplier" else ("c_custkey", lambda k: (k * 37) % max(1, n // 10))
    p = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias("fid"))
    at = place(F.col("fid"))
    return network.last_wins(p.select("fid", F.floor(at / meta.ncols).cast("long").alias("row"), (at % meta.ncols).cast("long").alias("col")))


def _direction(df: DataFrame) -> DataFrame:
    return df.select("row", "col", F.col("dir").cast("int").alias("dir"))


def d8_direction(spark, sf_dir):
    return _direction(direction.d8(terrain(spark, sf_dir, "slope", True)[0], SIZE))


def direction_histogram(spark, sf_dir):
    return d8_direction(spark, sf_dir).groupBy("dir").agg(F.count("*").alias("cells"))


def pits(spark, sf_dir):
    return direction.pits(terrain(spark, sf_dir, "slope", True)[0], SIZE)


def flat_edges(spark, sf_dir):
    dem, meta = terrain(spark, sf_dir, "slope", True)
    f = direction.flat_cells(dem, cut(direction.d8(dem, SIZE)), meta, SIZE)
    return f.select("row", "col", F.col("high").cast("int").alias("high"), (F.col("low") > 0).cast("int").alias("low"))


def _filled(spark, sf_dir, holes=False):
    dem, meta = terrain(spark, sf_dir, "slope", holes)
    return cut(fill.fill(dem, meta, size=SIZE)), meta


def fill_depressions(spark, sf_dir):
    dem, meta = terrain(spark, sf_dir, "rough", True)
    return fill.fill(dem, meta, size=SIZE)


def fill_holes(spark, sf_dir):
    dem, meta = terrain(spark, sf_dir, "rough", True)
    return fill.fill(dem, meta, fill_holes=True, size=SIZE)


def fill_depth_stats(spark, sf_dir):
    dem, meta = terrain(spark, sf_dir, "slope")
    both = fill.fill(dem, meta, size=SIZE).join(dem.select("row", "col", F.col("z").alias("z0")), ["row", "col"])
    return both.agg(F.count(F.when(F.col("z") > F.col("z0"), 1)).alias("raised"), F.sum(F.col("z") - F.col("z0")).alias("volume"), F.max(F.col("z") - F.col("z0")).alias("deepest"))


def flat_mask(spark, sf_dir):
    dem, meta = _filled(spark, sf_dir)
    return direction.flat_mask(dem, cut(direction.d8(dem, SIZE)), meta, SIZE)


def flow_direction_resolved(spark, sf_dir):
    dem, meta = _filled(spark, sf_dir)
    return _direction(direction.flow_direction(dem, meta, size=SIZE))


def _valley(spark, sf_dir, holes=False):
    dem, meta = terrain(spark, sf_dir, "valley", holes)
    return cut(direction.d8(dem, SIZE)), meta


def flow_accumulation(spark, sf_dir):
    return accumulation(*_valley(spark, sf_dir), SIZE)


def flow_accumulation_holes(spark, sf_dir):
    return accumulation(*_valley(spark, sf_dir, True), SIZE)


def basins_all(spark, sf_dir):
    return network.basins(*_valley(spark, sf_dir, True), size=SIZE)[0]


def basins_dp(spark, sf_dir):
    fdr, meta = _valley(spark, sf_dir, True)
    return network.basins(fdr, meta, points(spark, sf_dir, meta), all_basins=False, size=SIZE)[0]


def basin_graph(spark, sf_dir):
    fdr, meta = _valley(spark, sf_dir)
    return network.basins(fdr, meta, points(spark, sf_dir, meta), size=SIZE)[1]


def basin_points(spark, sf_dir):
    fdr, meta = _valley(spark, sf_dir, True)
    dp = points(spark, sf_dir, meta, "customer")
    labels, graph = network.basins(fdr, meta, dp, size=SIZE)
    return network.update_points(dp, labels, graph, meta).select("fid", "row", "col", "basin_id", "ds_basin_id")


def basin_boundary(spark, sf_dir):
    fdr, meta = _valley(spark, sf_dir, True)
    return network.basin_boundary(cut(network.basins(fdr, meta, points(spark, sf_dir, meta), size=SIZE)[0]), SIZE)


def basin_polygon_sides(spark, sf_dir):
    fdr, meta = _valley(spark, sf_dir)
    labels, graph = network.basins(fdr, meta, points(spark, sf_dir, meta), size=SIZE)
    return network.basin_polygon_edges(cut(labels), graph, size=SIZE).groupBy("BasinID").agg(F.count("*").alias("sides"))


def basin_polygons(spark, sf_dir):
    fdr, meta = _valley(spark, sf_dir)
    labels, graph = network.basins(fdr, meta, points(spark, sf_dir, meta), size=SIZE)
    return network.basin_polygons(cut(labels), graph, meta, size=SIZE)


def flow_length(spark, sf_dir):
    fdr, meta = _valley(spark, sf_dir)
    return network.flow_length(fdr, meta, points(spark, sf_dir, meta), SIZE).select("row", "col", F.round("dist", 6).alias("dist"), "dp_row", "dp_col")


def longest_path_length(spark, sf_dir):
    fdr, meta = _valley(spark, sf_dir)
    return network.longest_flow_paths(fdr, meta, points(spark, sf_dir, meta), size=SIZE).select("fid", F.round("length", 6).alias("length_m"), F.round(F.col("length") * 3.28084, 6).alias("length_ft"))


def longest_flow_path(spark, sf_dir):
    fdr, meta = _valley(spark, sf_dir)
    paths = network.longest_flow_paths(fdr, meta, points(spark, sf_dir, meta), size=SIZE)
    return network.flow_path_lines(fdr, meta, cut(paths), SIZE)


def _network(spark, sf_dir):
    fdr, meta = _valley(spark, sf_dir)
    return cut(accumulation(fdr, meta, SIZE)), fdr, meta


def stream_cells(spark, sf_dir):
    return network.stream_cells(_network(spark, sf_dir)[0], THRESHOLD)


def stream_nodes(spark, sf_dir):
    fac, fdr, _ = _network(spark, sf_dir)
    return network.stream_nodes(fac, fdr, THRESHOLD, SIZE)


def stream_segments(spark, sf_dir):
    fac, fdr, meta = _network(spark, sf_dir)
    lines = network.streams(fac, fdr, meta, THRESHOLD, SIZE)[0]
    first, last = F.element_at("cells", 1), F.element_at("cells", -1)
    return lines.select(first["row"].alias("from_row"), first["col"].alias("from_col"), last["row"].alias("to_row"), last["col"].alias("to_col"), "n_cells")


def stream_junctions(spark, sf_dir):
    fac, fdr, meta = _network(spark, sf_dir)
    return network.streams(fac, fdr, meta, THRESHOLD, SIZE)[1].select("row", "col", "x", "y")


def snap_points(spark, sf_dir):
    fac, _, meta = _network(spark, sf_dir)
    return network.snap_points(points(spark, sf_dir, meta, "customer"), fac, SNAP_RADIUS)


def breach_single_cell(spark, sf_dir):
    return breach_ops.breach_single_cell(terrain(spark, sf_dir, "slope")[0], SIZE)


def breach_least_cost(spark, sf_dir):
    return breach_ops.breach(terrain(spark, sf_dir, "slope")[0], radius=10, size=SIZE)


def pipeline_streams(spark, sf_dir):
    """Conditioning to streams: fill, directions with flats, accumulation, stream lines."""
    dem, meta = terrain(spark, sf_dir, "slope")
    lines = pipeline(dem, meta, search_radius=0, threshold=THRESHOLD, size=SIZE)["streams"]
    first, last = F.element_at("cells", 1), F.element_at("cells", -1)
    return lines.select(first["row"].alias("from_row"), first["col"].alias("from_col"), last["row"].alias("to_row"), last["col"].alias("to_col"), "n_cells")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        d8_direction, direction_histogram, pits, flat_edges, fill_depressions, fill_holes, fill_depth_stats, flat_mask, flow_direction_resolved, flow_accumulation, flow_accumulation_holes,
        basins_all, basins_dp, basin_graph, basin_points, basin_boundary, basin_polygon_sides, basin_polygons, flow_length, longest_path_length, longest_flow_path,
        stream_cells, stream_nodes, stream_segments, stream_junctions, snap_points, breach_single_cell, breach_least_cost, pipeline_streams,
    )
}


# --- DuckDB ---------------------------------------------------------------------------------

_STEPS = "steps(d, dr, dc) AS (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1), (4, 0, -1), (5, 1, -1), (6, 1, 0), (7, 1, 1))"


def _grid_sql(kind: str, holes: bool) -> str:
    z = {"rough": "floor(value)", "slope": "floor(value / 8) + event_id // w + abs(event_id % w - w // 2)", "valley": "floor(value / 64) + 4 * (event_id // w) + 2 * abs(event_id % w - w // 2)"}[kind]
    z = f"CASE WHEN event_id % 97 <> 0 THEN {z} END" if holes else z
    return f"""size AS (SELECT ceil(sqrt(count(*)))::BIGINT AS w, count(*)::BIGINT AS n, ceil(count(*) / ceil(sqrt(count(*))))::BIGINT AS h FROM events),
{_STEPS},
g AS (SELECT (event_id // w)::BIGINT AS r, (event_id % w)::BIGINT AS c, ({z})::DOUBLE AS z FROM events, size)"""


def _d8_sql(source: str = "g") -> str:
    return f"""f AS (SELECT r, c, any_value(z) AS z, CASE WHEN any_value(z) IS NULL THEN {NODATA} WHEN max(s) <= 0 THEN {UNDEFINED} ELSE first(d ORDER BY s DESC, d) END AS dir FROM (
  SELECT a.r, a.c, a.z, d, CASE WHEN b.z IS NULL THEN 'inf'::DOUBLE ELSE (a.z - b.z) / CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2) ELSE 1 END END AS s
  FROM {source} a CROSS JOIN steps LEFT JOIN {source} b ON b.r = a.r + dr AND b.c = a.c + dc) GROUP BY r, c)"""


def _fill_sql(fill_holes: bool) -> str:
    """The least level by relaxation from the outlets; nodata is the lowest terrain."""
    hole = "" if fill_holes else " OR z IS NULL"
    return f"""t AS (SELECT r, c, coalesce(z, '-inf'::DOUBLE) AS z, z IS NULL AS hole, (SELECT count(*) FROM g n WHERE abs(n.r - g.r) <= 1 AND abs(n.c - g.c) <= 1) < 9{hole} AS outlet FROM g),
v(r, c, l) USING KEY (r, c) AS (
  SELECT r, c, CASE WHEN outlet THEN z ELSE 'inf'::DOUBLE END FROM t
  UNION
  SELECT n.r, n.c, greatest(n.z, min(a.l)) FROM v a JOIN t n ON n.r BETWEEN a.r - 1 AND a.r + 1 AND n.c BETWEEN a.c - 1 AND a.c + 1
  JOIN recurring.v k ON k.r = n.r AND k.c = n.c GROUP BY n.r, n.c, n.z, k.l HAVING greatest(n.z, min(a.l)) < k.l),
e AS (SELECT r, c, CASE WHEN l > '-inf'::DOUBLE THEN l END AS z FROM v)"""


_NEXT = f"""nxt AS (SELECT f.r, f.c, f.dir, t.r AS nr, t.c AS nc, t.dir AS ndir FROM f JOIN steps ON d = dir JOIN f t ON t.r = f.r + dr AND t.c = f.c + dc WHERE f.dir < {UNDEFINED})"""
_ACC = f"""walk(r, c, k) AS (SELECT r, c, r * 1000000 + c FROM f WHERE dir < {NODATA} UNION ALL SELECT nr, nc, k FROM walk JOIN nxt USING (r, c) WHERE ndir < {NODATA}),
acc AS (SELECT f.r, f.c, f.dir, CASE WHEN dir < {NODATA} THEN count(walk.k) - CASE WHEN dir = {UNDEFINED} THEN 1 ELSE 0 END END AS acc FROM f LEFT JOIN walk USING (r, c) GROUP BY f.r, f.c, f.dir)"""


def _points_sql(table: str) -> str:
    key, place = ("s_suppkey", "(s_suppkey * 7919) % n") if table == "supplier" else ("c_custkey", "(c_custkey * 37) % greatest(1, n // 10)")
    return f"dp AS (SELECT max({key})::BIGINT AS fid, ({place} // w)::BIGINT AS r, ({place} % w)::BIGINT AS c FROM {table}, size GROUP BY {place}, w)"


_BASIN = f"""hop AS (SELECT r, c, nr, nc FROM nxt WHERE ndir < {UNDEFINED} AND (r, c) NOT IN (SELECT (r, c) FROM dp)),
down(r0, c0, r, c) AS (SELECT r, c, r, c FROM f WHERE dir < {UNDEFINED} UNION ALL SELECT r0, c0, nr, nc FROM down JOIN hop USING (r, c)),
ends AS (SELECT r0 AS r, c0 AS c, down.r * w + down.c + 1 AS id FROM down ANTI JOIN hop USING (r, c) CROSS JOIN size),
b AS (SELECT f.r, f.c, coalesce(id, 0)::BIGINT AS id FROM f LEFT JOIN ends USING (r, c)),
own AS (SELECT dp.r, dp.c, id FROM dp JOIN b USING (r, c) WHERE id > 0),
graph AS (SELECT own.id AS basin_id, t.id AS ds_basin_id FROM own JOIN nxt USING (r, c) JOIN b t ON t.r = nr AND t.c = nc WHERE t.id > 0)"""
_NO_POINTS = "dp AS (SELECT 0::BIGINT AS fid, -1::BIGINT AS r, -1::BIGINT AS c)"

_LENGTH = f"""hop AS (SELECT r, c, nr, nc, CASE WHEN dir % 2 = 1 THEN sqrt(200) ELSE 10 END AS l FROM nxt WHERE (ndir < {NODATA} OR (nr, nc) IN (SELECT (r, c) FROM dp)) AND (r, c) NOT IN (SELECT (r, c) FROM dp)),
way(r0, c0, r, c, l) AS (SELECT r, c, r, c, 0::DOUBLE FROM f UNION ALL SELECT r0, c0, nr, nc, way.l + hop.l FROM way JOIN hop USING (r, c)),
len AS (SELECT r0 AS r, c0 AS c, way.l AS dist, dp.r AS dp_row, dp.c AS dp_col, dp.fid FROM way JOIN dp USING (r, c))"""

_FLATS = f"""fl AS (SELECT a.r, a.c, any_value(a.z) AS z, bool_or(b.z > a.z AND b.dir < {NODATA}) AS high, bool_or(b.z = a.z AND b.dir < {UNDEFINED}) AS low, min(CASE WHEN b.r IS NULL OR b.dir = {NODATA} THEN d END) AS out
  FROM f a CROSS JOIN steps LEFT JOIN f b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.dir = {UNDEFINED} GROUP BY a.r, a.c),
hi(r, c, l) USING KEY (r, c) AS (SELECT r, c, 1 FROM fl WHERE high UNION
  SELECT n.r, n.c, min(a.l) + 1 FROM hi a JOIN fl m ON m.r = a.r AND m.c = a.c JOIN fl n ON n.r BETWEEN a.r - 1 AND a.r + 1 AND n.c BETWEEN a.c - 1 AND a.c + 1 AND n.z = m.z LEFT JOIN recurring.hi k ON k.r = n.r AND k.c = n.c WHERE k.r IS NULL GROUP BY n.r, n.c),
lo(r, c, l) USING KEY (r, c) AS (SELECT r, c, 2 FROM fl WHERE low UNION
  SELECT n.r, n.c, min(a.l) + 1 FROM lo a JOIN fl m ON m.r = a.r AND m.c = a.c JOIN fl n ON n.r BETWEEN a.r - 1 AND a.r + 1 AND n.c BETWEEN a.c - 1 AND a.c + 1 AND n.z = m.z LEFT JOIN recurring.lo k ON k.r = n.r AND k.c = n.c WHERE k.r IS NULL GROUP BY n.r, n.c),
mask AS (SELECT fl.*, (CASE WHEN lo.l IS NULL THEN -coalesce(hi.l, 0) ELSE 2 * lo.l + CASE WHEN hi.l IS NULL THEN 0 ELSE {direction.FLAT_BASE} - hi.l END END)::BIGINT AS mask FROM fl LEFT JOIN hi USING (r, c) LEFT JOIN lo USING (r, c)),
fixed AS (SELECT a.r, a.c, coalesce(any_value(a.out), first(d ORDER BY (coalesce(b.mask, 2) - a.mask) / CASE WHEN d % 2 = 1 THEN sqrt(2) ELSE 1 END, d) FILTER (WHERE t.z = a.z), {UNDEFINED}) AS dir
  FROM mask a CROSS JOIN steps LEFT JOIN f t ON t.r = a.r + dr AND t.c = a.c + dc LEFT JOIN mask b ON b.r = t.r AND b.c = t.c GROUP BY a.r, a.c),
resolved AS (SELECT r, c, dir, z FROM f WHERE dir <> {UNDEFINED} UNION ALL SELECT r, c, fixed.dir, z FROM fixed JOIN f USING (r, c))"""

_STREAMS = f"""s AS (SELECT * FROM acc WHERE acc >= {THRESHOLD}),
ups AS (SELECT s.r, s.c, s.dir, count(u.r) AS n FROM s LEFT JOIN (SELECT nxt.* FROM nxt SEMI JOIN s USING (r, c)) u ON u.nr = s.r AND u.nc = s.c GROUP BY s.r, s.c, s.dir),
node AS (SELECT r, c FROM ups WHERE n <> 1),
line(r0, c0, r, c, k) AS (SELECT r, c, r, c, 1 FROM node UNION ALL SELECT r0, c0, nr, nc, k + 1 FROM line JOIN nxt USING (r, c) WHERE k = 1 OR (r, c) NOT IN (SELECT (r, c) FROM node)),
last AS (SELECT r0, c0, arg_max(r, k) AS r, arg_max(c, k) AS c, max(k) AS n, arg_max(r, k) FILTER (WHERE k < m) AS r1, arg_max(c, k) FILTER (WHERE k < m) AS c1 FROM (SELECT *, max(k) OVER (PARTITION BY r0, c0) AS m FROM line) GROUP BY r0, c0)"""
_SEGMENTS = "SELECT r0 AS from_row, c0 AS from_col, r AS to_row, c AS to_col, n::BIGINT AS n_cells FROM last"


def _sql(*parts: str, out: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + out


_CELL = "r AS row, c AS col"
_SLOPE_H, _SLOPE, _ROUGH_H, _VALLEY, _VALLEY_H = _grid_sql("slope", True), _grid_sql("slope", False), _grid_sql("rough", True), _grid_sql("valley", False), _grid_sql("valley", True)
_FILLED = (_SLOPE, _fill_sql(False), _d8_sql("e"))

ORACLE: dict[str, str] = {
    "d8_direction": _sql(_SLOPE_H, _d8_sql(), out=f"SELECT {_CELL}, dir FROM f"),
    "direction_histogram": _sql(_SLOPE_H, _d8_sql(), out="SELECT dir, count(*) AS cells FROM f GROUP BY dir"),
    "pits": _sql(_SLOPE_H, out="SELECT a.r AS row, a.c AS col, any_value(a.z) AS z FROM g a CROSS JOIN steps LEFT JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.z IS NOT NULL GROUP BY a.r, a.c HAVING count(b.z) = 8 AND min(b.z) >= any_value(a.z) AND max(b.z) > any_value(a.z)"),
    "flat_edges": _sql(_SLOPE_H, _d8_sql(), _FLATS, out=f"SELECT {_CELL}, coalesce(high, false)::INT AS high, coalesce(low, false)::INT AS low FROM fl"),
    "fill_depressions": _sql(_ROUGH_H, _fill_sql(False), out=f"SELECT {_CELL}, z FROM e"),
    "fill_holes": _sql(_ROUGH_H, _fill_sql(True), out=f"SELECT {_CELL}, z FROM e"),
    "fill_depth_stats": _sql(_SLOPE, _fill_sql(False), out="SELECT count(*) FILTER (WHERE e.z > g.z) AS raised, sum(e.z - g.z) AS volume, max(e.z - g.z) AS deepest FROM e JOIN g USING (r, c)"),
    "flat_mask": _sql(*_FILLED, _FLATS, out=f"SELECT {_CELL}, mask FROM mask"),
    "flow_direction_resolved": _sql(*_FILLED, _FLATS, out=f"SELECT {_CELL}, dir FROM resolved"),
    "flow_accumulation": _sql(_VALLEY, _d8_sql(), _NEXT, _ACC, out=f"SELECT {_CELL}, acc FROM acc"),
    "flow_accumulation_holes": _sql(_VALLEY_H, _d8_sql(), _NEXT, _ACC, out=f"SELECT {_CELL}, acc FROM acc"),
    "basins_all": _sql(_VALLEY_H, _d8_sql(), _NEXT, _NO_POINTS, _BASIN, out=f"SELECT {_CELL}, id AS basin_id FROM b"),
    "basins_dp": _sql(_VALLEY_H, _d8_sql(), _NEXT, _points_sql("supplier"), _BASIN, out=f"SELECT {_CELL}, CASE WHEN id IN (SELECT id FROM own) THEN id ELSE 0 END AS basin_id FROM b"),
    "basin_graph": _sql(_VALLEY, _d8_sql(), _NEXT, _points_sql("supplier"), _BASIN, out="SELECT basin_id, ds_basin_id FROM graph"),
    "basin_points": _sql(_VALLEY_H, _d8_sql(), _NEXT, _points_sql("customer"), _BASIN, out="SELECT fid, dp.r AS row, dp.c AS col, coalesce(b.id, 0)::BIGINT AS basin_id, coalesce(ds_basin_id, 0)::BIGINT AS ds_basin_id FROM dp LEFT JOIN b USING (r, c) LEFT JOIN (SELECT * FROM graph WHERE ds_basin_id IN (SELECT id FROM own)) ON basin_id = b.id"),
    "basin_boundary": _sql(_VALLEY_H, _d8_sql(), _NEXT, _points_sql("supplier"), _BASIN, out="SELECT DISTINCT x.r AS row, x.c AS col, x.id AS basin_id FROM b x CROSS JOIN steps LEFT JOIN b y ON y.r = x.r + dr AND y.c = x.c + dc WHERE x.id <> 0 AND coalesce(y.id, 0) <> x.id"),
    "basin_polygon_sides": _sql(_VALLEY, _d8_sql(), _NEXT, _points_sql("supplier"), _BASIN, "reach(a, p) AS (SELECT DISTINCT id, id FROM b WHERE id <> 0 UNION SELECT reach.a, ds_basin_id FROM reach JOIN graph ON basin_id = p)", "cells AS (SELECT r, c, p FROM b JOIN reach ON a = id)", out="SELECT p AS BasinID, count(*) AS sides FROM (SELECT * FROM cells CROSS JOIN steps WHERE d % 2 = 0) x ANTI JOIN cells y ON y.r = x.r + dr AND y.c = x.c + dc AND y.p = x.p GROUP BY p"),
    "flow_length": _sql(_VALLEY, _d8_sql(), _NEXT, _points_sql("supplier"), _LENGTH, out="SELECT f.r AS row, f.c AS col, round(dist, 6) AS dist, dp_row, dp_col FROM f LEFT JOIN len USING (r, c)"),
    "longest_path_length": _sql(_VALLEY, _d8_sql(), _NEXT, _points_sql("supplier"), _LENGTH, "far AS (SELECT dp_row AS r, dp_col AS c, max(dist) AS far FROM len GROUP BY dp_row, dp_col)", "on_(r0, c0, r, c, l) AS (SELECT r, c, r, c, far FROM far WHERE far > 0 UNION ALL SELECT r0, c0, nxt.nr, nxt.nc, on_.l + CASE WHEN nxt.dir % 2 = 1 THEN sqrt(200) ELSE 10 END FROM on_ JOIN nxt USING (r, c))", out="SELECT dp.fid, round(coalesce(max(l), 0), 6) AS length_m, round(coalesce(max(l), 0) * 3.28084, 6) AS length_ft FROM dp LEFT JOIN on_ USING (r, c) GROUP BY dp.fid, dp.r, dp.c"),
    "stream_cells": _sql(_VALLEY, _d8_sql(), _NEXT, _ACC, out=f"SELECT {_CELL}, acc FROM acc WHERE acc >= {THRESHOLD}"),
    "stream_nodes": _sql(_VALLEY, _d8_sql(), _NEXT, _ACC, _STREAMS, out=f"SELECT {_CELL} FROM node"),
    "stream_segments": _sql(_VALLEY, _d8_sql(), _NEXT, _ACC, _STREAMS, out=_SEGMENTS),
    "stream_junctions": _sql(_VALLEY, _d8_sql(), _NEXT, _ACC, _STREAMS, out="SELECT r AS row, c AS col, (c + 0.5) * 10.0::DOUBLE AS x, (r + 0.5) * -10.0::DOUBLE AS y FROM (SELECT r, c FROM node UNION ALL SELECT r1, c1 FROM last WHERE n >= 2 AND (r, c) NOT IN (SELECT (r, c) FROM node))"),
    "snap_points": _sql(_VALLEY, _d8_sql(), _NEXT, _ACC, _points_sql("customer"), out=f"SELECT max(fid) AS fid, row, col FROM (SELECT fid, first(a.r ORDER BY acc DESC, a.r, a.c) AS row, first(a.c ORDER BY acc DESC, a.r, a.c) AS col FROM dp JOIN acc a ON abs(a.r - dp.r) <= {SNAP_RADIUS} AND abs(a.c - dp.c) <= {SNAP_RADIUS} GROUP BY fid, dp.r, dp.c) GROUP BY row, col"),
    "pipeline_streams": _sql(*_FILLED, _FLATS.replace("resolved AS", "f2 AS"), _NEXT.replace("FROM f ", "FROM f2 f ").replace("JOIN f t", "JOIN f2 t"), _ACC.replace("FROM f ", "FROM f2 f "), _STREAMS, out=_SEGMENTS),
}
