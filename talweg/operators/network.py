"""Drainage points, basins, flow length, longest flow paths and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.grid import STEPS, UNDEFINED, GridMeta, cell_xy, step_col, step_row, xy_cell
from talweg.plans.flowgraph import MAX_ROUNDS, accumulation, lines_down, trace
from talweg.plans.session import cut
from talweg.plans.tiles import TILE, Tile, neighbour, tile_map

__all__ = ["accumulation", "basin_boundary", "basin_polygon_edges", "basin_polygons", "basins", "drainage_cells", "flow_length", "longest_flow_paths", "snap_points", "stream_cells", "stream_nodes", "streams", "update_points"]


def drainage_cells(points: DataFrame, meta: GridMeta) -> DataFrame:
    """(fid, row, col) of points (fid, x, y); of points in one cell the last by fid stays."""
    row, col = xy_cell(meta, F.col("x"), F.col("y"))
    at = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select("fid", row.alias("row"), col.alias("col"))
    return last_wins(at.filter(f"row >= 0 AND row < {meta.nrows} AND col >= 0 AND col < {meta.ncols}"))


def last_wins(points: DataFrame) -> DataFrame:
    return points.groupBy("row", "col").agg(F.max("fid").alias("fid")).select("fid", "row", "col")


def snap_points(points: DataFrame, fac: DataFrame, radius: int, size: int = TILE) -> DataFrame:
    """(fid, row, col) moved to the cell of most accumulation within a square; ties go to the first in row-major order.

    Points meet the cells around them by blocks of the window's size, an equi-join, and the
    best cell is kept by partial aggregation.  A radius up to 1 changes nothing.
    """
    if radius <= 1:
        return points
    step = 2 * radius + 1
    block = lambda r, c: (F.floor(r / step).cast("long"), F.floor(c / step).cast("long"))
    corners = F.array_distinct(F.array(*(F.struct(*(x.alias(n) for x, n in zip(block(F.col("row") + a, F.col("col") + b), "rc", strict=True))) for a in (-radius, radius) for b in (-radius, radius))))
    near = points.select("fid", F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(corners).alias("k")).select("fid", "r0", "c0", F.col("k.r").alias("br"), F.col("k.c").alias("bc"))
    br, bc = block(F.col("row"), F.col("col"))
    cells = fac.select("row", "col", "acc", br.alias("br"), bc.alias("bc"))
    fits = near.join(cells, ["br", "bc"]).filter((F.abs(F.col("row") - F.col("r0")) <= radius) & (F.abs(F.col("col") - F.col("c0")) <= radius))
    # nodata counts as -9999, as in a raster
    best = F.max_by(F.struct("row", "col"), F.struct(F.coalesce("acc", F.lit(-9999)), -F.col("row"), -F.col("col")))
    moved = fits.groupBy("fid", "r0", "c0").agg(best.alias("to"))
    out = points.select("fid", F.col("row").alias("r0"), F.col("col").alias("c0")).join(moved, ["fid", "r0", "c0"], "left")
    return last_wins(out.select("fid", F.coalesce("to.row", "r0").alias("row"), F.coalesce("to.col", "c0").alias("col")))


def _next(df: DataFrame) -> DataFrame:
    """Add nrow, ncol of the cell that a directed cell flows to."""
    return df.withColumns({"nrow": F.col("row") + step_row(F.col("dir")), "ncol": F.col("col") + step_col(F.col("dir"))})


def basins(fdr: DataFrame, meta: GridMeta, points: DataFrame | None = None, all_basins: bool = True, size: int = TILE) -> tuple[DataFrame, DataFrame]:
    """((row, col, basin_id), (basin_id, ds_basin_id)): the catchments of outlets and drainage points.

    A basin's id is row * ncols + col + 1 of the cell in which it ends; undefined and nodata
    cells have 0.  The graph has the basin that follows each drainage point's.  Without
    ``all_basins``, cells that drain to no point have 0.
    """
    dp = points.select("row", "col").distinct() if points is not None else None
    end = cut(trace(fdr, meta, dp, into_undefined=False, size=size))
    label = F.when(F.col("dir") < UNDEFINED, F.coalesce(F.col("last") + 1, F.lit(0))).otherwise(F.lit(0)).cast("long")
    cells = end.select("row", "col", "dir", label.alias("basin_id"))
    if dp is None:
        none = cells.limit(0).select("basin_id", F.lit(0).cast("long").alias("ds_basin_id"))
        return cells.select("row", "col", "basin_id"), none
    own = cells.join(dp, ["row", "col"]).filter("basin_id > 0")
    ahead = _next(own).select("basin_id", F.col("nrow").alias("row"), F.col("ncol").alias("col"))
    graph = ahead.join(cells.select("row", "col", F.col("basin_id").alias("ds_basin_id")), ["row", "col"]).filter("ds_basin_id > 0").select("basin_id", "ds_basin_id")
    if not all_basins:
        cells = cells.join(own.select("basin_id", F.lit(True).alias("__own")), "basin_id", "left").withColumn("basin_id", F.when(F.col("__own"), F.col("basin_id")).otherwise(F.lit(0)))
    return cells.select("row", "col", F.col("basin_id").cast("long").alias("basin_id")), graph


def update_points(points: DataFrame, labels: DataFrame, graph: DataFrame, meta: GridMeta) -> DataFrame:
    """Points with basin_id and ds_basin_id: the next point's basin downstream, or 0."""
    own = points.join(labels.select("row", "col", "basin_id"), ["row", "col"], "left")
    reached = own.filter((F.col("basin_id") == F.col("row") * meta.ncols + F.col("col") + 1)).select(F.col("basin_id").alias("ds_basin_id"), F.lit(True).alias("__dp"))
    down = graph.join(reached.distinct(), "ds_basin_id").select("basin_id", "ds_basin_id")
    out = own.join(down, "basin_id", "left")
    return out.withColumns({"basin_id": F.coalesce("basin_id", F.lit(0)).cast("long"), "ds_basin_id": F.coalesce("ds_basin_id", F.lit(0)).cast("long")})


def step_length_of(meta: GridMeta):
    """Length of a step from (rows, directions): map units, or metres along the ellipsoid's sphere."""
    g = meta.gt
    dr, dc = np.array(STEPS, float).T

    def projected(rows: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.hypot(dc[d] * g[1], dr[d] * g[5])

    def geographic(rows: np.ndarray, d: np.ndarray) -> np.ndarray:
        lat = np.radians(g[3] + (rows + 0.5) * g[5])
        to = np.radians(g[3] + (rows + dr[d] + 0.5) * g[5])
        return haversine(lat, 0.0, to, np.radians(dc[d] * g[1]), meta.semi_major)

    return geographic if meta.is_geographic else projected


def haversine(lat1, lon1, lat2, lon2, radius: float = 6378137.0):
    """Great-circle distance of points in radians."""
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(a))


def flow_length(fdr: DataFrame, meta: GridMeta, points: DataFrame, size: int = TILE) -> DataFrame:
    """(row, col, dist, dp_row, dp_col): the way to the first drainage point downstream; null without one.

    A point's own distance is 0.  Points on cells without a direction collect flow too.
    """
    dp = points.select("row", "col").distinct()
    end = trace(fdr, meta, dp, step_length_of(meta), into_stops=True, size=size)
    at = end.withColumns({"dp_row": F.floor(F.col("last") / meta.ncols).cast("long"), "dp_col": F.col("last") % meta.ncols})
    marks = dp.select(F.col("row").alias("dp_row"), F.col("col").alias("dp_col"), F.lit(True).alias("__dp"))
    out = at.join(marks, ["dp_row", "dp_col"], "left")
    return out.select("row", "col", *(F.when(F.col("__dp"), F.col(c)).alias(c) for c in ("dist", "dp_row", "dp_col")), "dir", "hops")


def _point_graph(length: DataFrame, meta: GridMeta, points: DataFrame) -> DataFrame:
    """(row, col, far, far_row, far_col, ds_row, ds_col, ds_dist) of each point: its farthest cell and the next point."""
    g = meta.gt
    far = length.filter("dist > 0").groupBy(F.col("dp_row").alias("row"), F.col("dp_col").alias("col")).agg(F.max_by(F.struct("dist", "row", "col"), F.struct("dist", -F.col("row"), -F.col("col"))).alias("f"))
    far = far.select("row", "col", F.col("f.dist").alias("far"), F.col("f.row").alias("far_row"), F.col("f.col").alias("far_col"))
    own = _next(points.select("row", "col").distinct().join(length.select("row", "col", "dir"), ["row", "col"]).filter(F.col("dir") < UNDEFINED))
    if meta.is_geographic:
        lat = lambda r: F.radians(F.lit(float(g[3])) + (r + 0.5) * F.lit(float(g[5])))
        a, b, dx = lat(F.col("row")), lat(F.col("nrow")), F.radians((F.col("ncol") - F.col("col")) * F.lit(float(g[1])))
        step = 2 * meta.semi_major * F.asin(F.sqrt(F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dx / 2), 2)))
    else:
        step = F.hypot((F.col("ncol") - F.col("col")) * F.lit(float(g[1])), (F.col("nrow") - F.col("row")) * F.lit(float(g[5])))
    ahead = length.filter("dp_row IS NOT NULL").select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("dp_row").alias("ds_row"), F.col("dp_col").alias("ds_col"), F.col("dist").alias("__d"))
    down = own.join(ahead, ["nrow", "ncol"]).select("row", "col", "ds_row", "ds_col", (step + F.col("__d")).alias("ds_dist"))
    return points.select("row", "col").distinct().join(far, ["row", "col"], "left").join(down, ["row", "col"], "left")


def longest_flow_paths(fdr: DataFrame, meta: GridMeta, points: DataFrame, length: DataFrame | None = None, size: int = TILE) -> DataFrame:
    """(fid, row, col, length, start_row, start_col) of points (fid, row, col): the longest way that ends in each.

    The farthest cell of a point's own basin competes with those of all points upstream, by
    doubling maxima over the graph of points.  A point that nothing drains to starts in itself.
    """
    length = cut(length if length is not None else flow_length(fdr, meta, points, size))
    g = _point_graph(length, meta, points)
    now = cut(g.select(F.struct("row", "col").alias("p"), F.when(F.col("ds_row").isNotNull(), F.struct(F.col("ds_row").alias("row"), F.col("ds_col").alias("col"))).alias("anc"), F.col("ds_dist").alias("d"), F.when(F.col("far").isNotNull(), F.struct(F.col("far").alias("len"), (-F.col("far_row")).alias("r"), (-F.col("far_col")).alias("c"))).alias("best")))
    for _ in range(min(MAX_ROUNDS, now.count().bit_length() + 1)):
        if not now.filter("anc IS NOT NULL").limit(1).count():
            break
        up = now.filter("anc IS NOT NULL AND best IS NOT NULL").groupBy(F.col("anc").alias("p")).agg(F.max(F.struct((F.col("best.len") + F.col("d")).alias("len"), F.col("best.r").alias("r"), F.col("best.c").alias("c"))).alias("more"))
        hop = now.select(F.col("p").alias("anc"), F.col("anc").alias("next"), F.col("d").alias("nd"))
        now = cut(now.join(up, "p", "left").join(hop, "anc", "left").select("p", F.col("next").alias("anc"), (F.col("d") + F.col("nd")).alias("d"), F.greatest("best", "more").alias("best")))
    got = now.select(F.col("p.row").alias("row"), F.col("p.col").alias("col"), F.coalesce("best.len", F.lit(0.0)).alias("length"), F.coalesce(-F.col("best.r"), "p.row").alias("start_row"), F.coalesce(-F.col("best.c"), "p.col").alias("start_col"))
    return points.select("fid", "row", "col").join(got, ["row", "col"]).select("fid", "row", "col", "length", "start_row", "start_col")


def flow_path_lines(fdr: DataFrame, meta: GridMeta, paths: DataFrame, size: int = TILE) -> DataFrame:
    """(dp_id, length_map, length_m, length_ft, coords) of longest_flow_paths rows.

    Each start's cells are laid out once, as far as the farthest point that a path from it ends in; a path is
    the part of them up to its own point.
    """
    number = lambda r, c: meta.cell_id(F.col(r), F.col(c))
    walk = cut(paths.select("fid", "length", "start_row", "start_col", number("start_row", "start_col").alias("start"), number("row", "col").alias("to"), F.struct("row", "col").alias("end")))
    rows, step = np.arange(meta.nrows), step_length_of(meta)
    least = max(min(float(np.min(step(rows, np.full(len(rows), d)))) for d in (0, 2, 6)), 1e-9) if meta.nrows else 1.0
    most = F.least(F.floor(F.col("length") / least).cast("long") + 1, F.lit(meta.nrows * meta.ncols))
    lines = lines_down(fdr, meta, walk.select("start", "to", most.alias("most")), size)
    at = F.array_position("cells", F.col("end"))
    drawn = walk.join(lines, "start", "left").withColumn("cells", F.coalesce("cells", F.array(F.struct(F.col("start_row").alias("row"), F.col("start_col").alias("col")))))
    drawn = drawn.select(F.col("fid").alias("dp_id"), F.col("length").alias("length_map"), F.when(at > 0, F.slice("cells", F.lit(1), at.cast("int"))).otherwise(F.col("cells")).alias("cells"))

    def centre(s):
        x, y = cell_xy(meta, s["row"], s["col"])
        return F.struct(x.alias("x"), y.alias("y"))

    return drawn.select("dp_id", "length_map", F.col("length_map").alias("length_m"), (F.col("length_map") * 3.28084).alias("length_ft"), F.transform("cells", centre).alias("coords"))


def stream_cells(fac: DataFrame, threshold: int) -> DataFrame:
    return fac.filter(F.col("acc") >= threshold)


def _upstream(fac: DataFrame, fdr: DataFrame, threshold: int, size: int) -> DataFrame:
    """(row, col, dir, n, up) of stream cells: the number of stream cells that flow in, and the direction to the first."""
    both = fdr.select("row", "col", F.col("dir").cast("int").alias("dir")).join(fac.select("row", "col", F.coalesce(F.col("acc") >= threshold, F.lit(False)).alias("on")), ["row", "col"])

    def kernel(t: Tile) -> dict[str, np.ndarray]:
        code, on = np.where(t.present, t.data["dir"], 9), t.data["on"]
        n, up = np.zeros(t.shape, np.int64), np.full(t.shape, UNDEFINED)
        for d in range(8):
            comes = neighbour(on, d, False) & (neighbour(code, d, 9) == (d + 4) % 8)
            n += comes
            up = np.where(comes & (up == UNDEFINED), d, up)
        at = t.own(on)
        pick = lambda a: t.own(a)[at]
        return {"row": t.rows[at], "col": t.cols[at], "dir": pick(code), "n": pick(n), "up": pick(up)}

    return tile_map(both, ["dir", "on"], kernel, "row long, col long, dir int, n long, up int", 1, size)


def stream_nodes(fac: DataFrame, fdr: DataFrame, threshold: int, size: int = TILE) -> DataFrame:
    """(row, col) of the stream cells at which lines begin: sources and confluences."""
    return _upstream(fac, fdr, threshold, size).filter("n <> 1").select("row", "col")


def streams(fac: DataFrame, fdr: DataFrame, meta: GridMeta, threshold: int = 5, size: int = TILE) -> tuple[DataFrame, DataFrame]:
    """((line_id, n_cells, cells, coords), (row, col, x, y, kind)): stream lines and junctions.

    A line runs from a node to the next node, or to the last cell inside the raster that the flow enters.  A
    cell that is no node has one stream cell above it, so following those upward gives
    its line's node and its place in the line.  Where a line ends without a node, the cell
    before its end is a junction too, once for each such line.
    """
    s = cut(_upstream(fac, fdr, threshold, size))
    nodes = s.filter("n <> 1").select("row", "col")
    upward = s.select("row", "col", F.when(F.col("n") == 1, F.col("up")).otherwise(F.lit(UNDEFINED)).alias("dir"))
    place = trace(upward, meta, size=size).select("row", "col", F.col("last").alias("line_id"), "hops").filter("line_id IS NOT NULL")
    cells = place.join(s.select("row", "col", "dir"), ["row", "col"])
    spot = F.struct("hops", "row", "col", "dir")
    lines = cells.groupBy("line_id").agg(F.array_sort(F.collect_list(spot)).alias("c"))
    last = F.element_at("c", -1)
    end = F.struct((last["row"] + step_row(last["dir"])).alias("row"), (last["col"] + step_col(last["dir"])).alias("col"))
    inside = (last["dir"] < UNDEFINED) & (end["row"] >= 0) & (end["row"] < meta.nrows) & (end["col"] >= 0) & (end["col"] < meta.ncols)
    body = F.transform("c", lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col")))
    lines = lines.select("line_id", F.when(inside, F.concat(body, F.array(end))).otherwise(body).alias("cells"))

    def centre(p):
        x, y = cell_xy(meta, p["row"], p["col"])
        return F.struct(x.alias("x"), y.alias("y"))

    lines = lines.select("line_id", F.size("cells").cast("long").alias("n_cells"), "cells", F.transform("cells", centre).alias("coords"))
    ends = lines.filter("n_cells >= 2").select(F.element_at("cells", -1).alias("e"), F.element_at("cells", -2).alias("j")).select(F.col("e.row").alias("row"), F.col("e.col").alias("col"), "j")
    extra = ends.join(nodes, ["row", "col"], "left_anti").select(F.col("j.row").alias("row"), F.col("j.col").alias("col"))
    both = nodes.withColumn("kind", F.lit("node")).unionByName(extra.withColumn("kind", F.lit("outlet")))
    x, y = cell_xy(meta, F.col("row"), F.col("col"))
    return lines, both.select("row", "col", x.alias("x"), y.alias("y"), "kind")


def basin_boundary(labels: DataFrame, size: int = TILE) -> DataFrame:
    """(row, col, basin_id) of labelled cells with an 8-neighbour of another label; outside counts as 0."""

    def kernel(t: Tile) -> dict[str, np.ndarray]:
        b, edge = t.data["basin_id"], np.zeros(t.shape, bool)
        for d in range(8):
            edge |= neighbour(b, d, 0) != b
        at = t.own(edge & (b != 0))
        return {"row": t.rows[at], "col": t.cols[at], "basin_id": t.own(b)[at]}

    return tile_map(labels, ["basin_id"], kernel, "row long, col long, basin_id long", 1, size)


def downstream_basins(graph: DataFrame) -> DataFrame:
    """(basin_id, into): each basin with itself and all basins downstream of it, by doubling."""
    pairs = jump = cut(graph.select("basin_id", F.col("ds_basin_id").alias("into")).distinct())
    n = pairs.count()
    for _ in range(min(MAX_ROUNDS, n.bit_length() + 1)):
        ahead = jump.select(F.col("basin_id").alias("into"), F.col("into").alias("far"))
        new = cut(pairs.unionByName(pairs.join(ahead, "into").select("basin_id", F.col("far").alias("into"))).distinct())
        if (more := new.count()) == n:
            break
        jump = cut(jump.join(ahead, "into").select("basin_id", F.col("far").alias("into")).distinct())
        pairs, n = new, more
    return pairs


#: The side towards each of four directions, as the corners that it runs between clockwise on the map.
SIDES = {2: (0, 0, 0, 1), 0: (0, 1, 1, 1), 6: (1, 1, 1, 0), 4: (1, 0, 0, 0)}


def basin_polygon_edges(labels: DataFrame, graph: DataFrame, wanted: DataFrame | None = None, size: int = TILE) -> DataFrame:
    """(BasinID, r0, c0, r1, c1): sides of cells, as corner numbers, that bound a basin with all that drains into it.

    A side bounds the basins that hold one of its two cells but not the other; which these are is found once for
    each pair of labels that meet.  ``wanted`` (basin_id) restricts the basins.
    """

    def kernel(t: Tile) -> dict[str, np.ndarray]:
        b, out = t.data["basin_id"], []
        for d, corners in SIDES.items():
            other = t.own(neighbour(b, d, 0))
            at = (t.own(b) != 0) & (other != t.own(b))
            r, c = t.rows[at], t.cols[at]
            out.append((t.own(b)[at], other[at], *(x + k for x, k in zip((r, c, r, c), corners, strict=True))))
        return dict(zip(("basin_id", "other", "r0", "c0", "r1", "c1"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True))

    sides = cut(tile_map(labels, ["basin_id"], kernel, "basin_id long, other long, r0 long, c0 long, r1 long, c1 long", 1, size))
    own = sides.select("basin_id").distinct()
    into = own.select("basin_id", F.col("basin_id").alias("into")).unionByName(downstream_basins(graph).select("basin_id", "into")).distinct()
    into = cut(into)
    meet = sides.select("basin_id", "other").distinct().join(into, "basin_id")
    if wanted is not None:
        meet = meet.join(wanted.select(F.col("basin_id").alias("into")).distinct(), "into", "left_semi")
    bounds = meet.join(into.withColumnRenamed("basin_id", "other"), ["other", "into"], "left_anti")
    return sides.join(bounds, ["basin_id", "other"]).select(F.col("into").alias("BasinID"), "r0", "c0", "r1", "c1")


def basin_polygons(labels: DataFrame, graph: DataFrame, meta: GridMeta, wanted: DataFrame | None = None, size: int = TILE) -> DataFrame:
    """(BasinID, coords): the outer ring of each basin with all that drains into it, clockwise on the map from its top-left corner."""
    edges = basin_polygon_edges(labels, graph, wanted, size)
    g = meta.gt

    def ring(pdf: pd.DataFrame) -> pd.DataFrame:
        out_of: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r0, c0, r1, c1 in pdf[["r0", "c0", "r1", "c1"]].itertuples(index=False):
            out_of.setdefault((r0, c0), []).append((r1, c1))
        start = min(out_of)
        line, came = [start], (0, 1)
        while True:
            at = line[-1]
            options = out_of[at]
            # where two cells touch at a corner, the leftmost turn keeps them in one ring
            turn = lambda q: (came[0] * (q[1] - at[1]) - came[1] * (q[0] - at[0]), came[0] * (q[0] - at[0]) + came[1] * (q[1] - at[1]))  # noqa: E731, B023
            q = max(options, key=turn)
            options.remove(q)
            came = (q[0] - at[0], q[1] - at[1])
            if len(line) > 1 and (line[-1][0] - line[-2][0], line[-1][1] - line[-2][1]) == came:
                line[-1] = q
            else:
                line.append(q)
            if q == start:
                break
        xy = [{"x": g[0] + c * g[1] + r * g[2], "y": g[3] + c * g[4] + r * g[5]} for r, c in line]
        return pd.DataFrame({"BasinID": [pdf["BasinID"].iloc[0]], "coords": [xy]})

    return edges.groupBy("BasinID").applyInPandas(ring, "BasinID long, coords array<struct<x: double, y: double>>")
