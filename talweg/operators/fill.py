"""Filling depressions: the least level at which every cell spills to an outlet.

The filled level of a cell is the larger of its own elevation and the bottleneck of its best way
out.  In each tile cells run down to local minima (labels); the least spill between
neighbouring labels is an edge.  Only labels at a tile's border, and the outside,
enter the global graph: within a tile, a merge forest of those labels keeps all
bottlenecks.  The global graph is solved by a heap on the driver up to
``DRIVER_EDGES`` edges (its size is counted first), and by relaxation rounds of joins beyond.
A last pass raises each tile from its border labels' levels.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.grid import STEPS, GridMeta
from talweg.plans.session import cut
from talweg.plans.tiles import TILE, Tile, in_tiles, neighbour, tile_join, tile_map

OUTSIDE = -1
DRIVER_EDGES = 2_000_000


def _tile_graph(t: Tile, meta: GridMeta, fill_holes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(label of each place, edge ends a < b, spill) of a tile; labels are cell ids, -1 without data."""
    z = np.where(t.core, _terrain(t), np.nan)
    h, w = z.shape
    flat = np.arange(h * w).reshape(h, w)
    has = t.core
    # the lowest neighbour by (elevation, place), if lower than the cell itself
    best_z, best = np.where(has, z, np.inf), np.where(has, flat, -1)
    for d in range(8):
        n, i = neighbour(z, d, np.nan), neighbour(flat, d, -1)
        with np.errstate(invalid="ignore"):
            lower = (n < best_z) | ((n == best_z) & (i < best))
        best_z, best = np.where(lower, n, best_z), np.where(lower, i, best)
    root = best.ravel().copy()
    ok = root >= 0
    while True:
        hop = np.where(ok, root[root], -1)
        if (hop == root).all():
            break
        root = hop
    ids = t.ids(meta.ncols).ravel()
    label = np.where(ok, ids[root], OUTSIDE).reshape(h, w)
    a, b, s = [], [], []
    for d in range(4):  # each pair of neighbours once
        n, m = neighbour(z, d, np.nan), neighbour(label, d, OUTSIDE)
        pair = has & ~np.isnan(n) & (m != label)
        a.append(np.minimum(label[pair], m[pair]))
        b.append(np.maximum(label[pair], m[pair]))
        s.append(np.maximum(z[pair], n[pair]))
    # outlets: the raster's edge, and nodata inside it
    out = np.zeros(z.shape, bool)
    for d in range(8):
        out |= ~neighbour(t.present, d, False)
    rr, cc = np.arange(h)[:, None] + t.r0, np.arange(w)[None, :] + t.c0
    out |= (rr == 0) | (cc == 0) | (rr == meta.nrows - 1) | (cc == meta.ncols - 1)
    if not fill_holes:
        out |= np.isneginf(z)
    out &= has
    a.append(np.full(int(out.sum()), OUTSIDE))
    b.append(label[out])
    s.append(z[out])
    return label, *_least(np.concatenate(a), np.concatenate(b), np.concatenate(s))


def _terrain(t: Tile) -> np.ndarray:
    """Elevations with nodata as the lowest terrain; NaN only outside the raster."""
    return np.where(t.present & np.isnan(t.data["z"]), -np.inf, t.data["z"])


def _least(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((s, b, a))
    a, b, s = a[order], b[order], s[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[first], b[first], s[first]


def _border(t: Tile, size: int) -> np.ndarray:
    return (t.rows % size == 0) | (t.rows % size == size - 1) | (t.cols % size == 0) | (t.cols % size == size - 1)


def _merged(a: np.ndarray, b: np.ndarray, s: np.ndarray, kept: set[int]) -> list[tuple[int, int, float]]:
    """Edges among kept labels with the same bottlenecks, by merging in the order of spills."""
    parent: dict[int, int] = {}
    stands: dict[int, int | None] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.argsort(s, kind="stable").tolist():
        p, q = find(int(a[k])), find(int(b[k]))
        if p == q:
            continue
        for x in (p, q):
            stands.setdefault(x, x if x in kept else None)
        if stands[p] is not None and stands[q] is not None:
            out.append((stands[p], stands[q], float(s[k])))
        parent[q] = p
        stands[p] = stands[p] if stands[p] is not None else stands[q]
    return out


def solve(edges: list[tuple[int, int, float]]) -> dict[int, float]:
    """The bottleneck of each node's best way to OUTSIDE."""
    near: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for a, b, s in edges:
        near[a].append((b, s))
        near[b].append((a, s))
    level, heap = {}, [(-np.inf, OUTSIDE)]
    while heap:
        v, x = heapq.heappop(heap)
        if x in level:
            continue
        level[x] = v
        for y, s in near[x]:
            if y not in level:
                heapq.heappush(heap, (max(v, s), y))
    return level


def _solve_by_joins(edges: DataFrame) -> DataFrame:
    """The same by relaxation: levels only sink, until no edge lowers one."""
    both = cut(edges.select("a", "b", "s").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).filter(F.col("a") != OUTSIDE))
    level = cut(both.groupBy("a").agg(F.min(F.when(F.col("b") == OUTSIDE, F.col("s"))).alias("v")))
    while True:
        near = level.select(F.col("a").alias("b"), F.col("v").alias("u"))
        step = both.join(near, "b").groupBy("a").agg(F.min(F.greatest("s", F.when(F.col("u").isNotNull(), F.col("u")).otherwise(F.lit(float("inf"))))).alias("w"))
        new = cut(level.join(step, "a", "left").select("a", F.col("v").alias("old"), F.least("v", "w").alias("v")))
        if new.filter("v < old OR (old IS NULL AND v IS NOT NULL)").limit(1).count() == 0:
            return new.filter("v IS NOT NULL AND v < double('inf')").select("a", "v")
        level = new.select("a", F.when(F.col("v") < float("inf"), F.col("v")).alias("v"))


def spill_edges(dem: DataFrame, meta: GridMeta, fill_holes: bool = False, size: int = TILE) -> DataFrame:
    """(a, b, s): the spill graph of labels at tile borders and the outside (-1)."""
    dem = dem.select("row", "col", F.col("z").cast("double").alias("z"))

    def inner(t: Tile) -> dict[str, np.ndarray]:
        label, a, b, s = _tile_graph(t, meta, fill_holes)
        kept = {OUTSIDE, *t.own(label)[_border(t, size)].tolist()}
        edges = _merged(a, b, s, kept)
        cols = list(zip(*edges, strict=True)) or [[], [], []]
        return {"a": np.array(cols[0], np.int64), "b": np.array(cols[1], np.int64), "s": np.array(cols[2], np.float64)}

    def rim(t: Tile) -> dict[str, np.ndarray]:
        label, *_ = _tile_graph(t, meta, fill_holes)
        at = _border(t, size)
        return {"row": t.rows[at], "col": t.cols[at], "z": t.own(_terrain(t))[at], "label": t.own(label)[at]}

    within = tile_map(dem, ["z"], inner, "a long, b long, s double", 1, size)
    border = cut(tile_map(dem, ["z"], rim, "row long, col long, z double, label long", 1, size))
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in STEPS[:4]))
    ahead = border.select(F.explode(steps).alias("s"), "row", "col", F.col("z").alias("y"), F.col("label").alias("b")).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "y", "b")
    across = border.join(ahead, ["row", "col"]).filter("label != b").select(F.least("label", "b").alias("a"), F.greatest("label", "b").alias("b"), F.greatest("z", "y").alias("s"))
    return within.unionByName(across).groupBy("a", "b").agg(F.min("s").alias("s"))


def levels(spark: SparkSession, edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(a, v): each label's level."""
    edges = cut(edges)
    if edges.count() > driver_edges:
        return _solve_by_joins(edges)
    got = solve([(r.a, r.b, r.s) for r in edges.toLocalIterator()])  # at most driver_edges rows
    rows = pa.table({"a": pa.array([k for k in got if k != OUTSIDE], pa.int64()), "v": pa.array([v for k, v in got.items() if k != OUTSIDE], pa.float64())})
    return spark.createDataFrame(rows)


def fill(dem: DataFrame, meta: GridMeta, fill_holes: bool = False, size: int = TILE, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(row, col, z) with depressions raised to their spill level.

    Without ``fill_holes`` nodata inside the raster is an outlet; with it, only the
    raster's edge is, and nodata that the edge does not drain is raised like terrain.
    """
    kind = dict(dem.dtypes)["z"]
    dem = dem.select("row", "col", F.col("z").cast("double").alias("z"))
    level = levels(dem.sparkSession, spill_edges(dem, meta, fill_holes, size), driver_edges)
    where = level.select(F.floor(F.col("a") / meta.ncols).cast("long").alias("row"), (F.col("a") % meta.ncols).alias("col"), F.col("v"), F.col("a"))

    def raise_(t: Tile, extra: pa.Table) -> dict[str, np.ndarray]:
        label, a, b, s = _tile_graph(t, meta, fill_holes)
        known = dict(zip(extra.column("a").to_pylist(), extra.column("v").to_pylist(), strict=True))
        # the way out starts at labels whose level is known
        edges = [*zip(a.tolist(), b.tolist(), s.tolist(), strict=True), *((OUTSIDE, k, v) for k, v in known.items())]
        got = solve(edges)
        own = t.own(label)
        names, back = np.unique(own, return_inverse=True)
        level = np.array([got.get(int(x), -np.inf) for x in names])
        raised = np.maximum(t.own(_terrain(t)), level[back])
        return {"row": t.rows, "col": t.cols, "z": np.where(np.isneginf(raised), np.nan, raised)}

    return tile_join(dem, ["z"], in_tiles(where, 0, size), raise_, "row long, col long, z double", 1, size).withColumn("z", F.col("z").cast(kind))
