"""Golden arrays, tile invariance and invariants of the terrain operators."""

import numpy as np
import pytest

from grids import dense, grid
from talweg.grid import STEPS, GridMeta
from talweg.operators import breach, direction, fill, network
from talweg.plans.flowgraph import accumulation

# The small grids in upper case below, here and before later tests, with the results that must come out.
DEM = [[5, 4, 3, 2, 1], [5, 5, 5, 5, 5], [5, 5, 5, 5, 5], [5, 5, 4, 5, 5], [5, 5, 5, 5, 5]]
FLOW = [[1, 1, 1, 1, 0], [3, 1, 1, 2, 0], [3, 7, 6, 5, 0], [3, 0, 8, 4, 0], [3, 5, 5, 5, 0]]

FLAT_Z = [[1] * 7, *[[1, 0, 0, 0, 0, 0, 1] for _ in range(5)], [1, 1, -1, 1, 1, 1, 1]]
FLAT_DIR = [[7, 6, 6, 6, 6, 6, 5], [0, 8, 8, 8, 8, 8, 4], [0, 8, 8, 8, 8, 8, 4], [0, 8, 8, 8, 8, 8, 4], [0, 8, 8, 8, 8, 8, 4], [0, 7, 6, 5, 8, 8, 4], [1, 2, 6, 2, 2, 2, 3]]
FLAT_FIXED = [[7, 6, 6, 6, 6, 6, 5], [0, 7, 6, 6, 6, 5, 4], [0, 7, 7, 6, 5, 5, 4], [0, 7, 6, 6, 6, 5, 4], [0, 6, 6, 6, 5, 4, 4], [0, 7, 6, 5, 4, 3, 4], [1, 2, 6, 2, 2, 2, 3]]
FLAT2_Z = [[5, 4, 4, 5, 9, 7, 2, 4], [9, 3, 3, 3, 3, 3, 3, 7], [7, 3, 3, 3, 3, 3, 3, 5], [8, 3, 3, 3, 3, 3, 3, 6], [9, 3, 3, 3, 3, 3, 3, 2], [6, 3, 3, 3, 3, 3, 3, 6], [5, 3, 3, 3, 3, 3, 3, 5], [1, 8, 9, 5, 6, 6, 7, 4]]
FLAT2_DIR = [[3, 2, 2, 2, 2, 2, 2, 1], [4, 8, 8, 8, 8, 1, 2, 0], [4, 8, 8, 8, 8, 8, 8, 0], [4, 8, 8, 8, 8, 8, 7, 0], [4, 8, 8, 8, 8, 8, 0, 0], [4, 8, 8, 8, 8, 8, 1, 0], [4, 5, 8, 8, 8, 8, 8, 0], [5, 6, 6, 6, 6, 6, 6, 7]]
FLAT2_FIXED = [[3, 2, 2, 2, 2, 2, 2, 1], [4, 7, 7, 7, 0, 1, 2, 0], [4, 0, 7, 0, 1, 2, 2, 0], [4, 7, 0, 1, 7, 0, 7, 0], [4, 7, 6, 5, 0, 0, 0, 0], [4, 6, 5, 4, 1, 0, 1, 0], [4, 5, 4, 3, 1, 1, 2, 0], [5, 6, 6, 6, 6, 6, 6, 7]]

FDR1 = [[2, 2, 2, 2, 2, 2, 2], [1, 2, 3, 1, 1, 2, 3], [2, 2, 2, 1, 2, 2, 3], [2, 2, 3, 4, 2, 3, 3], [4, 2, 2, 3, 3, 4, 4], [3, 3, 7, 0, 2, 3, 4], [3, 7, 0, 1, 2, 2, 4]]
ACC1 = [[1, 27, 1, 1, 2, 11, 1], [3, 21, 2, 1, 5, 4, 1], [2, 20, 1, 1, 3, 2, 1], [1, 2, 17, 14, 1, 1, 1], [2, 1, 1, 1, 13, 2, 1], [1, 1, 1, 1, 6, 4, 1], [1, 1, 1, 3, 1, 2, 1]]
FDR2 = [[4, 6, 4, 4, 5, 5], [5, 4, 4, 4, 5, 5], [6, 5, 4, 4, 4, 5], [5, 6, 5, 4, 4, 4], [6, 5, 6, 5, 4, 6], [5, 6, 5, 6, 5, 4]]
ACC2 = [[1, 3, 2, 1, 1, 1], [8, 7, 3, 2, 2, 1], [1, 7, 6, 5, 2, 1], [9, 1, 5, 4, 3, 1], [1, 7, 1, 2, 1, 1], [9, 1, 4, 1, 3, 2]]
FDR3 = [[5, 5, 6, 5, 5, 6], [5, 6, 5, 5, 6, 5], [6, 5, 5, 6, 5, 6], [5, 5, 6, 5, 6, 5], [5, 6, 5, 6, 5, 5], [6, 5, 6, 5, 5, 5]]
ACC3 = [[1, 1, 1, 1, 1, 1], [2, 1, 3, 2, 1, 2], [1, 5, 3, 1, 4, 1], [7, 4, 1, 6, 1, 2], [5, 1, 8, 1, 4, 1], [1, 10, 1, 6, 2, 1]]

PIT = [[33, 15, 34, 29, 17], [35, 13, 47, 19, 14], [21, 27, 13, 11, 44], [45, 34, 28, 20, 30], [46, 46, 15, 48, 23]]
HOLES = [[-9999, 20, 30, 40, 50], [10, 20, 30, 40, 50], [10, 20, -9999, 40, 50], [10, 20, 30, 40, 50], [10, 20, 30, 40, 50]]


def meta(values, **more):
    return GridMeta(len(values), len(values[0]), **more)


@pytest.mark.parametrize("size", [2, 512])
def test_direction(spark, size):
    got = dense(direction.d8(grid(spark, DEM, "z", "float"), size), "dir", (5, 5))
    assert (got == np.array(FLOW)).all()


def test_pits(spark):
    z = [[2] * 5, [-1, 2, 2, 2, 2], [2, 2, 0, 2, 2], [2] * 5, [2] * 5]
    assert [(r.row, r.col) for r in direction.pits(grid(spark, z, "z", "double"), 2).collect()] == [(2, 2)]


@pytest.mark.parametrize("flat_cells", [5, 1000])
@pytest.mark.parametrize("size", [2, 3, 512])
@pytest.mark.parametrize(("z", "fdr", "fixed"), [(FLAT_Z, FLAT_DIR, FLAT_FIXED), (FLAT2_Z, FLAT2_DIR, FLAT2_FIXED)])
def test_flats(spark, z, fdr, fixed, size, flat_cells):
    got = direction.resolve_flats(grid(spark, z, "z", "double"), grid(spark, fdr, "dir", "tinyint"), meta(z), size, flat_cells)
    assert (dense(got, "dir", np.shape(z)) == np.array(fixed)).all()


def test_flat_mask(spark):
    got = dense(direction.flat_mask(grid(spark, FLAT_Z, "z", "double"), grid(spark, FLAT_DIR, "dir", "tinyint"), meta(FLAT_Z), 3), "mask", (7, 7))
    assert (got[1, 1:6] == 1073741832).all() and got[3, 3] == 1073741826


@pytest.mark.parametrize("size", [2, 5, 512])
@pytest.mark.parametrize("driver_edges", [0, 1000])
def test_fill(spark, size, driver_edges):
    want = np.array(PIT, float)
    want[1, 1] = want[2, 2] = want[2, 3] = 14
    assert (dense(fill.fill(grid(spark, PIT, "z", "double"), meta(PIT), False, size, driver_edges), "z", (5, 5)) == want).all()


@pytest.mark.parametrize("size", [2, 512])
def test_fill_holes(spark, size):
    dem, m = grid(spark, HOLES, "z", "double", -9999), meta(HOLES)
    want = np.where(np.array(HOLES) == -9999, np.nan, np.array(HOLES, float))
    np.testing.assert_array_equal(dense(fill.fill(dem, m, False, size), "z", (5, 5)), want)
    want[2, 2] = 20
    np.testing.assert_array_equal(dense(fill.fill(dem, m, True, size), "z", (5, 5)), want)


def brute_fill(z):
    import heapq

    h, w = z.shape
    out = np.full(z.shape, np.inf)
    heap = [(z[r, c], r, c) for r in range(h) for c in range(w) if r in (0, h - 1) or c in (0, w - 1)]
    for v, r, c in heap:
        out[r, c] = v
    heapq.heapify(heap)
    while heap:
        v, r, c = heapq.heappop(heap)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                if 0 <= r + a < h and 0 <= c + b < w and out[r + a, c + b] == np.inf:
                    out[r + a, c + b] = max(v, z[r + a, c + b])
                    heapq.heappush(heap, (out[r + a, c + b], r + a, c + b))
    return out


def test_random_terrain(spark):
    """Fill against a heap; then every cell drains, and outlets receive every cell."""
    z = np.random.default_rng(5).integers(0, 12, (23, 31)).astype(float)
    m = GridMeta(23, 31)
    want = brute_fill(z)
    filled = {size: dense(fill.fill(grid(spark, z.tolist(), "z", "double"), m, False, size), "z", z.shape) for size in (4, 7, 512)}
    for got in filled.values():
        assert (got == want).all()
    dem = grid(spark, want.tolist(), "z", "double")
    one, two = (dense(direction.flow_direction(dem, m, True, size), "dir", z.shape) for size in (5, 512))
    assert (one == two).all() and one.max() < 8
    fdr = grid(spark, one.astype(int).tolist(), "dir", "tinyint")
    acc = {size: dense(accumulation(fdr, m, size), "acc", z.shape) for size in (4, 512)}
    assert (acc[4] == acc[512]).all()
    from talweg.grid import STEPS

    outlets = [(r, c) for r in range(23) for c in range(31) if not (0 <= r + STEPS[int(one[r, c])][0] < 23 and 0 <= c + STEPS[int(one[r, c])][1] < 31)]
    assert sum(acc[4][r, c] for r, c in outlets) == z.size


@pytest.mark.parametrize("size", [2, 3, 5, 512])
@pytest.mark.parametrize(("fdr", "acc"), [(FDR1, ACC1), (FDR2, ACC2), (FDR3, ACC3)])
def test_accumulation(spark, fdr, acc, size):
    got = dense(accumulation(grid(spark, fdr, "dir", "tinyint"), meta(fdr), size), "acc", np.shape(fdr))
    assert (got == np.array(acc)).all()


def test_accumulation_nodata(spark):
    fdr = [list(r) for r in FDR1]
    fdr[0][1] = 9
    got = dense(accumulation(grid(spark, fdr, "dir", "tinyint"), meta(fdr), 3), "acc", (7, 7))
    want = np.array(ACC1, float)
    want[0, 1] = np.nan
    np.testing.assert_array_equal(got, want)


def test_cycle_ends(spark):
    fdr = [[0, 4, 4], [0, 0, 0]]
    got = network.basins(grid(spark, fdr, "dir", "tinyint"), meta(fdr), size=1)[0]
    assert dense(got, "basin_id", (2, 3)).tolist() == [[0, 0, 0], [6, 6, 6]]


@pytest.mark.parametrize("size", [2, 512])
def test_basins(spark, size):
    fdr = [[3, 4, 0, 1], [2, 3, 1, 2], [6, 5, 7, 6], [5, 4, 0, 7]]
    got, graph = network.basins(grid(spark, fdr, "dir", "tinyint"), meta(fdr), size=size)
    assert dense(got, "basin_id", (4, 4)).tolist() == [[1, 1, 4, 4], [1, 1, 4, 4], [13, 13, 16, 16], [13, 13, 16, 16]]
    assert graph.count() == 0


@pytest.mark.parametrize("size", [2, 3, 512])
def test_basins_of_points(spark, size):
    fdr = [[7, 7, 6, 5, 5]] * 4 + [[0, 0, 6, 4, 4]]
    m = meta(fdr)
    points = spark.createDataFrame([(1, 2, 2), (2, 3, 2)], "fid long, row long, col long")
    got, graph = network.basins(grid(spark, fdr, "dir", "tinyint"), m, points, size=size)
    assert dense(got, "basin_id", (5, 5)).tolist() == [[13] * 5, [13] * 5, [18, 13, 13, 13, 18], [23, 18, 13, 18, 23], [23, 23, 18, 23, 23]] or dense(got, "basin_id", (5, 5)).tolist() == [[13, 13, 13, 13, 13], [18, 13, 13, 13, 18], [23, 18, 13, 18, 23], [23, 23, 18, 23, 23], [23, 23, 23, 23, 23]]
    assert {(r.basin_id, r.ds_basin_id) for r in graph.collect()} == {(13, 18), (18, 23)}
    out = {(r.fid, r.basin_id, r.ds_basin_id) for r in network.update_points(points, got, graph, m).collect()}
    assert out == {(1, 13, 18), (2, 18, 0)}
    assert network.basin_polygons(got, graph, m).count() == 3


def test_sides_between_basins_are_found_by_tile(spark):
    """Only sides where labels meet are rows, not four a cell; those that bound a basin and its upstream are as counted cell by cell."""
    labels = np.random.default_rng(2).integers(0, 5, (12, 14)).repeat(2, 0).repeat(2, 1)
    down = {1: 2, 2: 4, 3: 4}
    graph = spark.createDataFrame(list(down.items()), "basin_id long, ds_basin_id long")
    assert {tuple(r) for r in network.downstream_basins(graph).collect()} == {(1, 2), (1, 4), (2, 4), (3, 4)}
    want = set()
    for basin, parts in {1: [1], 2: [1, 2], 3: [3], 4: [1, 2, 3, 4]}.items():
        inside = np.pad(np.isin(labels, parts), 1)
        for r, c in np.argwhere(inside).tolist():
            beside = {(-1, 0): (0, 0, 0, 1), (0, 1): (0, 1, 1, 1), (1, 0): (1, 1, 1, 0), (0, -1): (1, 0, 0, 0)}
            want |= {(basin, r - 1 + a, c - 1 + b, r - 1 + x, c - 1 + y) for (i, j), (a, b, x, y) in beside.items() if not inside[r + i, c + j]}
    for size in (5, 512):
        edges = network.basin_polygon_edges(grid(spark, labels.tolist(), "basin_id", "long"), graph, size=size)
        assert "Generate" not in edges._jdf.queryExecution().toString()
        got = [tuple(r) for r in edges.collect()]
        assert len(got) == len(want) and set(got) == want
    only = network.basin_polygon_edges(grid(spark, labels.tolist(), "basin_id", "long"), graph, spark.createDataFrame([(2,)], "basin_id long"))
    assert {tuple(r) for r in only.collect()} == {e for e in want if e[0] == 2}


LENGTH = [
    ([[4, 4, 4, 4, 4], [0, 0, 0, 0, 2], [2, 4, 4, 4, 4], [0, 0, 0, 0, 2], [2, 4, 4, 4, 4]], [(1, 0, 0)], [[0, 10, 20, 30, 40], [90, 80, 70, 60, 50], [100, 110, 120, 130, 140], [190, 180, 170, 160, 150], [200, 210, 220, 230, 240]]),
    ([[0, 0, 0, 0, 9]], [(1, 0, 4)], [[40, 30, 20, 10, 0]]),
    ([[9, 4, 4, 0, 0, 9]], [(1, 0, 0), (2, 0, 5)], [[0, 10, 20, 20, 10, 0]]),
]


@pytest.mark.parametrize("size", [2, 512])
@pytest.mark.parametrize(("fdr", "points", "want"), LENGTH)
def test_flow_length(spark, fdr, points, want, size):
    m = meta(fdr, gt=(0, 10, 0, 50, 0, -10))
    got = network.flow_length(grid(spark, fdr, "dir", "tinyint"), m, spark.createDataFrame(points, "fid long, row long, col long"), size)
    np.testing.assert_allclose(dense(got, "dist", np.shape(fdr)), want)


@pytest.mark.parametrize("size", [2, 512])
def test_longest_paths(spark, size):
    fdr = [[6] * 6, [6] * 6, [6] * 6, [6, 5, 6, 6, 7, 6], [9, 4, 4, 0, 0, 9]]
    m = meta(fdr, gt=(0, 10, 0, 50, 0, -10))
    points = spark.createDataFrame([(1, 4, 0), (2, 4, 5), (3, 3, 2)], "fid long, row long, col long")
    f = grid(spark, fdr, "dir", "tinyint")
    k = 10 * 2**0.5
    want = [[40, k + 30, 30, 60, k + 30, 40], [30, k + 20, 20, 50, k + 20, 30], [20, k + 10, 10, 40, k + 10, 20], [10, k, 0, 30, k, 10], [0, 10, 20, 20, 10, 0]]
    np.testing.assert_allclose(dense(network.flow_length(f, m, points, size), "dist", (5, 6)), want)
    paths = network.longest_flow_paths(f, m, points, size=size)
    lines = {r.dp_id: [(c.x, c.y) for c in r.coords] for r in network.flow_path_lines(f, m, paths, size).collect()}
    cells = {k: [(int((50 - y) // 10), int(x // 10)) for x, y in v] for k, v in lines.items()}
    assert cells[1] == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 2), (4, 1), (4, 0)]
    assert cells[2] == [(0, 3), (1, 3), (2, 3), (3, 3), (4, 3), (4, 4), (4, 5)]
    assert cells[3] == [(0, 2), (1, 2), (2, 2), (3, 2)]


def test_paths_to_one_outlet_are_no_group(spark):
    """All paths end in one place; they are laid out tile by tile and equal those walked cell by cell."""
    rng = np.random.default_rng(3)
    fdr = rng.choice([2, 1, 3], (24, 30))
    fdr[:, 0], fdr[:, -1] = 2, 3
    fdr[0], fdr[0, 0] = 4, 8
    m, f = meta(fdr.tolist(), gt=(0, 10, 0, 0, 0, -10)), grid(spark, fdr.tolist(), "dir", "int")
    spots = {(int(i // 30), int(i % 30)): n for n, i in enumerate(rng.choice(720, 60, False))} | {(0, 0): 60}
    points = spark.createDataFrame([(n, r, c) for (r, c), n in spots.items()], "fid long, row long, col long")
    paths = network.longest_flow_paths(f, m, points, size=8).persist()
    want = {}
    for p in paths.collect():
        line = [(p.start_row, p.start_col)]
        while line[-1] != (p.row, p.col):
            dr, dc = STEPS[fdr[line[-1]]]
            line.append((line[-1][0] + dr, line[-1][1] + dc))
        want[p.fid] = line
    assert len(want) == 61 and max(map(len, want.values())) > 24
    for size in (4, 512):
        lines = network.flow_path_lines(f, m, paths, size)
        assert "Pandas" not in lines._jdf.queryExecution().toString()
        assert {r.dp_id: [(int(-c.y // 10), int(c.x // 10)) for c in r.coords] for r in lines.collect()} == want


@pytest.mark.parametrize("size", [2, 512])
def test_streams(spark, size):
    fac, fdr, m = grid(spark, ACC2, "acc", "long"), grid(spark, FDR2, "dir", "tinyint"), meta(FDR2)
    assert network.stream_cells(fac, 5).count() == (np.array(ACC2) >= 5).sum()
    lines, junctions = network.streams(fac, fdr, m, 5, size)
    # every stream cell lies on one line before that line's end, and lines end in nodes or at the edge
    body = [tuple(c) for r in lines.collect() for c in r.cells]
    assert {c for c in body} >= {(r, c) for r in range(6) for c in range(6) if ACC2[r][c] >= 5}
    assert junctions.count() >= 1 and lines.count() >= 1


def test_snap(spark):
    points = spark.createDataFrame([(1, 0, 0), (2, 3, 3)], "fid long, row long, col long")
    got = network.snap_points(points, grid(spark, ACC2, "acc", "long"), 2)
    assert {(r.fid, r.row, r.col) for r in got.collect()} == {(1, 1, 0), (2, 1, 1)}
    assert network.snap_points(points, grid(spark, ACC2, "acc", "long"), 1) is points


SINGLE = [[2] * 5, [-1, 2, 2, 2, 2], [2, 2, 0, 2, 2], [2] * 5, [2] * 5]


@pytest.mark.parametrize("size", [2, 512])
def test_breach_single_cell(spark, size):
    want = np.array(SINGLE, float)
    want[2, 1] = -0.5
    np.testing.assert_allclose(dense(breach.breach_single_cell(grid(spark, SINGLE, "z", "double"), size), "z", (5, 5)), want)


def _cut_in_order(z):
    """Single-cell cuts of a whole array, pit after pit."""
    z, (h, w) = np.pad(z, 3, constant_values=np.nan), z.shape
    for i, j in np.argwhere(direction.pit_mask(z)).tolist():
        own = z[i, j]
        for (a, b), (p, q) in zip(breach.RING, breach.BETWEEN, strict=True):
            far = z[i + a, j + b]
            if far <= own or np.isnan(far):
                z[i + p, j + q] = (own + (own - 2 * breach.EPSILON if np.isnan(far) else far)) / 2
    return z[3 : h + 3, 3 : w + 3]


@pytest.mark.parametrize(("levels", "nodata"), [(4, 0.0), (1000, 0.03)])
def test_touching_pits_are_cut_tile_by_tile(spark, levels, nodata, monkeypatch):
    """Pits that touch each other over the whole grid are no group of one task, and cuts are as in one run."""
    rng = np.random.default_rng(levels)
    z = np.where(rng.random((40, 90)) < nodata, np.nan, rng.integers(0, levels, (40, 90)).astype(float))

    def never(edges):
        raise AssertionError("a cluster of pits may be the whole grid")

    monkeypatch.setattr(breach, "connected", never, raising=False)
    want = _cut_in_order(z)
    assert (want < z).sum() > 200
    dem = grid(spark, np.nan_to_num(z, nan=-9999.0).tolist(), "z", "double", -9999.0)
    for size in (8, 512):
        np.testing.assert_array_equal(dense(breach.breach_single_cell(dem, size), "z", z.shape), want)


@pytest.mark.parametrize("size", [2, 512])
@pytest.mark.parametrize(
    ("changes", "want"),
    [
        ({(0, 3): -2}, {(1, 3): -4 / 3, (2, 3): -2 / 3}),
        ({(0, 3): None}, {(1, 3): -2e-5, (2, 3): -1e-5}),
    ],
)
def test_breach(spark, changes, want, size):
    z = [[2.0] * 7 for _ in range(7)]
    z[3][3] = 0.0
    for (r, c), v in changes.items():
        z[r][c] = -9999.0 if v is None else v
    got = dense(breach.breach(grid(spark, z, "z", "double", -9999.0), 3, size=size), "z", (7, 7))
    expected = np.array([[np.nan if v == -9999 else v for v in line] for line in z])
    for cell, v in want.items():
        expected[cell] = v
    np.testing.assert_allclose(got, expected, rtol=1e-6)


def test_level_path_stays():
    """Cells of a least-cost path at the pit's own level are not cut."""
    z = np.full((7, 7), 2.0)
    z[1:4, 3], z[0, 3] = 0.0, -2.0
    assert breach.least_cost_cuts(z, 3, 3, 3) == [(0, 3, -2.0)]


def test_breach_is_tile_invariant_and_only_lowers(spark):
    z = np.random.default_rng(0).uniform(1, 10, (20, 24))
    dem = grid(spark, z.tolist(), "z", "double")
    one, two = (dense(breach.breach(dem, 4, size=s), "z", z.shape) for s in (5, 512))
    assert (one == two).all() and (one <= z).all() and (one < z).any()
    with pytest.raises(ValueError):
        breach.breach(dem, 0)


def test_least_cost_breach_makes_no_clusters(spark, monkeypatch):
    """Its first step are the single-cell cuts, of which no group of touching pits is one task."""
    monkeypatch.setattr(breach, "connected", None, raising=False)
    z = np.random.default_rng(8).integers(0, 40, (24, 40)).astype(float)
    dem = grid(spark, z.tolist(), "z", "double")
    one, two = (dense(breach.breach(dem, 3, size=s), "z", z.shape) for s in (8, 512))
    assert (one == two).all() and (one <= _cut_in_order(z)).all()


def test_haversine():
    rad = np.radians
    assert abs(network.haversine(0, 0, rad(1.0), 0) / 111195 - 1) < 0.01
    assert 230e3 < network.haversine(rad(45.5), rad(-122.7), rad(47.6), rad(-122.3)) < 240e3
    m = GridMeta(100, 100, (-120.0, 0.01, 0.0, 46.0, 0.0, -0.01), "EPSG:4326", True)
    east, south = (float(network.step_length_of(m)(np.array([0]), np.array([d]))[0]) for d in (0, 6))
    assert 700 < east < 850 and 1000 < south < 1200


def test_geographic_flow_length(spark):
    m = GridMeta(1, 4, (-120.0, 0.01, 0.0, 46.0, 0.0, -0.01), "EPSG:4326", True)
    points = spark.createDataFrame([(1, 0, 3)], "fid long, row long, col long")
    got = dense(network.flow_length(grid(spark, [[0, 0, 0, 0]], "dir", "tinyint"), m, points, 2), "dist", (1, 4))[0]
    np.testing.assert_allclose(np.diff(got), -got[2], rtol=1e-9)
    paths = network.longest_flow_paths(grid(spark, [[0, 0, 0, 0]], "dir", "tinyint"), m, points, size=2).first()
    assert (paths.start_row, paths.start_col) == (0, 0) and abs(paths.length - got[0]) < 1e-6


def test_coordinates(spark):
    from pyspark.sql import functions as F

    from talweg.grid import cell_xy, nodata_to_null, xy_cell

    m = GridMeta(10, 10, (100.0, 2.0, 0.0, 50.0, 0.0, -2.0))
    df = spark.createDataFrame([(3, 4)], "row long, col long")
    x, y = cell_xy(m, F.col("row"), F.col("col"))
    assert tuple(df.select(x, y).first()) == (109.0, 43.0)
    r, c = xy_cell(m, F.lit(109.0), F.lit(43.0))
    assert tuple(df.select(r, c).first()) == (3, 4)
    with pytest.raises(ValueError):
        xy_cell(GridMeta(1, 1, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)), F.lit(0.0), F.lit(0.0))
    odd = spark.createDataFrame([(float("nan"),), (-1.0,), (2.0,)], "z double")
    assert [v.z for v in nodata_to_null(odd, "z", -1.0).collect()] == [None, None, 2.0]


def test_drainage_cells(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.6, 0.4), (3, 99.0, 0.0), (4, None, 1.0)], "fid long, x double, y double")
    assert [tuple(r) for r in network.drainage_cells(points, GridMeta(3, 3)).collect()] == [(2, 0, 0)]


def test_result_does_not_depend_on_partitions(spark):
    z = np.random.default_rng(9).integers(0, 30, (25, 25)).astype(float).tolist()
    out = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(dense(direction.flow_direction(fill.fill(grid(spark, z, "z", "double").repartition(int(n)), GridMeta(25, 25), size=8), GridMeta(25, 25), size=8), "dir", (25, 25)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (out[0] == out[1]).all()
