"""D8 flow direction, pits and flats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.grid import NODATA, STEPS, UNDEFINED, GridMeta
from talweg.plans.session import cut
from talweg.plans.tiles import TILE, Tile, neighbour, tile_map
from talweg.plans.unionfind import connected

LENGTH = [float(np.hypot(r, c)) for r, c in STEPS]
#: Cells of a flat that are resolved in one group; larger flats go by tiles in rounds.
FLAT_CELLS = 4_000_000
#: Added to cells that a gradient away from higher terrain reaches.
FLAT_BASE = (2**31 - 1) // 2


def d8_of(z: np.ndarray) -> np.ndarray:
    """Codes of a padded elevation array in which NaN is nodata."""
    best, code = np.zeros(z.shape), np.full(z.shape, UNDEFINED, np.int8)
    for d in range(8):
        slope = (z - neighbour(z, d, np.nan)) / LENGTH[d]
        slope[np.isnan(slope)] = np.inf  # a neighbour without data takes the flow
        steeper = slope > best
        best[steeper], code[steeper] = slope[steeper], d
    code[np.isnan(z)] = NODATA
    return code


def d8(dem: DataFrame, size: int = TILE) -> DataFrame:
    """(row, col, dir) of (row, col, z): steepest descent, lowest code of equal slopes."""

    def kernel(t: Tile) -> dict[str, np.ndarray]:
        return {"row": t.rows, "col": t.cols, "dir": t.own(d8_of(t.data["z"]))}

    return tile_map(_double(dem), ["z"], kernel, "row long, col long, dir tinyint", 1, size)


def _double(dem: DataFrame) -> DataFrame:
    return dem.select("row", "col", F.col("z").cast("double").alias("z"))


def pit_mask(z: np.ndarray) -> np.ndarray:
    """Cells below or level with all neighbours, all of which have data and not all of which are level."""
    low, level = ~np.isnan(z), np.ones(z.shape, bool)
    for d in range(8):
        n = neighbour(z, d, np.nan)
        with np.errstate(invalid="ignore"):
            low &= n >= z  # false for nodata
            level &= n == z
    return low & ~level


def pits(dem: DataFrame, size: int = TILE) -> DataFrame:
    """(row, col, z) of the single-cell pits."""

    def kernel(t: Tile) -> dict[str, np.ndarray]:
        at = t.own(pit_mask(t.data["z"]))
        return {"row": t.rows[at], "col": t.cols[at], "z": t.own(t.data["z"])[at]}

    return tile_map(_double(dem), ["z"], kernel, "row long, col long, z double", 1, size)


def local_components(mask: np.ndarray, z: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each masked cell's 8-connected, level component within an array."""
    h, w = mask.shape
    flat = np.arange(h * w).reshape(h, w)
    label = np.where(mask, flat, h * w)
    joins = []
    for d in range(8):
        with np.errstate(invalid="ignore"):
            joins.append(mask & neighbour(mask, d, False) & (neighbour(z, d, np.nan) == z))
    while True:
        new = label.copy()
        for d in range(8):
            n = neighbour(label, d, h * w)
            np.copyto(new, np.minimum(new, n), where=joins[d])
        at = new.ravel()
        hop = np.append(at, h * w)[at].reshape(h, w)  # jump to the label's own label
        new = np.where(mask, np.minimum(new, hop), h * w)
        if (new == label).all():
            return np.where(mask, np.append(ids.ravel(), -1)[new], -1)
        label = new


def flat_cells(dem: DataFrame, fdr: DataFrame, meta: GridMeta, size: int = TILE) -> DataFrame:
    """Undefined cells with what their flat needs: part, high, low (bits of directions with a low edge), out, bonds.

    ``out`` is the first direction that leaves the data, ``bonds`` the bits of directions to level undefined
    neighbours, ``part`` the least cell number of the component within the tile.
    """
    both = dem.select("row", "col", F.col("z").cast("double").alias("z")).join(fdr.select("row", "col", F.col("dir").cast("int").alias("dir")), ["row", "col"])

    def kernel(t: Tile) -> dict[str, np.ndarray]:
        z, code = t.data["z"], np.where(t.present, t.data["dir"], NODATA)
        flat = code == UNDEFINED
        high, low, bonds = np.zeros(z.shape, bool), np.zeros(z.shape, np.int64), np.zeros(z.shape, np.int64)
        out = np.full(z.shape, -1)
        for d in reversed(range(8)):
            n, c = neighbour(z, d, np.nan), neighbour(code, d, NODATA)
            with np.errstate(invalid="ignore"):
                high |= flat & (c != NODATA) & (n > z)
                level = n == z
            low |= np.where(flat & level & (c < UNDEFINED), 1 << d, 0)
            bonds |= np.where(flat & level & (c == UNDEFINED), 1 << d, 0)
            out[c == NODATA] = d
        part = local_components(flat & t.core, z, t.ids(meta.ncols))
        at = t.own(flat)
        pick = lambda a: t.own(a)[at]
        return {"row": t.rows[at], "col": t.cols[at], "part": pick(part), "high": pick(high), "low": pick(low), "out": pick(out), "bonds": pick(bonds)}

    return tile_map(both, ["z", "dir"], kernel, "row long, col long, part long, high boolean, low int, out int, bonds int", 1, size)


def _distances(n: int, start: np.ndarray, near: np.ndarray, first: int) -> np.ndarray:
    """Breadth-first levels from start cells; near is (n, 8) neighbour numbers, -1 for none; 0 is unreached."""
    level = np.zeros(n, np.int64)
    front, k = np.flatnonzero(start), first
    level[front] = k
    while len(front):
        nxt = near[front].ravel()
        nxt = np.unique(nxt[nxt >= 0])
        front = nxt[level[nxt] == 0]
        k += 1
        level[front] = k
    return level


def flat_levels(row: np.ndarray, col: np.ndarray, high: np.ndarray, low: np.ndarray, bonds: np.ndarray, ncols: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask, near): the combined gradient of one flat, towards lower and away from higher terrain."""
    ids = row * ncols + col
    order = np.argsort(ids)
    near = np.full((len(ids), 8), -1)
    for d, (dr, dc) in enumerate(STEPS):
        has = np.flatnonzero(bonds >> d & 1)
        near[has, d] = order[np.searchsorted(ids[order], ids[has] + dr * ncols + dc)]
    away = _distances(len(ids), high, near, 1)
    lower = _distances(len(ids), low > 0, near, 2)  # a low edge itself has level 1
    mask = np.where(lower > 0, 2 * lower + np.where(away > 0, FLAT_BASE - away, 0), -away)
    return mask, near


def flat_mask(dem: DataFrame, fdr: DataFrame, meta: GridMeta, size: int = TILE, flat_cells: int = FLAT_CELLS) -> DataFrame:
    """(row, col, mask) of undefined cells."""
    return _by_flat(dem, fdr, meta, size, False, flat_cells)


def resolve_flats(dem: DataFrame, fdr: DataFrame, meta: GridMeta, size: int = TILE, flat_cells: int = FLAT_CELLS) -> DataFrame:
    """Directions with those of flat cells filled in from their masks.

    A flat cell next to nodata or the raster's edge drains there; else to the level
    neighbour with the least (mask difference / distance), lowest code first.
    """
    fixed = _by_flat(dem, fdr, meta, size, True, flat_cells)
    return fdr.filter(F.col("dir") != UNDEFINED).select("row", "col", F.col("dir").cast("tinyint").alias("dir")).unionByName(fixed)


def _by_flat(dem: DataFrame, fdr: DataFrame, meta: GridMeta, size: int, directions: bool, most: int) -> DataFrame:
    cells = cut(flat_cells(dem, fdr, meta, size))
    # components that cross a tile border are joined by the bonds of border cells
    border = cells.filter((F.col("row") % size == 0) | (F.col("row") % size == size - 1) | (F.col("col") % size == 0) | (F.col("col") % size == size - 1))
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(1 << d).alias("bit")) for d, (r, c) in enumerate(STEPS)))
    ahead = border.select("row", "col", "part", "bonds", F.explode(steps).alias("s")).filter(F.col("bonds").bitwiseAND(F.col("s.bit")) != 0)
    ahead = ahead.select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), F.col("part").alias("a"))
    edges = ahead.join(border.select("row", "col", F.col("part").alias("b")), ["row", "col"]).filter("a != b").select("a", "b")
    roots = connected(edges)
    cells = cells.join(roots, cells["part"] == roots["node"], "left").withColumn("flat", F.coalesce("root", "part")).drop("node", "root", "part")

    sizes = cells.groupBy("flat").count().filter(F.col("count") > most).select("flat")
    large = cut(sizes)  # few: each stands for more than ``most`` cells
    if large.isEmpty():
        return cells.groupBy("flat").applyInArrow(_resolver(meta.ncols, directions), _result(directions))
    small = cells.join(large, "flat", "left_anti").groupBy("flat").applyInArrow(_resolver(meta.ncols, directions), _result(directions))
    return small.unionByName(_large_flats(cells.join(large, "flat", "left_semi"), meta, size, directions))


def _result(directions: bool) -> str:
    return f"row long, col long, {'dir tinyint' if directions else 'mask long'}"


def _resolver(ncols: int, directions: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        row, col, low, bonds, out = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col", "low", "bonds", "out"))
        high = table.column("high").to_numpy(zero_copy_only=False)
        mask, near = flat_levels(row, col, high, low, bonds, ncols)
        if not directions:
            return pa.table({"row": row, "col": col, "mask": mask})
        theirs = np.where(near >= 0, mask[near], 2)
        return pa.table({"row": row, "col": col, "dir": _masked_direction(mask, theirs, near >= 0, low, out)})

    return run


def _masked_direction(mask: np.ndarray, theirs: np.ndarray, bonded: np.ndarray, low: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Directions of flat cells; ``theirs`` (n, 8) are level undefined neighbours' masks where ``bonded``.

    A low edge's mask is 2; a level neighbour that is neither cannot exist.
    """
    best, code = np.full(len(mask), np.inf), np.full(len(mask), UNDEFINED)
    for d in range(8):
        edge = low >> d & 1 == 1
        slope = np.where(bonded[:, d] | edge, (np.where(bonded[:, d], theirs[:, d], 2) - mask).astype(float) / LENGTH[d], np.inf)
        less = slope < best
        best[less], code[less] = slope[less], d
    return np.where(out >= 0, out, code).astype(np.int8)


def _tile_distances(seed: np.ndarray, bonds: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Least level of each core cell from seeds (0: none) of any level, along bonds; seeds outside the core count."""
    far = np.iinfo(np.int64).max // 2
    level = np.where(seed > 0, seed, far)
    while True:
        new = level.copy()
        for d in range(8):
            step = neighbour(level, d, far) + 1
            np.minimum(new, np.where(core & (bonds >> d & 1 == 1), step, far), out=new)
        if (new == level).all():
            return np.where(level < far, level, 0)
        level = new


def _large_flats(cells: DataFrame, meta: GridMeta, size: int, directions: bool) -> DataFrame:
    """The same for flats of any size: tiles find distances and hand those of their border cells to their neighbours.

    A round is a pass over the flats' tiles; there are about as many as tiles across a flat.
    """
    cells = cut(cells.select("row", "col", F.col("high").cast("int").alias("high"), "low", "out", "bonds", F.lit(0).cast("long").alias("away"), F.lit(0).cast("long").alias("down")))

    def spread(t: Tile) -> dict[str, np.ndarray]:
        d = t.data
        away = _tile_distances(np.where(d["away"] > 0, d["away"], np.where(d["high"] > 0, 1, 0)), d["bonds"], t.core)
        down = _tile_distances(np.where(d["down"] > 0, d["down"], np.where(d["low"] > 0, 2, 0)), d["bonds"], t.core)
        changed = t.own((away != d["away"]) | (down != d["down"]))
        return {"row": t.rows, "col": t.cols, **{c: t.own(d[c]) for c in ("high", "low", "out", "bonds")}, "away": t.own(away), "down": t.own(down), "changed": changed}

    values = ["high", "low", "out", "bonds", "away", "down"]
    schema = "row long, col long, high int, low int, out int, bonds int, away long, down long, changed boolean"
    while True:
        now = cut(tile_map(cells, values, spread, schema, 1, size))
        if not now.filter("changed").limit(1).count():
            break
        cells = now.drop("changed")

    def finish(t: Tile) -> dict[str, np.ndarray]:
        d = t.data
        mask = np.where(d["down"] > 0, 2 * d["down"] + np.where(d["away"] > 0, FLAT_BASE - d["away"], 0), -d["away"])
        if not directions:
            return {"row": t.rows, "col": t.cols, "mask": t.own(mask)}
        theirs = np.stack([t.own(neighbour(mask, k, 0)) for k in range(8)], axis=1)
        bonded = np.stack([t.own(d["bonds"]) >> k & 1 == 1 for k in range(8)], axis=1)
        return {"row": t.rows, "col": t.cols, "dir": _masked_direction(t.own(mask), theirs, bonded, t.own(d["low"]), t.own(d["out"]))}

    return tile_map(cells, values, finish, _result(directions), 1, size)


def flow_direction(dem: DataFrame, meta: GridMeta, flats: bool = True, size: int = TILE) -> DataFrame:
    """D8 directions with flats resolved."""
    fdr = d8(dem, size)
    return resolve_flats(dem, cut(fdr), meta, size) if flats else fdr
