"""Flow graphs: every cell has at most one successor.

Each tile contracts its paths by pointer doubling on arrays, and only cells that flow
enters from another tile become nodes of a graph between tiles.  That graph, a few cells
of each tile's border, is solved by pointer doubling with joins; a last pass
finishes each tile.  Rounds are bounded, so cycles end and are reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.grid import NODATA, STEPS, UNDEFINED, GridMeta
from talweg.plans.session import cut
from talweg.plans.tiles import TILE, Tile, in_tiles, neighbour, tile_join, tile_map

#: Rounds of the graph between tiles; 2**MAX_ROUNDS border crossings.
MAX_ROUNDS = 40


def successors(t: Tile, stop: np.ndarray, into_stops: bool = False, into_undefined: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the next cell or own place, place of a next cell in another tile or -1, direction used or -1).

    Flow ends at stops, undefined and nodata cells, before nodata, and at the
    raster's edge.  With ``into_stops`` it enters stops without a direction; without
    ``into_undefined`` it ends before other undefined cells.
    """
    h, w = t.shape
    flat = np.arange(h * w).reshape(h, w)
    code = np.where(t.present, t.data["dir"], NODATA)
    nxt, exit_, used = flat.copy(), np.full((h, w), -1), np.full((h, w), -1)
    for d in range(8):
        ok = neighbour(code, d, NODATA) < (NODATA if into_undefined else UNDEFINED)
        if into_stops:
            ok |= neighbour(stop & t.present, d, False)
        go = t.core & (code == d) & ~stop & ok
        to = flat + STEPS[d][0] * w + STEPS[d][1]
        inside = neighbour(t.core, d, False)
        nxt = np.where(go & inside, to, nxt)
        exit_ = np.where(go & ~inside, to, exit_)
        used = np.where(go, d, used)
    return nxt.ravel(), exit_.ravel(), used.ravel()


def contract(nxt: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last place, sum of weights up to it, steps) of each place's path in the tile.

    Places on or before a cycle are left with the place where the rounds ended.
    """
    at, total, steps = nxt.copy(), np.zeros(len(nxt)) if weight is None else np.where(nxt == np.arange(len(nxt)), 0.0, weight), (nxt != np.arange(len(nxt))).astype(np.int64)
    for _ in range(int(len(nxt)).bit_length() + 1):
        hop = at[at]
        if (hop == at).all():
            break
        total, steps = total + total[at], steps + steps[at]
        at = hop
    return at, total, steps


def subtree(nxt: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The sum of ``start`` over each place and all places upstream of it in the tile."""
    n = len(nxt)
    acc, at = start.astype(np.int64).copy(), np.where(nxt == np.arange(n), n, nxt)
    for _ in range(n.bit_length() + 1):
        live = np.flatnonzero(at < n)
        if not len(live):
            break
        add = np.zeros(n, np.int64)
        np.add.at(add, at[live], acc[live])
        acc += add
        at[live] = np.append(at, n)[at[live]]
    return acc


def _ids(t: Tile, meta: GridMeta) -> np.ndarray:
    return t.ids(meta.ncols).ravel()


def double(graph: DataFrame) -> DataFrame:
    """(node, last, total, steps) of a graph (node, next, w, hops): the last node of each path and the sums.

    ``next`` is null at a last node.
    """
    now = cut(graph.select("node", F.coalesce("next", "node").alias("last"), F.when(F.col("next").isNotNull(), F.col("w")).otherwise(F.lit(0.0)).alias("total"), F.when(F.col("next").isNotNull(), F.col("hops")).otherwise(F.lit(0)).alias("steps")))
    for _ in range(min(MAX_ROUNDS, now.count().bit_length() + 1)):
        ahead = now.select(F.col("node").alias("last"), F.col("last").alias("far"), F.col("total").alias("more"), F.col("steps").alias("jumps"))
        new = now.join(ahead, "last", "left").select("node", F.coalesce("far", "last").alias("last"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("steps") + F.coalesce("jumps", F.lit(0))).alias("steps"), (F.coalesce("far", "last") != F.col("last")).alias("moved"))
        new = cut(new)
        if not new.filter("moved").limit(1).count():
            return new.drop("moved")
        now = new.drop("moved")
    return now


def accumulate_between(graph: DataFrame, inflow: DataFrame) -> DataFrame:
    """(node, amount): all that enters each node, from (node, next) and the tiles' own (node, amount).

    Doubling sums: after k rounds a node has what comes over up to 2**k nodes.
    """
    now = cut(graph.join(inflow, "node", "left").select("node", F.col("next").alias("anc"), F.coalesce("amount", F.lit(0)).alias("amount")))
    for _ in range(min(MAX_ROUNDS, now.count().bit_length() + 1)):
        if not now.filter("anc IS NOT NULL").limit(1).count():
            break
        add = now.filter("anc IS NOT NULL").groupBy(F.col("anc").alias("node")).agg(F.sum("amount").alias("more"))
        hop = now.select(F.col("node").alias("anc"), F.col("anc").alias("next"))
        now = cut(now.join(add, "node", "left").join(hop, "anc", "left").select("node", F.col("next").alias("anc"), (F.col("amount") + F.coalesce("more", F.lit(0))).alias("amount")))
    return now.select("node", "amount")


def _tiled(nodes: DataFrame, meta: GridMeta, size: int) -> DataFrame:
    rc = nodes.withColumns({"row": F.floor(F.col("node") / meta.ncols).cast("long"), "col": F.col("node") % meta.ncols})
    return in_tiles(rc, 0, size)


def accumulation(fdr: DataFrame, meta: GridMeta, size: int = TILE, weights: DataFrame | None = None) -> DataFrame:
    """(row, col, acc): cells that drain through each cell, itself included; null for nodata.

    An undefined cell does not count itself.  With ``weights`` (row, col, one), a whole number
    of each cell is summed instead, 0 where it has none.
    """
    fdr = fdr.select("row", "col", F.col("dir").cast("int").alias("dir"))
    if weights is not None:
        fdr = cut(fdr.join(weights.select("row", "col", "one"), ["row", "col"], "left").withColumn("one", F.coalesce("one", F.lit(0)).cast("long")))
    weighted = weights is not None
    names = ["dir", "one"] if weighted else ["dir"]

    def none(t: Tile) -> np.ndarray:
        return np.zeros(t.shape, bool)

    def start(t: Tile) -> np.ndarray:
        if weighted:
            return np.where(t.core, t.data["one"], 0).ravel().astype(np.int64)
        return (t.core & (t.data["dir"] < UNDEFINED)).ravel().astype(np.int64)

    def exits(t: Tile) -> dict[str, np.ndarray]:
        """What leaves the tile: by the cell it enters, and all cells that may be entered."""
        nxt, exit_, _ = successors(t, none(t))
        acc, ids = subtree(nxt, start(t)), _ids(t, meta)
        out = exit_ >= 0
        return {"node": ids[exit_[out]], "amount": acc[out]}

    def links(t: Tile, entered: pa.Table) -> dict[str, np.ndarray]:
        nxt, exit_, _ = successors(t, none(t))
        at, _, _ = contract(nxt)
        ids = _ids(t, meta)
        node = np.unique(entered.column("node").to_numpy())
        place = _places(t, node, meta)
        to = exit_[at[place]]
        return {"node": node, "next": np.where(to >= 0, ids[to], -1)}

    def finish(t: Tile, entered: pa.Table) -> dict[str, np.ndarray]:
        nxt, _, _ = successors(t, none(t))
        own = start(t)
        if entered.num_rows:
            np.add.at(own, _places(t, entered.column("node").to_numpy(), meta), entered.column("amount").to_numpy())
        acc = subtree(nxt, own).reshape(t.shape).astype(np.float64)
        acc[t.data["dir"] == NODATA] = np.nan
        return {"row": t.rows, "col": t.cols, "acc": t.own(acc)}

    inflow = cut(tile_map(fdr, names, exits, "node long, amount long", 1, size).groupBy("node").agg(F.sum("amount").alias("amount")))
    entered = inflow.select("node")
    graph = tile_join(fdr, names, _tiled(entered, meta, size), links, "node long, next long", 1, size).withColumn("next", F.when(F.col("next") >= 0, F.col("next")))
    amounts = accumulate_between(graph, inflow)
    out = tile_join(fdr, names, _tiled(amounts, meta, size), finish, "row long, col long, acc double", 1, size)
    return out.withColumn("acc", F.col("acc").cast("long"))


def _places(t: Tile, node: np.ndarray, meta: GridMeta) -> np.ndarray:
    return (node // meta.ncols - t.r0) * t.shape[1] + node % meta.ncols - t.c0


def _ways(t: Tile, length, into_stops: bool, into_undefined: bool) -> tuple[np.ndarray, ...]:
    """(last place in the tile or -1 in a cycle, place entered in another tile or -1, length, steps) of each place's path."""
    nxt, exit_, used = successors(t, t.data["stop"], into_stops, into_undefined)
    rows = (np.arange(t.shape[0])[:, None] + t.r0).repeat(t.shape[1], 1).ravel()
    step = np.where(used >= 0, length(rows, np.maximum(used, 0)), 0.0)
    at, total, steps = contract(nxt, step)
    cyclic = nxt[at] != at
    # the last step leaves the tile
    leave = np.where(cyclic, -1, exit_[at])
    total, steps = total + np.where(leave >= 0, step[at], 0.0), steps + (leave >= 0)
    return np.where(cyclic, -1, at), leave, total, steps


def node_graph(cells: DataFrame, meta: GridMeta, values: list[str], length, into_stops: bool, into_undefined: bool, size: int) -> DataFrame:
    """(node, next, w, hops, end) of cells (row, col, dir, stop): where the paths of cells that flow enters leave their tile.

    ``next`` is -1 and ``end`` the last cell where a path leaves no more; both are -1 in a cycle.  With ``spot``
    among the values, cells marked by it are nodes as well.
    """

    def exits(t: Tile) -> dict[str, np.ndarray]:
        _, exit_, _ = successors(t, t.data["stop"], into_stops, into_undefined)
        ids = _ids(t, meta)
        own = ids[(t.core & t.data["spot"]).ravel()] if "spot" in values else ids[:0]
        return {"node": np.unique(np.append(ids[exit_[exit_ >= 0]], own))}

    def links(t: Tile, entered: pa.Table) -> dict[str, np.ndarray]:
        at, leave, total, steps = _ways(t, length, into_stops, into_undefined)
        ids, node = _ids(t, meta), np.unique(entered.column("node").to_numpy())
        p = _places(t, node, meta)
        ends = leave[p] < 0
        return {"node": node, "next": np.where(ends, -1, ids[leave[p]]), "w": total[p], "hops": steps[p], "end": np.where(at[p] >= 0, ids[at[p]], -1)}

    entered = cut(tile_map(cells, values, exits, "node long", 1, size).distinct())
    return cut(tile_join(cells, values, _tiled(entered, meta, size), links, "node long, next long, w double, hops long, end long", 1, size))


def far_ends(graph: DataFrame) -> DataFrame:
    """(node, last, total, steps) of a node graph: the last cell of each node's path, -1 for a cycle, and the way to it."""
    done = double(graph.select("node", F.when(F.col("next") >= 0, F.col("next")).alias("next"), "w", "hops"))
    # the last node's own way inside its tile
    tail = graph.filter("next < 0").select(F.col("node").alias("last"), "end", F.col("w").alias("tail"), F.col("hops").alias("steps_left"))
    return cut(done.join(tail, "last", "left").select("node", F.coalesce("end", F.lit(-1)).alias("last"), (F.col("total") + F.coalesce("tail", F.lit(0.0))).alias("total"), (F.col("steps") + F.coalesce("steps_left", F.lit(0))).alias("steps")))


def lines_down(fdr: DataFrame, meta: GridMeta, ways: DataFrame, size: int = TILE) -> DataFrame:
    """(start, cells) of the numbered cells ``start`` to ``to`` of ``ways`` (start, to, most): the cells (row, col) downstream of each start.

    A line goes as far as the start's farthest ``to``, which may be undefined or nodata, or ``most`` steps where that is
    in a cycle.  Each start gets the nodes on its way by doubling jumps, and each node its cells inside its tile, so no task
    has more than one line or one tile at a time.
    """
    spots = ways.select(F.col("start").alias("id"), F.lit(False).alias("to")).unionByName(ways.select(F.col("to").alias("id"), F.lit(True).alias("to"))).groupBy("id").agg(F.max("to").alias("to"))
    cells = fdr.select("row", "col", F.col("dir").cast("int").alias("dir")).withColumn("id", meta.cell_id(F.col("row"), F.col("col"))).join(spots, "id", "left")
    cells = cut(cells.select("row", "col", "dir", F.coalesce(F.col("to") & (F.col("dir") >= UNDEFINED), F.lit(False)).alias("stop"), F.col("to").isNotNull().alias("spot")))
    values = ["dir", "stop", "spot"]
    graph = node_graph(cells, meta, values, lambda rows, d: np.ones(len(d)), True, True, size)
    far = far_ends(graph).select("node", "last", "steps")
    of = lambda name, more: far.select(F.col("node").alias(name), F.col("last").alias(f"{more}_last"), F.col("steps").alias(f"{more}_steps"))
    both = ways.join(of("start", "a"), "start").join(of("to", "b"), "to", "left")
    steps = F.col("a_steps") - F.col("b_steps")
    known = (F.col("a_last") == F.col("b_last")) & (F.col("a_last") >= 0) & (steps >= 0)
    chain = cut(both.groupBy("start").agg(F.max(F.when(known, steps).otherwise(F.col("most"))).alias("need")).select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("pos"), "need"))
    jump = graph.filter("next >= 0").select("node", "next", "hops")
    for _ in range(MAX_ROUNDS):
        more = cut(chain.join(jump, "node").select("start", F.col("next").alias("node"), (F.col("pos") + F.col("hops")).alias("pos"), "need").filter("pos <= need"))
        if not more.limit(1).count():
            break
        chain = cut(chain.unionByName(more))
        ahead = jump.select(F.col("node").alias("next"), F.col("next").alias("far"), F.col("hops").alias("more"))
        jump = cut(jump.join(ahead, "next").select("node", F.col("far").alias("next"), (F.col("hops") + F.col("more")).alias("hops")))

    def walk(t: Tile, used: pa.Table) -> dict[str, np.ndarray]:
        nxt, _, _ = successors(t, t.data["stop"], True)
        node = used.column("node").to_numpy()
        at, out = _places(t, node, meta), []
        for k in range(len(t.i)):
            out.append((node, np.full(len(node), k), at))
            on = nxt[at] != at
            node, at = node[on], nxt[at[on]]
            if not len(at):
                break
        node, k, at = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return {"node": node, "k": k, "row": at // t.shape[1] + t.r0, "col": at % t.shape[1] + t.c0}

    used = _tiled(chain.select("node").distinct(), meta, size)
    runs = tile_join(cells, values, used, walk, "node long, k long, row long, col long", 1, size)
    spot = F.struct((F.col("pos") + F.col("k")).alias("pos"), "row", "col")
    lines = chain.join(runs, "node").filter("pos + k <= need").groupBy("start").agg(F.array_sort(F.collect_list(spot)).alias("cells"))
    return lines.select("start", F.transform("cells", lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"))).alias("cells"))


def trace(fdr: DataFrame, meta: GridMeta, stops: DataFrame | None = None, step_length=None, into_stops: bool = False, into_undefined: bool = True, size: int = TILE) -> DataFrame:
    """(row, col, dir, last, dist, hops): the cell at which each cell's path ends, and the way to it.

    Paths end at the first cell of ``stops`` (row, col).  ``step_length`` gives the length of a
    step from (rows, directions); by default it counts cell sides.  ``last`` is null for
    cells that run into a cycle.
    """
    cells = fdr.select("row", "col", F.col("dir").cast("int").alias("dir"))
    if stops is None:
        cells = cells.withColumn("stop", F.lit(False))
    else:
        marks = stops.select("row", "col").distinct().withColumn("stop", F.lit(True))
        cells = cells.join(marks, ["row", "col"], "left").withColumn("stop", F.coalesce("stop", F.lit(False)))
    cells = cut(cells)
    length = step_length or (lambda rows, d: np.hypot(*np.array(STEPS, float)[d].T))
    values = ["dir", "stop"]
    far = far_ends(node_graph(cells, meta, values, length, into_stops, into_undefined, size))

    def finish(t: Tile, far: pa.Table) -> dict[str, np.ndarray]:
        at, leave, total, steps = _ways(t, length, into_stops, into_undefined)
        ids = _ids(t, meta)
        node, last = far.column("node").to_numpy(), far.column("last").to_numpy()
        order = np.argsort(node)
        node, last, more, jumps = node[order], last[order], far.column("total").to_numpy()[order], far.column("steps").to_numpy()[order]
        end, dist, hops = np.where(at >= 0, ids[at], -1), total.copy(), steps.copy()
        out = np.flatnonzero((leave >= 0) & t.core.ravel())
        if len(out):
            k = np.searchsorted(node, ids[leave[out]])
            end[out], dist[out], hops[out] = last[k], dist[out] + more[k], hops[out] + jumps[k]
        p = t.i * t.shape[1] + t.j
        return {"row": t.rows, "col": t.cols, "dir": t.own(t.data["dir"]), "last": end[p], "dist": dist[p], "hops": hops[p]}

    # every tile gets what its exits enter, so the lookup table goes to the tiles around a node
    around = in_tiles(far.withColumns({"row": F.floor(F.col("node") / meta.ncols).cast("long"), "col": F.col("node") % meta.ncols}), 1, size)
    out = tile_join(cells, values, around, finish, "row long, col long, dir int, last long, dist double, hops long", 1, size)
    return out.withColumn("last", F.when(F.col("last") >= 0, F.col("last")))
