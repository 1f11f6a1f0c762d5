"""Edges of a cell grid, least-cost fields by distributed relaxation, and the routes through them.

Many independent grids (``zone``) are solved together. ``least_cost`` relaxes cell by cell: a round joins the improved cells with
the edge table and takes one ``min`` per cell of the state. ``tiled_least_cost`` relaxes tile by tile, for large grids:
its rounds follow tiles, and between rounds it holds only what enters tiles. ``time_least_cost`` does the same over all time
buckets. Routes are read off a settled field by pointer doubling, in as many rounds as the route's length has binary digits.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .cost import finite

NEIGHBOURS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
MAX_ROUNDS = 100_000             # default of ``max_rounds``: beyond it the search fails, it never stops early
GROUP_CELLS = 65_536             # cells of the tiles that one call of a task solves
BLOCK = 32                       # rows and columns of the blocks in which cells meet their neighbours


def _around(cells: DataFrame, zone: str, values: list[str]) -> DataFrame:
    """zone, r, c, values, and of each of the eight neighbours that is among ``cells`` the same values, as ``<value>_<k>``.

    A cell is sent to its neighbours once, so one shuffle serves all directions. Cells are brought together by blocks first, so
    that most rows meet in the task that sends them. ``values`` are numbers, never null; a cell (zone, r, c) occurs once.
    """
    offsets = [*NEIGHBOURS, (0, 0)]                    # the cell itself comes last
    block = [F.floor(F.col(x) / BLOCK) for x in ("r", "c")]
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for k, (a, b) in enumerate(offsets)])
    # offset k as seen from the row that receives
    sent = (cells.select(zone, "r", "c", *values).repartition(zone, *block).withColumn("_s", F.explode(steps))
            .select(zone, (F.col("r") - F.col("_s.dr")).alias("r"), (F.col("c") - F.col("_s.dc")).alias("c"), F.col("_s.k").alias("_k"), *values))
    of = [F.max(F.when(F.col("_k") == k, F.col(x))).alias(x if k == len(NEIGHBOURS) else f"{x}_{k}") for k in range(len(offsets)) for x in values]
    return sent.groupBy(zone, "r", "c").agg(*of).where(F.col(values[0]).isNotNull())


def _free(k: int, value: str, cut_corners: bool) -> Column:
    """Whether the move between a row's cell and its neighbour ``k`` is open: a diagonal needs one open shoulder."""
    a, b = NEIGHBOURS[k]
    open_ = F.col(f"{value}_{k}").isNotNull()
    if cut_corners or not (a and b):
        return open_
    return open_ & (F.col(f"{value}_{NEIGHBOURS.index((a, 0))}").isNotNull() | F.col(f"{value}_{NEIGHBOURS.index((0, b))}").isNotNull())


def edges(cells: DataFrame, cell_m: float, zone: str = "zone", value: str = "cost", cut_corners: bool = False) -> DataFrame:
    """Directed edges between passable neighbours, made inside the row that knows its surroundings."""
    near = _around(cells.where(finite(F.col(value))).select(zone, "r", "c", F.col(value).alias("_v")), zone, ["_v"])
    ways = [F.when(_free(k, "_v", cut_corners), F.struct((F.col("r") + a).alias("nr"), (F.col("c") + b).alias("nc"), F.col(f"_v_{k}").alias("cost_b")))
            for k, (a, b) in enumerate(NEIGHBOURS)]
    out = (near.select(zone, "r", "c", F.col("_v").alias("cost_a"), F.explode(F.array(*ways)).alias("_e")).where(F.col("_e").isNotNull())
           .select(zone, "r", "c", "_e.nr", "_e.nc", "cost_a", "_e.cost_b"))
    dist = F.hypot(F.col("nr") - F.col("r"), F.col("nc") - F.col("c")) * cell_m
    return out.withColumn("dist_m", dist).select(zone, "r", "c", "nr", "nc", "dist_m", "cost_a", "cost_b",
                                                 (dist * 0.5 * (F.col("cost_a") + F.col("cost_b"))).alias("weight"))


def _relax(labels: DataFrame, expand, keys: list[str], best: str, carry: list[str], every: int,
           max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Rounds of expand + min per key until nothing improves.

    State lives in one table of labels with the round they last improved in.
    Lineage is cut with a reliable checkpoint every ``every`` rounds, at which
    point the stop test is made; a lost executor repeats at most those rounds.
    """
    state = cut_lineage(labels.withColumn("_round", F.lit(0)))
    done = 0
    while done < max_rounds:
        for _ in range(every):
            done += 1
            fresh = expand(state.where(F.col("_round") == done - 1)).withColumn("_round", F.lit(done))
            pick = F.min(F.struct(F.col(best).alias("_b"), *[F.col(x).alias(x) for x in carry], "_round")).alias("m")
            state = (state.unionByName(fresh).groupBy(*keys).agg(pick)
                     .select(*keys, F.col("m._b").alias(best), *[F.col(f"m.{x}") for x in carry], F.col("m._round").alias("_round")))
        state = cut_lineage(state)
        if state.where(F.col("_round") == done).isEmpty():
            return state.drop("_round")
    raise RuntimeError("relaxation did not settle")


def shortcuts(edge_table: DataFrame, zone: str = "zone") -> DataFrame:
    """Edges plus the cheapest two-edge moves: half the rounds for three times the edges per cell.

    A cell has at most 8 edges, hence at most 24 targets afterwards; the pairs
    are reduced by ``min`` on the map side.
    """
    one = edge_table.select(zone, "r", "c", "nr", "nc", "weight")
    on = one.select(zone, F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("nr").alias("_r"), F.col("nc").alias("_c"),
                    F.col("weight").alias("_w"))
    two = (one.join(on, [zone, "nr", "nc"]).where((F.col("_r") != F.col("r")) | (F.col("_c") != F.col("c")))
           .select(zone, "r", "c", F.col("_r").alias("nr"), F.col("_c").alias("nc"), (F.col("weight") + F.col("_w")).alias("weight")))
    return one.unionByName(two).groupBy(zone, "r", "c", "nr", "nc").agg(F.min("weight").alias("weight"))


def least_cost(edge_table: DataFrame, starts: DataFrame, zone: str = "zone", doublings: int = 1, every: int = 2) -> DataFrame:
    """Cheapest cost from each zone's start to every reachable cell."""
    reach = cut_lineage(edge_table.select(zone, "r", "c", "nr", "nc", "weight"))
    for _ in range(doublings):
        reach = shortcuts(reach, zone)
    table = cut_lineage(reach.repartition(zone, "r", "c"))

    def expand(frontier: DataFrame) -> DataFrame:
        return (frontier.join(table, [zone, "r", "c"])
                .groupBy(zone, F.col("nr").alias("r"), F.col("nc").alias("c"))
                .agg(F.min(F.col("total") + F.col("weight")).alias("total")))

    return _relax(starts.select(zone, "r", "c", F.lit(0.0).alias("total")), expand, [zone, "r", "c"], "total", [], every)


# --- tile by tile ------------------------------------------------------------------------------------------

def _tile_search(cost: np.ndarray, entries: list[tuple[float, int, int]], cell_m: float, cut_corners: bool) -> tuple[np.ndarray, dict[tuple[int, int], float]]:
    """Cheapest totals within one tile, and of the moves that leave it.

    ``cost`` has the tile's cells and a rim of one cell around them, NaN where closed; totals beyond the rim's inner edge are exits.
    """
    rows, cols = cost.shape
    open_, value = np.isfinite(cost).tolist(), cost.tolist()
    total = [[math.inf] * cols for _ in range(rows)]
    exits: dict[tuple[int, int], float] = {}
    heap = []
    for at, r, c in entries:
        if open_[r][c] and at < total[r][c]:
            total[r][c] = at
            heap.append((at, r, c))
    heapq.heapify(heap)
    steps = [(a, b, 0.5 * cell_m * math.hypot(a, b)) for a, b in NEIGHBOURS]
    while heap:
        at, r, c = heapq.heappop(heap)
        if at > total[r][c]:
            continue
        here = value[r][c]
        for a, b, half in steps:
            nr, nc = r + a, c + b
            if not open_[nr][nc] or (a and b and not cut_corners and not open_[r][nc] and not open_[nr][c]):
                continue
            new = at + half * (here + value[nr][nc])
            if 0 < nr < rows - 1 and 0 < nc < cols - 1:
                if new < total[nr][nc]:
                    total[nr][nc] = new
                    heapq.heappush(heap, (new, nr, nc))
            elif new < exits.get((nr, nc), math.inf):
                exits[nr, nc] = new
    return np.array(total), exits


def _dealt(tiles: DataFrame, keys: list[str], cells: int) -> Column:
    """The group that a row's tile is solved in; ``tiles`` has a row per tile, of ``cells`` cells at most.

    A call of a Python task costs more than a small tile, so as many tiles as make about ``GROUP_CELLS`` cells share one,
    but fewer if cores would idle. Tiles are dealt by hash, so that the size of a group does not depend on their places.
    """
    count = tiles.count()
    cores = tiles.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(count, max(3 * cores, -(-count * cells // GROUP_CELLS))))
    return F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")


def tiled_least_cost(cells: DataFrame, starts: DataFrame, cell_m: float, zone: str = "zone", value: str = "cost", tile: int = 64,
                     cut_corners: bool = False, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """The field of ``least_cost``, in rounds that follow tiles.

    A round solves each tile that something cheaper has entered since it was last solved, from all entries known so far (at most 4 * tile
    cells of its edge and the start), and hands what leaves it to its neighbours. Only entries live between rounds, and only the tiles
    to be solved are moved, many to a call. Once no entry improves, one last pass fills in the tiles. A tile has tile**2 cells,
    whatever the grid's size. A cell (zone, r, c) occurs once.
    """
    side, kind = F.lit(tile), dict(cells.dtypes)[zone]
    open_cells = cells.where(finite(F.col(value))).select(zone, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col(value).cast("double").alias("_v"))
    reach = lambda x: F.array_distinct(F.array(*[F.floor((F.col(x) + d) / side).cast("int") for d in (-1, 0, 1)]))
    placed = (open_cells.withColumn("_tr", F.explode(reach("r"))).withColumn("_tc", F.explode(reach("c"))))
    keys = [zone, "_tr", "_tc"]
    packed = placed.groupBy(*keys).agg(F.collect_list(F.struct("r", "c", "_v")).alias("_cells"))                # at most (tile + 2)**2
    grids = cut_lineage(packed.select(*keys, *[F.col(f"_cells.{x}").alias(n) for x, n in (("r", "_rs"), ("c", "_cs"), ("_v", "_vs"))]))
    group = _dealt(grids, keys, (tile + 2) ** 2)
    home = [F.floor(F.col(x) / side).cast("int").alias(f"_t{x}") for x in ("r", "c")]
    schema = f"{zone} {kind}, r int, c int, total double"

    def solve(field: bool):
        def run(key: tuple, entries: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
            began = {}
            for z, tr, tc, r, c, at in zip(*[entries[x].tolist() for x in (*keys, "r", "c", "total")]):
                began.setdefault((z, tr, tc), []).append((at, r - tr * tile + 1, c - tc * tile + 1))
            zones, rs, cs, totals = [], [], [], []
            for z, tr, tc, r, c, v in zip(*[grid[x].tolist() for x in (*keys, "_rs", "_cs", "_vs")]):
                base_r, base_c = tr * tile - 1, tc * tile - 1
                cost = np.full((tile + 2, tile + 2), np.nan)
                cost[np.asarray(r) - base_r, np.asarray(c) - base_c] = v
                total, exits = _tile_search(cost, began.get((z, tr, tc), []), cell_m, cut_corners)
                if field:
                    at = np.nonzero(np.isfinite(total))
                    found = [(at[0] + base_r).tolist(), (at[1] + base_c).tolist(), total[at].tolist()]
                else:
                    found = [[base_r + x[0] for x in exits], [base_c + x[1] for x in exits], list(exits.values())]
                zones += [z] * len(found[0])
                for whole, part in zip((rs, cs, totals), found):
                    whole += part
            return pd.DataFrame({zone: pd.Series(zones, dtype=object), "r": rs, "c": cs, "total": totals})
        return run

    def solved(entries: DataFrame, tiles: DataFrame, field: bool) -> DataFrame:
        ground = grids.join(tiles, keys, "left_semi").withColumn("_group", group)
        return entries.withColumn("_group", group).groupBy("_group").cogroup(ground.groupBy("_group")).applyInPandas(solve(field), schema)

    entries = cut_lineage(starts.select(F.col(zone).cast(kind).alias(zone), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.lit(0.0).alias("total"), F.lit(0).alias("_round"))
                          .withColumns({f"_t{x}": F.floor(F.col(x) / side).cast("int") for x in ("r", "c")}))
    for done in range(1, max_rounds + 1):
        active = entries.where(F.col("_round") == done - 1).select(*keys).distinct()
        fresh = solved(entries.join(active, keys, "left_semi"), active, False).select(zone, "r", "c", "total", F.lit(done).alias("_round"), *home)
        best = F.min(F.struct("total", "_round")).alias("m")
        entries = cut_lineage(entries.unionByName(fresh).groupBy(zone, "r", "c", "_tr", "_tc").agg(best)
                              .select(zone, "r", "c", "m.total", "m._round", "_tr", "_tc"))
        if entries.where(F.col("_round") == done).isEmpty():
            return solved(entries, entries.select(*keys).distinct(), True)
    raise RuntimeError("relaxation did not settle")


# --- routes ------------------------------------------------------------------------------------------------

def predecessors(edge_table: DataFrame, field: DataFrame, zone: str = "zone") -> DataFrame:
    """zone, r, c, pr, pc: the cell before each reached one on its cheapest path; starts have none.

    Of equally cheap ones (to 6 decimals) the first in row order. A predecessor costs strictly less, so links never form
    a circle; costs are to be above zero.
    """
    here = field.select(zone, "r", "c", F.col("total").alias("_from"))
    there = field.select(zone, F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("total").alias("_to"))
    steps = (edge_table.select(zone, "r", "c", "nr", "nc", "weight").join(here, [zone, "r", "c"]).join(there, [zone, "nr", "nc"])
             .where(F.col("_from") < F.col("_to")))
    best = F.min(F.struct(F.round(F.col("_from") + F.col("weight"), 6).alias("t"), F.col("r").alias("pr"), F.col("c").alias("pc"))).alias("m")
    return steps.groupBy(zone, F.col("nr").alias("r"), F.col("nc").alias("c")).agg(best).select(zone, "r", "c", "m.pr", "m.pc")


def cell_predecessors(cells: DataFrame, field: DataFrame, cell_m: float, zone: str = "zone", value: str = "cost", cut_corners: bool = False) -> DataFrame:
    """``predecessors`` of the edges of ``cells``, without the edge table: each reached cell looks at its neighbours.

    ``field`` is the whole field from the starts, so an open shoulder of a move between reached cells is reached too.
    """
    reached = (cells.where(finite(F.col(value))).select(zone, "r", "c", F.col(value).alias("_v"))
               .join(field.select(zone, "r", "c", F.col("total").alias("_t")), [zone, "r", "c"]))
    near = _around(reached, zone, ["_v", "_t"])
    ways = []
    for k, (a, b) in enumerate(NEIGHBOURS):
        weight = F.hypot(F.lit(a), F.lit(b)) * cell_m * 0.5 * (F.col(f"_v_{k}") + F.col("_v"))
        ways.append(F.when(_free(k, "_v", cut_corners) & (F.col(f"_t_{k}") < F.col("_t")),
                           F.struct(F.round(F.col(f"_t_{k}") + weight, 6).alias("t"), (F.col("r") + a).alias("pr"), (F.col("c") + b).alias("pc"))))
    best = near.select(zone, "r", "c", F.array_min(F.array(*ways)).alias("m")).where(F.col("m").isNotNull())
    return best.select(zone, "r", "c", "m.pr", "m.pc")


def trace(links: DataFrame, ends: DataFrame, node: list[str], before: list[str], within: list[str] = ("zone",), route: str = "route_id") -> DataFrame:
    """Ordered rows of the way from a root to each end: route, seq (from 0 at the root), ``within``, node.

    ``links`` lead from ``node`` to the node ``before`` it, both ``within`` the same. Pointers double: after k rounds every link
    spans 2**k steps and each route has its last 2**k nodes, so a route of n nodes takes about log2(n) rounds.
    """
    within = list(within)
    jump = cut_lineage(links.select(*within, *node, *before).where(F.col(before[0]).isNotNull()))
    found = cut_lineage(ends.select(route, *within, *node, F.lit(0).cast("long").alias("back")))
    hop = 1
    while True:
        more = found.join(jump, [*within, *node]).select(route, *within, *[F.col(b).alias(n) for n, b in zip(node, before)], (F.col("back") + hop).alias("back"))
        more = cut_lineage(more)
        if more.isEmpty():
            break
        found = cut_lineage(found.unionByName(more))
        onward = jump.select(*within, *[F.col(n).alias(b) for n, b in zip(node, before)], *[F.col(b).alias(f"_{b}") for b in before])
        jump = cut_lineage(jump.join(onward, [*within, *before]).select(*within, *node, *[F.col(f"_{b}").alias(b) for b in before]))
        hop *= 2
    length = found.groupBy(route).agg(F.max("back").alias("_length"))
    return found.join(length, route).select(route, (F.col("_length") - F.col("back")).cast("int").alias("seq"), *within, *node)


def outcomes(ends: DataFrame, cells: DataFrame, field: DataFrame, zone: str = "zone", value: str = "cost") -> DataFrame:
    """``ends`` with total, found, and the reason why there is no route: outside, blocked or unreachable."""
    there = cells.select(zone, "r", "c", finite(F.col(value)).alias("_open"))
    out = ends.join(there, [zone, "r", "c"], "left").join(field.select(zone, "r", "c", "total"), [zone, "r", "c"], "left")
    reason = (F.when(F.col("_open").isNull(), "outside").when(~F.col("_open"), "blocked").when(F.col("total").isNull(), "unreachable"))
    return out.withColumn("found", F.col("total").isNotNull()).withColumn("reason", reason).drop("_open")


# --- by time bucket ----------------------------------------------------------------------------------------

def _timed_search(cost: np.ndarray, free: np.ndarray, entries: list[tuple[tuple, tuple]], cell_m: float, speed: float, bucket_s: float,
                  deadline_s: float, base: tuple[int, int]) -> tuple[dict, dict]:
    """Labels of one tile, settled cheapest first, and of the moves that leave it: (r, c, bucket) -> (total, time, pr, pc, pb).

    ``cost`` has rows, columns and buckets, NaN where closed at that time, ``free`` the passable cells; both with a rim of one cell.
    """
    rows, cols, buckets = cost.shape
    steps = [(a, b, math.hypot(a, b) * cell_m) for a, b in NEIGHBOURS]
    value, open_ = cost.tolist(), free.tolist()
    best, settled, exits = {}, {}, {}
    for key, label in entries:
        if key not in best or label < best[key]:
            best[key] = label
    heap = [(label, key) for key, label in best.items()]
    heapq.heapify(heap)
    while heap:
        label, key = heapq.heappop(heap)
        if key in settled:
            continue
        settled[key] = label
        r, c, b = key
        here = value[r][c][b]
        if here != here or not open_[r][c]:
            continue
        for dr, dc, dist in steps:
            nr, nc, when = r + dr, c + dc, label[1] + dist / speed
            if when > deadline_s or not open_[nr][nc] or (dr and dc and not open_[r][nc] and not open_[nr][c]):
                continue
            to = (nr, nc, math.floor(when / bucket_s))
            there = value[nr][nc][to[2]]
            if there != there:
                continue
            new = (label[0] + dist * 0.5 * (here + there), when, base[0] + r, base[1] + c, b)
            if 0 < nr < rows - 1 and 0 < nc < cols - 1:
                if to not in settled and (to not in best or new < best[to]):
                    best[to] = new
                    heapq.heappush(heap, (new, to))
            elif to not in exits or new < exits[to]:
                exits[to] = new
    return settled, exits


def time_least_cost(grid: DataFrame, field: DataFrame, starts: DataFrame, cell_m: float, speed: float, bucket_s: float,
                    deadline_s: float, zone: str = "zone", every: int = 1, tile: int = 64) -> DataFrame:
    """The same with costs that change by arrival bucket: one label per (cell, bucket), with the label before it (pr, pc, pb).

    ``grid`` holds the passable cells (geometry only), ``field`` the cost of a cell in a bucket, above zero; a missing or infinite
    cost is impassable at that time. The label of a key is the cheapest way to arrive in it that extends labels of other keys; of
    equal costs the earliest, then the first predecessor in row order.

    Costs above zero make that fixed point unique: labels settle cheapest first, in all buckets together. A round settles each tile
    (tile**2 cells, all buckets) whose entries changed, from its present entries, and replaces what leaves it, so an entry whose label
    lost its place is withdrawn; only entries live between rounds. ``every`` (rounds between two tests for the end) cannot change the result.
    """
    side, kind = F.lit(tile), dict(field.dtypes)[zone]
    last = math.floor(deadline_s / bucket_s)
    passable = grid.where(finite(F.col("cost"))).select(zone, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    costs = (field.where(finite(F.col("cost")) & F.col("bucket").between(0, last))
             .select(zone, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("bucket").cast("int").alias("bucket"), F.col("cost").cast("double").alias("_v")))
    # bucket -1 stands for the passable cell itself
    shape = passable.withColumns({"bucket": F.lit(-1), "_v": F.lit(0.0)})
    reach = lambda x: F.array_distinct(F.array(*[F.floor((F.col(x) + d) / side).cast("int") for d in (-1, 0, 1)]))
    tiles = [zone, "_tr", "_tc"]
    placed = costs.unionByName(shape).withColumn("_tr", F.explode(reach("r"))).withColumn("_tc", F.explode(reach("c")))
    packed = placed.groupBy(*tiles).agg(F.collect_list(F.struct("r", "c", "bucket", "_v")).alias("_cells"))       # (tile + 2)**2 cells by buckets
    grids = cut_lineage(packed.select(*[F.col(x).alias(f"_g{x}") for x in tiles],
                                      *[F.col(f"_cells.{x}").alias(n) for x, n in (("r", "_rs"), ("c", "_cs"), ("bucket", "_bs"), ("_v", "_vs"))]))
    label = ["total", "time", "pr", "pc", "pb"]
    schema = f"{zone} {kind}, r int, c int, bucket int, total double, time double, pr int, pc int, pb int"
    columns = [zone, "r", "c", "bucket", *label]

    def solve(labels: bool):
        def run(key: tuple, entries: pd.DataFrame, ground: pd.DataFrame) -> pd.DataFrame:
            if not len(entries):
                return pd.DataFrame([], columns=columns)
            base = (int(key[1]) * tile - 1, int(key[2]) * tile - 1)
            cost, free = np.full((tile + 2, tile + 2, last + 1), np.nan), np.zeros((tile + 2, tile + 2), bool)
            if len(ground):
                r, c, b, v = (np.asarray(ground[x].iat[0]) for x in ("_rs", "_cs", "_bs", "_vs"))
                timed = b >= 0
                cost[r[timed] - base[0], c[timed] - base[1], b[timed]] = v[timed]
                free[r[~timed] - base[0], c[~timed] - base[1]] = True
            began = [((r - base[0], c - base[1], b), (at, time, *((None,) * 3 if pd.isna(pr) else (int(pr), int(pc), int(pb)))))
                     for r, c, b, at, time, pr, pc, pb in entries[columns[1:]].itertuples(index=False, name=None)]
            settled, exits = _timed_search(cost, free, began, cell_m, speed, bucket_s, deadline_s, base)
            out = [(key[0], base[0] + r, base[1] + c, b, *at) for (r, c, b), at in (settled if labels else exits).items()]
            return pd.DataFrame(out, columns=columns).astype({x: "Int32" for x in ("pr", "pc", "pb")})
        return run

    def home(r: str, c: str, to: tuple[str, str] = ("_tr", "_tc")) -> dict:
        return {n: F.floor(F.col(x) / side).cast("int") for n, x in zip(to, (r, c))}

    def settle(entries: DataFrame, labels: bool) -> DataFrame:
        return entries.groupBy(*tiles).cogroup(grids.groupBy(*[f"_g{x}" for x in tiles])).applyInPandas(solve(labels), schema)

    def changed(before: DataFrame | None, now: DataFrame) -> DataFrame:
        if before is None:
            return now.select(*tiles).distinct()
        both = before.withColumn("_s", F.lit(1)).unionByName(now.withColumn("_s", F.lit(-1)))
        return both.groupBy(*now.columns).agg(F.sum("_s").alias("_net")).where("_net <> 0").select(*tiles).distinct()

    def onward(active: DataFrame, now: DataFrame) -> DataFrame:
        fresh = settle(now.join(active, tiles, "left_semi"), False).withColumns(home("r", "c"))
        source = active.select(zone, F.col("_tr").alias("_sr"), F.col("_tc").alias("_sc"))
        kept = now.withColumns(home("pr", "pc", ("_sr", "_sc"))).join(source, [zone, "_sr", "_sc"], "left_anti").select(*now.columns)
        return kept.unionByName(fresh)

    none = F.lit(None).cast("int")
    begun = starts.select(zone, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.lit(0).alias("bucket"), F.lit(0.0).alias("total"),
                          F.lit(0.0).alias("time"), none.alias("pr"), none.alias("pc"), none.alias("pb"))
    before, now, rounds = None, cut_lineage(begun.distinct().withColumns(home("r", "c"))), 0
    while True:
        for _ in range(every):
            before, now = now, onward(changed(before, now), now)
        rounds += every
        now, before = cut_lineage(now), before if every == 1 else cut_lineage(before)
        if changed(before, now).isEmpty():
            return settle(now, True)
        if rounds > MAX_ROUNDS:
            raise RuntimeError("relaxation did not settle")
