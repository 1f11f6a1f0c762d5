"""Routes that are searched for: the cheapest way from each zone's start to its four corners, priced like given routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paths
from ..operators import routes as op
from ..session import cut_lineage
from ..sources import tables as t
from . import missions as ms
from . import routes as rq
from .registry import query
from .sql import VIEWS, using

SIDE = 20                # zones are lattices of so many rows and columns
NODE, BEFORE = ["r", "c"], ["pr", "pc"]


def with_routes(names: str, body: str) -> str:
    """SQL with the tables ends, reached, pred and planned (route_id, seq, zone, r, c), and route tables read from planned."""
    clock = VIEWS["clock"].replace("route_points", "planned")
    also = f"""{ms.WALK},
        reached AS (SELECT zone, r, c, min(total) AS total FROM walk GROUP BY ALL),
        ends AS (SELECT zone * 4 + CAST(k AS INTEGER) AS route_id, zone, CAST(k // 2 * {SIDE - 1} AS INTEGER) AS r, CAST(k % 2 * {SIDE - 1} AS INTEGER) AS c
          FROM (SELECT DISTINCT zone FROM grid_cells), range(4) x(k)),
        pred AS (SELECT e.zone, e.nr AS r, e.nc AS c, arg_min({{'r': e.r, 'c': e.c}}, (round(a.total + e.weight, 6), e.r, e.c)) AS p
          FROM edge e JOIN reached a ON a.zone = e.zone AND a.r = e.r AND a.c = e.c JOIN reached b ON b.zone = e.zone AND b.r = e.nr AND b.c = e.nc
          WHERE a.total < b.total GROUP BY ALL),
        back AS (SELECT route_id, e.zone, e.r, e.c, 0 AS n FROM ends e JOIN reached f ON f.zone = e.zone AND f.r = e.r AND f.c = e.c
          UNION ALL SELECT route_id, b.zone, p.p.r, p.p.c, n + 1 FROM back b JOIN pred p ON p.zone = b.zone AND p.r = b.r AND p.c = b.c),
        planned AS (SELECT route_id, CAST(max(n) OVER (PARTITION BY route_id) - n AS INTEGER) AS seq, zone, r, c FROM back),
        clock AS ({clock}), arrived AS ({VIEWS["arrived"]}), priced AS ({VIEWS["priced"]})"""
    return using(names, body, also=also).replace("WITH ", "WITH RECURSIVE ", 1)


def searched(spark, sf):
    """Cells, the field from each zone's start, and the corners to reach."""
    cells = cut_lineage(ms.grid_cells(spark, sf))
    field = cut_lineage(paths.tiled_least_cost(cells, ms.starts(cells), t.CELL_M, tile=SIDE))
    k = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k")
    corner = lambda x: (x * (SIDE - 1)).cast("int")
    ends = (cells.select("zone").distinct().select("zone", k)
            .select((F.col("zone") * 4 + F.col("k")).alias("route_id"), "zone", corner(F.floor(F.col("k") / 2)).alias("r"), corner(F.col("k") % 2).alias("c")))
    return cells, field, ends


def planned(spark, sf):
    """Ordered cells of each route found, with distances and arrival seconds."""
    cells, field, ends = searched(spark, sf)
    links = paths.cell_predecessors(cells, field, t.CELL_M)
    points = paths.trace(links, ends.join(field.select("zone", *NODE), ["zone", *NODE]), NODE, BEFORE)
    return op.clocked(points, t.CELL_M, t.SPEED_MPS)


@query("least_cost_route", with_routes("edge final", "SELECT route_id, seq, zone, r, c, round(arrival_s, 4) AS arrival_s FROM clock"))
def least_cost_route(spark, sf):
    return planned(spark, sf).select("route_id", "seq", "zone", "r", "c", F.round("arrival_s", 4).alias("arrival_s"))


@query("planned_price", with_routes("edge final", rq.PRICE))
def planned_price(spark, sf):
    """The routes found, priced by the cost terms of their arrival buckets."""
    return rq.prices(rq.priced(spark, sf, planned(spark, sf)))


@query("least_cost_outcome", with_routes("edge final", """SELECT route_id, e.zone, e.r, e.c, round(f.total, 4) AS total, f.total IS NOT NULL AS found,
    CASE WHEN g.zone IS NULL THEN 'outside' WHEN g.cost IS NULL THEN 'blocked' WHEN f.total IS NULL THEN 'unreachable' END AS reason
    FROM ends e LEFT JOIN grid_cells g ON g.zone = e.zone AND g.r = e.r AND g.c = e.c LEFT JOIN reached f ON f.zone = e.zone AND f.r = e.r AND f.c = e.c"""))
def least_cost_outcome(spark, sf):
    """Whether each corner can be reached, at what cost, and if not, why."""
    cells, field, ends = searched(spark, sf)
    return paths.outcomes(ends, cells, field).select("route_id", "zone", "r", "c", F.round("total", 4).alias("total"), "found", "reason")
