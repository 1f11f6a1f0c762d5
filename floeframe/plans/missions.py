"""Mission, backtest and path queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cost as ct
from ..operators import missions as op
from ..operators import paths
from ..session import cut_lineage
from ..sources import tables as t
from . import cost as cq
from .registry import query
from .sql import define, using

OFFSETS = [0, 6, 12, 18]
_PROFILES = ", ".join(f"('{p}')" for p in ct.PROFILES)

# one static grid per zone: the cheapest bucket of each cell
define("grid_cells", "SELECT zone, r, c, min(env_cost) FILTER (WHERE isfinite(env_cost)) AS cost FROM env GROUP BY ALL", ["env"])
define("steps8", "SELECT a.dr, b.dc FROM (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc) WHERE NOT (dr = 0 AND dc = 0)")
define("passable", "SELECT * FROM grid_cells WHERE cost IS NOT NULL", ["grid_cells"])
define("edge", """SELECT a.zone, a.r, a.c, b.r AS nr, b.c AS nc, sqrt(CAST(dr * dr + dc * dc AS DOUBLE)) * 6250 AS dist_m,
    sqrt(CAST(dr * dr + dc * dc AS DOUBLE)) * 6250 * 0.5 * (a.cost + b.cost) AS weight
    FROM (SELECT * FROM passable, steps8) a JOIN passable b ON b.zone = a.zone AND b.r = a.r + dr AND b.c = a.c + dc
    LEFT JOIN passable s ON s.zone = a.zone AND s.r = a.r AND s.c = b.c LEFT JOIN passable z ON z.zone = a.zone AND z.r = b.r AND z.c = a.c
    WHERE dr = 0 OR dc = 0 OR s.cost IS NOT NULL OR z.cost IS NOT NULL""", ["passable", "steps8"])


# a mission request per order line: the supplier is the site, the order date the reference time
define("mission", """SELECT DISTINCT l_suppkey AS site, o_orderdate AS reference, o_orderstatus AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
define("scenario", f"""SELECT m.*, CAST(h AS INTEGER) AS offset_h, reference + to_hours(CAST(h AS INTEGER)) AS departure, profile
    FROM mission m, (VALUES (0), (6), (12), (18)) x(h), (VALUES {_PROFILES}) p(profile)""", ["mission"])
define("options", """SELECT *, outcome = 'searchable' AS feasible, CASE WHEN outcome = 'searchable' THEN
      (CASE profile WHEN 'fastest' THEN 1 WHEN 'shortest_distance' THEN 2 WHEN 'fuel_efficient' THEN 3 ELSE 4 END)
      * ((site * 31 + offset_h) % 97 + 1) END AS value
    FROM (SELECT *, CASE WHEN status = 'P' THEN 'historical_date_mismatch' WHEN offset_h * 3600 >= (site % 5) * 10800 THEN 'forecast_unavailable'
      WHEN cost IS NULL THEN 'hard_navigation_constraint' ELSE 'searchable' END AS outcome
      FROM scenario LEFT JOIN grid_cells g ON g.zone = site // 20 AND g.r = site * 3 % 20 AND g.c = site % 20)""",
       ["scenario", "grid_cells"])


def mission_rows(spark, sf):
    lines = t.read(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("site"))
    orders = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("reference"),
                                                F.col("o_orderstatus").alias("status"))
    return lines.join(orders, "l_orderkey").select("site", "reference", "status").distinct()


def option_rows(spark, sf):
    site, off = F.col("site"), F.col("offset_h")
    # a site that has no passable cell, or lies outside the grid, is a hard constraint
    ends = grid_cells(spark, sf).where(F.col("cost").isNotNull()).withColumn("_open", F.lit(True)).drop("cost")
    sites = (t.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("site")).distinct()
             .withColumn("zone", F.floor(site / 20).cast("int")).withColumn("r", (site * 3 % 20).cast("int")).withColumn("c", (site % 20).cast("int"))
             .join(ends, ["zone", "r", "c"], "left").select("site", "zone", "r", "c", "_open"))
    # sites are few beside missions, so they are placed once and join before the scenarios multiply
    s = op.scenarios(mission_rows(spark, sf).join(sites, "site", "left"), OFFSETS, ct.PROFILES)
    out = s.withColumn("outcome", op.outcome(F.col("_open").isNull(), off * 3600, (site % 5) * 10800, F.col("status") != "P"))
    rank = F.array_position(F.array(*[F.lit(p) for p in ct.PROFILES]), F.col("profile"))
    ok = F.col("outcome") == "searchable"
    return out.withColumn("feasible", ok).withColumn("value", F.when(ok, rank * ((site * 31 + off) % 97 + 1)))


@query("scenarios", using("scenario", """SELECT site, count(*) AS scenarios, count(DISTINCT departure) AS departures, min(departure) AS first_departure,
    max(departure) AS last_departure FROM scenario GROUP BY site"""))
def scenarios(spark, sf):
    return op.departure_counts(op.scenarios(mission_rows(spark, sf), OFFSETS, ct.PROFILES), "site")


@query("outcomes", using("options", "SELECT outcome, profile, count(*) AS scenarios FROM options GROUP BY ALL"))
def outcomes(spark, sf):
    return option_rows(spark, sf).groupBy("outcome", "profile").agg(F.count(F.lit(1)).alias("scenarios"))


@query("mission_summary", using("options", """SELECT site, count(*) AS options, count(*) FILTER (WHERE feasible) AS feasible_options, bool_or(feasible) AS any_feasible,
    coalesce(string_agg(DISTINCT profile, ',' ORDER BY profile) FILTER (WHERE feasible), '') AS objectives FROM options GROUP BY site"""))
def mission_summary(spark, sf):
    return op.mission_summary(option_rows(spark, sf), "site")


@query("departure_summary", using("options", """SELECT departure, count(*) AS options, count(*) FILTER (WHERE feasible) AS feasible_options, bool_or(feasible) AS any_feasible,
    coalesce(string_agg(DISTINCT profile, ',' ORDER BY profile) FILTER (WHERE feasible), '') AS objectives FROM options GROUP BY departure"""))
def departure_summary(spark, sf):
    return op.mission_summary(option_rows(spark, sf), "departure")


@query("select_option", using("options", """SELECT reference, value, ties, site, offset_h, profile FROM (SELECT *, count(*) OVER (PARTITION BY reference, value) AS ties,
    row_number() OVER (PARTITION BY reference ORDER BY value, site, offset_h, profile) AS rn FROM options WHERE feasible) WHERE rn = 1"""))
def select_option(spark, sf):
    return op.select_option(option_rows(spark, sf), ["reference"], "value", "min", ["site", "offset_h", "profile"])


@query("lineage", """WITH rec AS (SELECT p_brand || '/' || p_size AS sha, p_name AS dataset FROM part),
    k AS (SELECT sha, count(*) AS n, min(dataset) AS d FROM rec GROUP BY sha)
    SELECT s_suppkey AS artifact, sha, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN d END AS dataset,
    CASE WHEN sha IS NULL THEN 'no_hash' WHEN n = 1 THEN 'resolved' WHEN n IS NULL THEN 'no_record' ELSE 'ambiguous' END AS link
    FROM (SELECT s_suppkey, CASE WHEN s_nationkey > 2 THEN 'Brand#' || (s_nationkey % 27) || '/' || (s_suppkey % 60) END AS sha FROM supplier) LEFT JOIN k USING (sha)""")
def lineage(spark, sf):
    """Suppliers stand for artifacts, parts for training records, brand and size for the hash."""
    records = t.read(spark, sf, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("sha"), F.col("p_name").alias("dataset"))
    sha = F.concat(F.lit("Brand#"), (F.col("s_nationkey") % 27).cast("string"), F.lit("/"), (F.col("s_suppkey") % 60).cast("string"))
    artifacts = t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("artifact"), F.when(F.col("s_nationkey") > 2, sha).alias("sha"))
    return op.lineage(artifacts, records).select("artifact", "sha", "matches", "dataset", "link")


WINDOW = ("1996-06-01", "2000-06-30")
# a day has an analysis if its lines average more than 25 units, over all of its lines
define("seen_days", "SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 25 * count(*)")
define("reasons", f"""SELECT origin, CASE WHEN origin NOT BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}' THEN 'outside_held_out'
    WHEN origin NOT IN (FROM seen_days) THEN 'no_origin_observation' WHEN origin + 1 NOT IN (FROM seen_days) OR origin + 2 NOT IN (FROM seen_days) THEN 'no_target_observation'
    WHEN origin + 3 NOT IN (FROM seen_days) THEN 'no_realised_observation' END AS reason
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS origin FROM orders)""", ["seen_days"])


def origin_reasons(spark, sf):
    origins = t.read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("origin")).distinct()
    days = (t.read(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"))
            .agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n")).where("q > 25 * n").select("day"))
    return op.skip_reasons(origins, days, WINDOW, [1, 2], 4)


@query("skip_reasons", using("reasons", "SELECT origin, reason FROM reasons"))
def skip_reasons(spark, sf):
    return origin_reasons(spark, sf)


define("cases", """SELECT r.origin, r.reason, a, b, a IS DISTINCT FROM b AS changed FROM reasons r LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS origin,
    max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS a, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS b FROM orders GROUP BY 1) p USING (origin)""",
       ["reasons"])


@query("backtest_rollup", using("cases", """SELECT count(*) AS attempted, count(*) FILTER (WHERE inc) AS included, count(*) FILTER (WHERE NOT inc) AS skipped,
    count(*) FILTER (WHERE inc AND changed) AS changed, count(*) FILTER (WHERE inc AND re) AS realised, count(*) FILTER (WHERE inc AND NOT re) AS not_realised,
    count(*) FILTER (WHERE inc AND re AND changed AND b < a) AS forecast_lower, count(*) FILTER (WHERE inc AND re AND changed AND b > a) AS persistence_lower,
    count(*) FILTER (WHERE inc AND re AND (NOT changed OR a = b)) AS tied_or_identical
    FROM (SELECT *, reason IS NULL AS inc, a IS NOT NULL AND b IS NOT NULL AS re FROM cases)"""))
def backtest_rollup(spark, sf):
    price = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    plans = (t.read(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("origin"))
             .agg(price("O").alias("realised_a"), price("F").alias("realised_b")))
    cases = origin_reasons(spark, sf).join(plans, "origin", "left")
    return op.backtest_rollup(cases.withColumn("changed", ~F.col("realised_a").eqNullSafe(F.col("realised_b"))))


def grid_cells(spark, sf):
    env = cq.environment(spark, sf)
    return env.groupBy("zone", "r", "c").agg(F.min(F.when(ct.finite(F.col("env_cost")), F.col("env_cost"))).alias("cost"))


def starts(cells):
    """The first passable cell of each zone, in row order."""
    return (cells.where(F.col("cost").isNotNull()).groupBy("zone").agg(F.min(F.struct("r", "c")).alias("s")).select("zone", "s.r", "s.c"))


@query("edges", using("edge", "SELECT zone, r, c, nr, nc, round(dist_m, 4) AS dist_m, round(weight, 4) AS weight FROM edge"))
def edges(spark, sf):
    return paths.edges(grid_cells(spark, sf), t.CELL_M).select("zone", "r", "c", "nr", "nc", F.round("dist_m", 4).alias("dist_m"),
                                                               F.round("weight", 4).alias("weight"))


WALK = """walk AS (
    SELECT zone, CAST(split_part(s, ':', 1) AS INTEGER) AS r, CAST(split_part(s, ':', 2) AS INTEGER) AS c, 0.0::DOUBLE AS total, 0 AS hops
    FROM (SELECT zone, arg_min(r || ':' || c, r * 1000 + c) AS s FROM passable GROUP BY zone)
    UNION ALL SELECT w.zone, e.nr, e.nc, min(w.total + e.weight), any_value(w.hops) + 1 FROM walk w JOIN edge e ON e.zone = w.zone AND e.r = w.r AND e.c = w.c
    WHERE w.hops < 120 GROUP BY w.zone, e.nr, e.nc)"""
_WALK = using("edge", "SELECT zone, r, c, round(min(total), 4) AS total FROM walk GROUP BY ALL", also=WALK).replace("WITH ", "WITH RECURSIVE ", 1)


@query("least_cost", _WALK)
def least_cost(spark, sf):
    """The field from each zone's start, in tiles of the usual size."""
    cells = cut_lineage(grid_cells(spark, sf))
    return paths.tiled_least_cost(cells, starts(cells), t.CELL_M).withColumn("total", F.round("total", 4))


@query("least_cost_tiled", _WALK)
def least_cost_tiled(spark, sf):
    """The same by tiles of 8 x 8 cells, so that a way crosses many."""
    cells = cut_lineage(grid_cells(spark, sf))
    return paths.tiled_least_cost(cells, starts(cells), t.CELL_M, tile=8).withColumn("total", F.round("total", 4))


@query("least_cost_relaxed", _WALK)
def least_cost_relaxed(spark, sf):
    """The same cell by cell over the edge table."""
    cells = cut_lineage(grid_cells(spark, sf))
    return paths.least_cost(paths.edges(cells, t.CELL_M), starts(cells)).withColumn("total", F.round("total", 4))


@query("time_least_cost")
def time_least_cost(spark, sf):
    """Cheapest label per cell and arrival bucket; no SQL twin, checked exhaustively in the tests."""
    cells = grid_cells(spark, sf)
    env = cq.environment(spark, sf).withColumnRenamed("env_cost", "cost")
    first = env.where((F.col("bucket") == 0) & ct.finite(F.col("cost")))
    begin = first.groupBy("zone").agg(F.min(F.struct("r", "c")).alias("s")).select("zone", "s.r", "s.c")
    grid = cells.where(F.col("cost").isNotNull())
    out = paths.time_least_cost(grid, env, begin, t.CELL_M, t.SPEED_MPS, t.BUCKET_S, t.BUCKETS * t.BUCKET_S)
    return out.withColumn("total", F.round("total", 4)).withColumn("time", F.round("time", 2))
