"""Exposure, cost composition and path relaxation against brute force."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from floeframe.operators import cost, exposure, paths
from floeframe.operators import routes as rt
from floeframe.plans import missions
from floeframe.sources import tables as t

R = 6371008.8


def metres(a, b, c, d):
    p, q, dl = math.radians(a), math.radians(c), math.radians((d - b + 180) % 360 - 180)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(dl / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


def test_exposure_matches_brute_force_over_the_dateline(spark):
    grid = exposure.Lattice(-75.0, 0.5, -180.0, 1.0, 30, 360, wrap=True)
    cells = [(r, c, -75 + r * 0.5, -180 + c * 1.0) for r in range(30) for c in range(360)]
    bergs = [(0, 1, -70.2, 179.6, 150.0), (0, 2, -70.2, -179.3, 150.0), (0, 3, -62.0, 5.0, 0.0), (0, 4, -74.9, 20.0, 90.0)]
    pairs = exposure.cells_in_radius(spark.createDataFrame(bergs, "bucket int, iceberg_id long, lat double, lon double, radius_km double"),
                                     spark.createDataFrame(cells, "r int, c int, lat double, lon double"), grid)
    got = {(x["r"], x["c"]): (x["iceberg_id"], x["exposure"]) for x in exposure.strongest(pairs).collect()}
    want = {}
    for _, i, lat, lon, km in bergs:
        for r, c, la, lo in cells:
            d = metres(la, lo, lat, lon)
            if d < km * 1000 and (1 - d / (km * 1000)) > want.get((r, c), (0, 0.0))[1]:
                want[(r, c)] = (i, 1 - d / (km * 1000))
    assert got.keys() == want.keys()
    for k, (i, e) in want.items():
        assert got[k][0] == i and got[k][1] == pytest.approx(e)


def test_composition_over_seven_cells(spark):
    inf = float("inf")
    env = spark.createDataFrame([(0, i, 0, inf if i == 6 else 2.0) for i in range(7)], "zone int, r int, c int, env_cost double")
    chart = spark.createDataFrame([(0, 1, 0, 10, 1.0, True), (0, 2, 0, 11, 0.8, True), (0, 3, 0, 12, 0.3, True), (0, 4, 0, 13, 0.6, True),
                                   (0, 5, 0, 14, 1.0, True), (0, 6, 0, 15, 0.5, True)],
                                  "zone int, r int, c int, polygon_id int, dominant_fraction double, coverage boolean")
    pen = spark.createDataFrame([(10, 0.0, 0.0, True, False), (11, 25.0, 0.0, True, False), (12, 100.0, 25.0, True, False),
                                 (13, 100.0, 100.0, False, False), (14, 50.0, 50.0, True, True), (15, 1.0, 1.0, True, False)],
                                "polygon_id int, conservative double, optimistic double, has_rio boolean, is_water boolean")
    out = {r["r"]: r for r in cost.compose(env, cost.chart_terms(chart, pen, 10.0), ["zone", "r", "c"]).collect()}
    assert out[0]["state"] == "uncharted" and out[0]["conservative_cost"] == 2.0
    assert out[2]["conservative_cost"] == pytest.approx(2 + 25 + 2) and out[2]["optimistic_cost"] == pytest.approx(4.0)
    assert out[3]["conservative_cost"] == pytest.approx(2 + 100 + 7)
    assert out[4]["state"] == "charted_unknown_regime" and out[5]["state"] == "charted_water" and out[5]["conservative_cost"] == 2.0
    assert out[6]["conservative_cost"] == inf


def test_environment_cost_ignores_currents_without_weight(spark):
    df = spark.createDataFrame([(50.0, None, None, False), (None, 0.1, 0.1, False), (50.0, 0.3, 0.4, True)],
                               "sic double, u double, v double, blocked boolean")
    free = [r["env_cost"] for r in cost.environment_cost(df).collect()]
    paid = [r["env_cost"] for r in cost.environment_cost(df, current_weight=1.0).collect()]
    assert free == [1.5, float("inf"), float("inf")] and paid[0] == float("inf")


def test_missing_bucket_is_an_error_or_a_stamp(spark):
    comp = spark.createDataFrame([(0, 0, 0, 1.0), (9, 0, 0, 1.0)], "bucket int, r int, c int, conservative_cost double")
    exp = spark.createDataFrame([(0, 0, 0, 7, 0.5)], "bucket int, r int, c int, iceberg_id int, exposure double")
    out = {r["bucket"]: r for r in cost.with_icebergs(comp, exp, exp.select("bucket")).collect()}
    assert out[0]["final_cost"] == 3.5 and out[9]["exposure_omitted"] and out[9]["exposure"] is None
    with pytest.raises(Exception, match="no exposure field"):
        cost.with_icebergs(comp, exp, exp.select("bucket"), on_missing="error").collect()


def world(seed, n=7):
    rng = random.Random(seed)
    return {(r, c): (None if rng.random() < 0.25 else 1 + rng.random() * 9) for r in range(n) for c in range(n)}


def moves(grid, cell):
    r, c = cell
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            t = (r + a, c + b)
            if (a, b) == (0, 0) or grid.get(t) is None:
                continue
            if a and b and grid.get((r, c + b)) is None and grid.get((r + a, c)) is None:
                continue
            yield t, math.hypot(a, b) * 10.0


def test_least_cost_equals_dijkstra(spark):
    worlds = {z: world(z) for z in range(3)}
    rows = [(z, r, c, v) for z, g in worlds.items() for (r, c), v in g.items()]
    df = spark.createDataFrame(rows, "zone int, r int, c int, cost double")
    begin = {z: min(k for k, v in g.items() if v is not None) for z, g in worlds.items()}
    starts = spark.createDataFrame([(z, *s) for z, s in begin.items()], "zone int, r int, c int")
    got = {(x["zone"], x["r"], x["c"]): x["total"] for x in paths.least_cost(paths.edges(df, 10.0), starts).collect()}
    want = {}
    for z, g in worlds.items():
        heap, done = [(0.0, begin[z])], {}
        while heap:
            d, at = heapq.heappop(heap)
            if at in done:
                continue
            done[at] = d
            for t, m in moves(g, at):
                heapq.heappush(heap, (d + m * 0.5 * (g[at] + g[t]), t))
        want.update({(z, *k): v for k, v in done.items()})
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_time_least_cost_finds_the_gate_that_opens_later(spark):
    # last column costs 1000 before the gate opens at bucket 1, then 1; only a slower route meets the cheap window
    cells = [(0, r, c, 1.0) for r in range(3) for c in range(4)]
    field = [(0, r, c, b, (1000.0 if b == 0 else 1.0) if c == 3 else 1.0) for r in range(3) for c in range(4) for b in range(6)]
    out = paths.time_least_cost(spark.createDataFrame(cells, "zone int, r int, c int, cost double"),
                                spark.createDataFrame(field, "zone int, r int, c int, bucket int, cost double"),
                                spark.createDataFrame([(0, 1, 0)], "zone int, r int, c int"), 10.0, 1.0, 35.0, 100.0)
    at_goal = {r["bucket"]: r["total"] for r in out.where("r = 1 AND c = 3").collect()}
    best = {}

    def walk(cell, t, g, seen):                     # every simple walk within the deadline
        b = int(t // 35.0)
        if cell == (1, 3):
            best[b] = min(best.get(b, math.inf), g)
        here = (1000.0 if b == 0 else 1.0) if cell[1] == 3 else 1.0
        grid = {(r, c): 1.0 for r in range(3) for c in range(4)}
        for nxt, m in moves(grid, cell):
            if nxt in seen or t + m > 100.0 or g + m > best.get(int((t + m) // 35.0), math.inf) + 2000:
                continue
            nb = int((t + m) // 35.0)
            there = (1000.0 if nb == 0 else 1.0) if nxt[1] == 3 else 1.0
            walk(nxt, t + m, g + m * 0.5 * (here + there), seen | {nxt})

    walk((1, 0), 0.0, 0.0, {(1, 0)})
    assert min(at_goal.values()) == pytest.approx(min(best.values()))
    assert min(at_goal.values()) < at_goal[0]


def dijkstra(grid, begin):
    heap, done = [(0.0, begin)], {}
    while heap:
        d, at = heapq.heappop(heap)
        if at in done:
            continue
        done[at] = d
        for t, m in moves(grid, at):
            heapq.heappush(heap, (d + m * 0.5 * (grid[at] + grid[t]), t))
    return done


@pytest.mark.parametrize("tile", [1, 5])
def test_tiles_of_any_size_give_the_same_field(spark, tile):
    worlds = {f"z{z}": world(z, 11) for z in range(4)}
    worlds["away"] = {(r - 5, c - 3): v for (r, c), v in world(9, 11).items()}             # tiles also below zero
    worlds["shut"] = {(0, 0): 1.0, (5, 5): 2.0, (0, 1): None}
    rows = [(z, r, c, v, 7) for z, g in worlds.items() for (r, c), v in g.items()] + [("nostart", 0, 0, 1.0, 7)]
    begin = {z: min(k for k, v in g.items() if v is not None) for z, g in worlds.items()}
    starts = spark.createDataFrame([(z, *s) for z, s in begin.items()] + [("nowhere", 0, 0)], "zone string, r int, c int")
    out = paths.tiled_least_cost(spark.createDataFrame(rows, "zone string, r int, c int, cost double, total int"), starts, 10.0, tile=tile)
    got = {(x["zone"], x["r"], x["c"]): x["total"] for x in out.collect()}
    want = {(z, *k): v for z, g in worlds.items() for k, v in dijkstra(g, begin[z]).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_rounds_follow_tiles(spark):
    cells = spark.range(96 * 96).select(F.lit(0).alias("zone"), (F.col("id") / 96).cast("int").alias("r"), (F.col("id") % 96).cast("int").alias("c"), F.lit(1.0).alias("cost"))
    start = spark.createDataFrame([(0, 0, 0)], "zone int, r int, c int")
    far = paths.tiled_least_cost(cells, start, 1.0, tile=32, max_rounds=8).where("r = 95 AND c = 95").first()
    assert far["total"] == pytest.approx(95 * math.sqrt(2))
    with pytest.raises(RuntimeError, match="did not settle"):
        paths.tiled_least_cost(cells, start, 1.0, tile=32, max_rounds=2)


def test_routes_are_cheapest_and_ordered(spark):
    worlds = {z: world(20 + z, 9) for z in range(3)}
    begin = {z: min(k for k, v in g.items() if v is not None) for z, g in worlds.items()}
    df = spark.createDataFrame([(z, r, c, v) for z, g in worlds.items() for (r, c), v in g.items()], "zone int, r int, c int, cost double")
    starts = spark.createDataFrame([(z, *s) for z, s in begin.items()], "zone int, r int, c int")
    field = paths.least_cost(paths.edges(df, 10.0), starts)
    ends = [(z * 1000 + i, z, *k) for z, g in worlds.items() for i, k in enumerate(sorted(g)[-12:] + [begin[z], (99, 99)])]
    asked = spark.createDataFrame(ends, "route_id int, zone int, r int, c int")
    told = {r["route_id"]: r for r in paths.outcomes(asked, df, field).collect()}
    out = paths.trace(paths.predecessors(paths.edges(df, 10.0), field), asked.join(field.select("zone", "r", "c"), ["zone", "r", "c"]), ["r", "c"], ["pr", "pc"])
    routes = {}
    for x in out.orderBy("route_id", "seq").collect():
        routes.setdefault(x["route_id"], []).append((x["seq"], (x["r"], x["c"])))
    for i, z, r, c in ends:
        g, want = worlds[z], dijkstra(worlds[z], begin[z])
        reason = None if (r, c) in want else "outside" if (r, c) not in g else "blocked" if g[r, c] is None else "unreachable"
        assert (told[i]["found"], told[i]["reason"]) == ((r, c) in want, reason) and (i in routes) == ((r, c) in want)
        if i in routes:
            way = [k for _, k in routes[i]]
            assert [s for s, _ in routes[i]] == list(range(len(way))) and way[0] == begin[z] and way[-1] == (r, c)
            spent = sum(dict(moves(g, a))[b] * 0.5 * (g[a] + g[b]) for a, b in zip(way, way[1:]))     # every move is permitted
            assert spent == pytest.approx(want[r, c]) and told[i]["total"] == pytest.approx(want[r, c])


def timed_world(seed, n=5, buckets=5):
    rng = random.Random(seed)
    shape = {(r, c): 1.0 if rng.random() < 0.85 or (r, c) == (0, 0) else None for r in range(n) for c in range(n)}
    cost = {(r, c, b): 1 + rng.random() * 9 for (r, c), v in shape.items() if v for b in range(buckets) if rng.random() < 0.85 or (r, c, b) == (0, 0, 0)}
    return shape, cost


def settle_in_order(shape, cost, bucket_s, deadline):
    """Labels settle bucket by bucket and cheapest first, once per (cell, bucket)."""
    heap, done = [(0, 0.0, 0.0, (0, 0))], {}
    while heap:
        b, g, t, at = heapq.heappop(heap)
        if (at, b) in done:
            continue
        done[at, b] = (g, t)
        for to, m in moves(shape, at):
            when = t + m
            nb = int(when // bucket_s)
            if when <= deadline and (*at, b) in cost and (*to, nb) in cost:
                heapq.heappush(heap, (nb, g + m * 0.5 * (cost[(*at, b)] + cost[(*to, nb)]), when, to))
    return done


@pytest.mark.parametrize("bucket_s, deadline", [(35.0, 140.0), (8.0, 39.0)])
def test_time_buckets_do_not_depend_on_rounds(spark, bucket_s, deadline):
    worlds = {z: timed_world(z) for z in range(3)}
    grid = spark.createDataFrame([(z, r, c, v) for z, (shape, _) in worlds.items() for (r, c), v in shape.items()], "zone int, r int, c int, cost double").where("cost IS NOT NULL")
    field = spark.createDataFrame([(z, *k, v) for z, (_, cost) in worlds.items() for k, v in cost.items()], "zone int, r int, c int, bucket int, cost double")
    starts = spark.createDataFrame([(z, 0, 0) for z in worlds], "zone int, r int, c int")
    want = {(z, *at, b): v for z, (shape, cost) in worlds.items() for (at, b), v in settle_in_order(shape, cost, bucket_s, deadline).items()}
    for every in (1, 3):
        out = paths.time_least_cost(grid, field, starts, 10.0, 1.0, bucket_s, deadline, every=every).collect()
        got = {(x["zone"], x["r"], x["c"], x["bucket"]): (x["total"], x["time"]) for x in out}
        assert got.keys() == want.keys(), every
        assert all(got[k] == pytest.approx(v) for k, v in want.items()), every
        links = {(x["zone"], x["r"], x["c"], x["bucket"]): (x["zone"], x["pr"], x["pc"], x["pb"]) for x in out}
        assert all(v[1] is None or got[v][0] < got[k][0] for k, v in links.items())                   # each label extends a settled one


@pytest.mark.parametrize("options, shift, most", [({}, 0, 4), ({"tile": 2}, 2, 60)])
def test_time_search_holds_only_what_enters_tiles(spark, monkeypatch, options, shift, most):
    """A copy per round of tiles, none per bucket; tiles of any size give the same labels."""
    shape, cost = timed_world(7)
    copies, cut = [], paths.cut_lineage
    monkeypatch.setattr(paths, "cut_lineage", lambda df: copies.append(1) or cut(df))
    grid = spark.createDataFrame([("z", r - shift, c - shift, v) for (r, c), v in shape.items()], "zone string, r int, c int, cost double")
    field = spark.createDataFrame([("z", r - shift, c - shift, b, v) for (r, c, b), v in cost.items()], "zone string, r int, c int, bucket int, cost double")
    out = paths.time_least_cost(grid, field, spark.createDataFrame([("z", -shift, -shift)], "zone string, r int, c int"), 10.0, 1.0, 8.0, 39.0, **options)
    got = {((x["r"] + shift, x["c"] + shift), x["bucket"]): (x["total"], x["time"]) for x in out.collect()}
    want = settle_in_order(shape, cost, 8.0, 39.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert len(copies) <= most


def test_time_least_cost_searches_all_buckets(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(missions.paths, "time_least_cost", lambda *a: asked.append(a[-2:]) or a[2].select("zone", F.lit(0.0).alias("total"), F.lit(0.0).alias("time")))
    missions.time_least_cost(spark, "/root/testdata/sf0.001")
    assert asked == [(t.BUCKET_S, t.BUCKETS * t.BUCKET_S)]


def test_doubles_round_and_measure_as_sql_does(spark):
    """Values beside a half, and vectors whose hypot differs in the last bit, come out as in the SQL twins."""
    import decimal

    import duckdb

    from floeframe.functions import expressions as ex
    rng = random.Random(3)
    by_digits = lambda x: float(decimal.Decimal(repr(x)).quantize(decimal.Decimal("1e-6"), decimal.ROUND_HALF_UP))
    drawn = (1 + rng.randrange(10 ** 6) / 1e6 + 5e-7 + 0.3 for _ in range(100_000))
    beside = [x for x in drawn if by_digits(x) != math.floor(x * 1e6 + 0.5) / 1e6][:50]
    assert len(beside) == 50
    got = [r["y"] for r in spark.createDataFrame([(x,) for x in beside], "x double").select(ex.rounded(F.col("x"), 6).alias("y")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchall()[0][0] for x in beside]
    pairs = [(u, v) for u, v in ((rng.random() * 0.2, rng.random() * 0.2) for _ in range(5000)) if math.hypot(u, v) != math.sqrt(u * u + v * v)][:50]
    df = spark.createDataFrame([(50.0, u, v, False) for u, v in pairs], "sic double, u double, v double, blocked boolean")
    assert {(r["u"], r["env_cost"]) for r in cost.environment_cost(df, current_weight=0.3).collect()} == {(u, 1 + 50.0 / 100 + 0.3 * min(math.sqrt(u * u + v * v) / 0.5, 1.0)) for u, v in pairs}


def test_exposure_is_that_of_the_sql_formula_unrounded(spark):
    """Distances follow the SQL twin's formula step by step; only a sine's last bit may differ between the engines."""
    import duckdb

    from floeframe.plans.exposure import GRID
    from floeframe.plans.sql import gc_m
    cells = spark.createDataFrame([(r, c, -70 + r * 0.1, c * 0.2) for r in range(60) for c in range(100)], "r int, c int, lat double, lon double")
    bergs = [(i % 4, i, -70 + (i * 37 % 600) / 100.0, (i * 53 % 2000) / 100.0, 15.0 + i % 25) for i in range(60)]
    pairs = exposure.cells_in_radius(spark.createDataFrame(bergs, "bucket int, iceberg_id long, lat double, lon double, radius_km double"), cells, GRID)
    got = {(x["iceberg_id"], x["r"], x["c"]): x["exposure"] for x in pairs.collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE b (i BIGINT, lat DOUBLE, lon DOUBLE, radius_km DOUBLE)")
    con.executemany("INSERT INTO b VALUES (?, ?, ?, ?)", [x[1:] for x in bergs])
    con.execute("CREATE TABLE g AS SELECT r, c, -70 + r * 0.1::DOUBLE AS lat, c * 0.2::DOUBLE AS lon FROM range(60) x(r), range(100) y(c)")
    sql = f"SELECT i, r, c, 1 - d / (radius_km * 1000) FROM (SELECT b.*, g.r, g.c, {gc_m('g.lat', 'g.lon', 'b.lat', 'b.lon')} AS d FROM b, g) WHERE d < radius_km * 1000"
    expected = {(i, r, c): x for i, r, c, x in con.execute(sql).fetchall()}
    assert got.keys() == expected.keys() and len(got) > 1000
    assert max(abs(got[k] - expected[k]) for k in got) < 1e-15
    assert sum(got[k] != expected[k] for k in got) < len(got) / 100


def test_geometry_groups_and_divergence(spark):
    rows = [(1, [(0, 0), (1, 1)]), (2, [(0, 0), (1, 1)]), (3, [(1, 1), (0, 0)]), (4, [(0, 0)])]
    pts = spark.createDataFrame([(i, s, 0, r, c) for i, path in rows for s, (r, c) in enumerate(path)], "route_id long, seq int, zone int, r int, c int")
    groups = {r["route_id"]: (r["rep"], r["verified"]) for r in rt.geometry_groups(pts, ["zone", "r", "c"]).collect()}
    assert groups == {1: (1, True), 2: (1, True), 3: (3, True), 4: (4, True)}
    div = {r["pair"]: r for r in rt.first_divergence(rt.as_pairs(pts, ["seq", "zone", "r", "c"]), ["zone", "r", "c"]).collect()}
    assert div[1]["first_difference"] is None and div[2]["first_difference"] == 0
    assert div[3]["first_difference"] == 0 and div[3]["first_conflict"] == 0


def test_resistance_and_growth(spark):
    from floeframe.functions import expressions as ex
    r = spark.range(1).select(ex.resistance_factor(F.lit(100.0)).alias("a"), ex.resistance_factor(F.lit(101.0)).alias("b"),
                              ex.growth_factor(F.lit(96.0)).alias("g"), ex.growth_factor(F.lit(0.0)).alias("z"),
                              ex.growth_factor(F.lit(-1.0)).alias("n"), ex.growth_factor(F.lit(48.0), law="linear").alias("l")).first()
    assert (r["a"], r["b"], r["g"], r["z"], r["n"], r["l"]) == (3.0, None, 2.0, 0.0, None, 2.0)


def test_no_cell_is_lost_where_a_circle_reaches_the_pole(spark):
    """A centre at 89.6 S: the circle spans all longitudes, and brute force over the whole lattice agrees."""
    from pyspark.sql import functions as F

    from floeframe.functions import expressions as ex
    from floeframe.operators.exposure import Lattice, cells_in_radius
    grid = Lattice(lat0=-90.0, dlat=0.1, lon0=-180.0, dlon=1.0, rows=60, cols=360, wrap=True)
    cells = spark.range(60 * 360).select((F.col("id") / 360).cast("int").alias("r"), (F.col("id") % 360).cast("int").alias("c")).select(
        "r", "c", (F.col("r") * 0.1 - 90.0).alias("lat"), (F.col("c") * 1.0 - 180.0).alias("lon"))
    for lat in (-89.6, -89.0, -86.5):
        berg = spark.createDataFrame([("a", lat, 10.0, 100.0)], "iceberg_id string, lat double, lon double, radius_km double")
        got = cells_in_radius(berg, cells, grid).count()
        h = (F.pow(F.sin(F.radians(F.col("lat") - lat) / 2), 2)
             + F.cos(F.radians("lat")) * F.cos(F.radians(F.lit(lat))) * F.pow(F.sin(F.radians(F.col("lon") - 10.0) / 2), 2))
        far = 2 * ex.EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
        assert got == cells.where(far < 100_000.0).count()


def test_buckets_are_told_apart_as_rows(spark):
    used = {1: [0, 1, 1, 63, 64, 200], 2: [5], 3: [-1, None]}
    fields = [0, 63, 64, 65, 130, 0]
    got = rt.bucket_status(spark.createDataFrame([(k, b) for k, v in used.items() for b in v], "route_id int, bucket int"),
                           spark.createDataFrame([(b,) for b in fields], "bucket int")).collect()
    want = {(k, b, "priced" if b in fields else "missing") for k, v in used.items() for b in v if b is not None and b >= 0}
    want |= {(k, b, "display_only") for k in (1, 2) for b in fields if b not in used[k]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    none = rt.bucket_status(spark.createDataFrame([(1, 3)], "route_id int, bucket int"), spark.createDataFrame([], "bucket int")).collect()
    assert [tuple(r) for r in none] == [(1, 3, "missing")]


def test_small_tiles_share_a_call(spark):
    """Tiles are solved in groups of about GROUP_CELLS cells, so that calls follow cells and not tiles."""
    tiles = spark.range(5000).select(F.col("id").alias("zone"), F.lit(0).alias("_tr"), F.lit(0).alias("_tc"))
    keys = ["zone", "_tr", "_tc"]
    groups = lambda cells: tiles.select(paths._dealt(tiles, keys, cells).alias("g")).distinct().count()
    cores = spark.sparkContext.defaultParallelism
    assert 1 < groups(100) <= max(3 * cores, 5000 * 100 // paths.GROUP_CELLS + 1)
    assert groups(paths.GROUP_CELLS) > 3000             # large tiles have calls of their own


def test_cells_find_the_predecessors_of_the_edge_table(spark):
    rng = random.Random(4)
    rows = [(z, r, c, rng.choice([1.0, 2.0, 2.5, None])) for z in (0, 1) for r in range(-3, 40) for c in range(30, 40) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "zone int, r int, c int, cost double")
    first = {z: min((r, c) for y, r, c, v in rows if y == z and v) for z in (0, 1)}
    starts = spark.createDataFrame([(z, *first[z]) for z in first], "zone int, r int, c int")
    for corners in (False, True):
        field = paths.tiled_least_cost(df, starts, 10.0, tile=16, cut_corners=corners).localCheckpoint()
        want = paths.predecessors(paths.edges(df, 10.0, cut_corners=corners), field)
        got = paths.cell_predecessors(df, field, 10.0, cut_corners=corners)
        assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect()) and want.count() > 300
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
