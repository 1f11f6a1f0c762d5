"""Exposure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import global_rank
from ..operators import exposure as op
from ..session import stored
from ..sources import tables as t
from . import drift as dr
from .registry import query
from .sql import define, gc_m, using

GRID = op.Lattice(-70.0, 0.1, 0.0, 0.2, 100, 100)

define("near", f"""SELECT b.bucket, g.r, g.c, b.iceberg_id, b.radius_km, d AS distance_m, 1 - d / (radius_km * 1000) AS exposure
    FROM (SELECT bergs.*, g.r AS gr, g.c AS gc, {gc_m('g.lat', 'g.lon', 'bergs.lat', 'bergs.lon')} AS d FROM bergs, cell_geo g) b
    JOIN cell_geo g ON g.r = gr AND g.c = gc WHERE d < radius_km * 1000""", ["bergs", "cell_geo"])
define("field", """SELECT bucket, r, c, iceberg_id, exposure FROM (SELECT *, row_number() OVER (PARTITION BY bucket, r, c
    ORDER BY exposure DESC, iceberg_id) AS rn FROM near) WHERE rn = 1""", ["near"])
_FIELD = using("field", "SELECT bucket, r, c, iceberg_id, round(exposure, 6) AS exposure FROM field")


def exposure_field(spark, sf, **window):
    return op.strongest(op.cells_in_radius(t.bergs(spark, sf), t.cell_geo(spark, sf), GRID, **window))


@query("exposure", _FIELD)
def exposure(spark, sf):
    return exposure_field(spark, sf).withColumn("exposure", F.round("exposure", 6))


@query("exposure_theta", _FIELD)
def exposure_theta(spark, sf):
    """The same field from a window four times as wide: the narrow window misses nothing."""
    return exposure_field(spark, sf, scale=5.0, extra=12).withColumn("exposure", F.round("exposure", 6))


@query("exposure_summary", using("field", """SELECT bucket, count(*) AS cells, round(max(exposure), 6) AS max_exposure,
    round(avg(exposure), 6) AS mean_exposure, count(DISTINCT iceberg_id) AS contributors,
    round(count(*) / (SELECT count(*) FROM cell_geo), 6) AS fraction FROM field GROUP BY bucket"""))
def exposure_summary(spark, sf):
    return op.summary(exposure_field(spark, sf), t.cell_geo(spark, sf))


@query("top_bergs", using("field", """SELECT iceberg_id, count(*) AS cells FROM field GROUP BY iceberg_id
    ORDER BY cells DESC, iceberg_id LIMIT 10"""))
def top_bergs(spark, sf):
    return (exposure_field(spark, sf).groupBy("iceberg_id").agg(F.count(F.lit(1)).alias("cells"))
            .orderBy(F.desc("cells"), "iceberg_id").limit(10))


@query("busiest_days", using("pop", """SELECT prev_day, count(*) AS n, (SELECT max(prev_day) FROM pop WHERE moved) AS latest
    FROM pop WHERE moved GROUP BY prev_day ORDER BY n DESC, prev_day LIMIT 5"""))
def busiest_days(spark, sf):
    days = (dr.op.population(dr._steps(spark, sf)).where("moved").groupBy("prev_day").agg(F.count(F.lit(1)).alias("n")))
    latest = days.agg(F.max("prev_day").alias("latest"))
    return (days.orderBy(F.desc("n"), "prev_day").limit(5)
            .join(F.broadcast(latest), F.lit(True)))


# the injected berg of the what-if: bucket, position and radius are parameters
ADDED = {"lat": -65.05, "lon": 9.9, "radius_km": 60.0, "from_bucket": 2}
define("added", f"""SELECT k.bucket, g.r, g.c, -1 AS iceberg_id,
    1 - ({gc_m('g.lat', 'g.lon', '(-65.05)', '9.9')}) / 60000 AS exposure FROM cell_geo g,
    (SELECT DISTINCT bucket FROM bergs WHERE bucket >= 2) k
    WHERE {gc_m('g.lat', 'g.lon', '(-65.05)', '9.9')} < 60000""", ["cell_geo", "bergs"])


@query("what_if", using("field added", """SELECT bucket, count(*) FILTER (WHERE b > 0) AS cells_before,
    count(*) FILTER (WHERE greatest(b, n) > 0) AS cells_after, round(sum(b), 6) AS total_before,
    round(sum(greatest(b, n)), 6) AS total_after, count(*) FILTER (WHERE n > b) AS cells_changed
    FROM (SELECT bucket, r, c, coalesce(f.exposure, 0) AS b, coalesce(a.exposure, 0) AS n
          FROM field f FULL JOIN added a USING (bucket, r, c)) GROUP BY bucket"""))
def what_if(spark, sf):
    cells = t.cell_geo(spark, sf)
    buckets = t.bergs(spark, sf).select("bucket").distinct()
    berg = buckets.select("bucket", F.lit(-1).cast("long").alias("iceberg_id"), F.lit(ADDED["lat"]).alias("lat"),
                          F.lit(ADDED["lon"]).alias("lon"), F.lit(ADDED["radius_km"]).alias("radius_km"))
    added = op.cells_in_radius(berg, cells, GRID)
    after = op.inject(exposure_field(spark, sf), added, ADDED["from_bucket"])
    was = F.coalesce("before", F.lit(0.0))
    return after.groupBy("bucket").agg(
        F.count_if(was > 0).alias("cells_before"), F.count_if(F.col("exposure") > 0).alias("cells_after"),
        F.round(F.sum(was), 6).alias("total_before"), F.round(F.sum("exposure"), 6).alias("total_after"),
        F.count_if(F.col("exposure") > was).alias("cells_changed"))


define("berg_states", """SELECT iceberg_id, sensor, prev_day, 0.0::DOUBLE AS hours, 'observed' AS label, lat0 AS lat, lon0 AS lon
    FROM split_pop UNION ALL SELECT iceberg_id, sensor, prev_day, horizon_h, 'predicted_' || CAST(horizon_h AS INTEGER) || 'h', lat, lon
    FROM horizon_rows""", ["split_pop", "horizon_rows"])


def berg_states(spark, sf):
    """Observed state (hour 0) and predicted states, kept apart by label."""
    rows = dr.scored_population(spark, sf)
    key = ["iceberg_id", "sensor", "prev_day"]
    seen = rows.select(*key, F.lit(0.0).alias("hours"), F.lit("observed").alias("label"),
                       F.col("lat0").alias("lat"), F.col("lon0").alias("lon"))
    ahead = dr.op.at_horizons(rows, dr.op.calibrated_radius(rows))
    label = F.concat(F.lit("predicted_"), F.col("horizon_h").cast("int").cast("string"), F.lit("h"))
    return seen.unionByName(ahead.select(*key, F.col("horizon_h").alias("hours"), label.alias("label"), "lat", "lon"))


@query("states_by_berg", using("berg_states", """SELECT iceberg_id, sensor, prev_day, count(*) AS states,
    string_agg(label, ',' ORDER BY hours) AS labels FROM berg_states GROUP BY ALL"""))
def states_by_berg(spark, sf):
    # one forecast has an observed state and one per horizon, so the list is four long
    listed = F.array_sort(F.collect_list(F.struct("hours", "label")))
    return (berg_states(spark, sf).groupBy("iceberg_id", "sensor", "prev_day")
            .agg(F.count(F.lit(1)).alias("states"),
                 F.array_join(F.transform(listed, lambda s: s["label"]), ",").alias("labels")))


ASKED_H = [-6.0, 0.0, 9.0, 24.0, 36.0, 47.5, 100.0, 1000.0]


@query("berg_at", using("berg_states", f"""SELECT iceberg_id, sensor, prev_day, at_h, round(lat, 6) AS lat,
    round(CASE WHEN lon >= -180 AND lon < 180 THEN lon ELSE ((lon + 180.0) % 360.0 + 360.0) % 360.0 - 180.0 END, 6) AS lon,
    a.hours AS from_h, b.hours AS to_h, coalesce(a.hours = at_h, FALSE) AS exact, a.hours IS NULL OR b.hours IS NULL AS outside
    FROM (SELECT k.*, at_h, a, b, CASE WHEN a.hours = at_h THEN a.lat ELSE a.lat + (b.lat - a.lat) * (at_h - a.hours) / (b.hours - a.hours) END AS lat,
        CASE WHEN a.hours = at_h THEN a.lon ELSE a.lon + ((((b.lon - a.lon) + 540.0) % 360.0 + 360.0) % 360.0 - 180.0) * (at_h - a.hours) / (b.hours - a.hours) END AS lon
      FROM (SELECT iceberg_id, sensor, prev_day, at_h,
          (SELECT arg_max({{'hours': s.hours, 'lat': s.lat, 'lon': s.lon}}, s.hours) FROM berg_states s WHERE s.iceberg_id = k.iceberg_id AND s.sensor = k.sensor AND s.prev_day = k.prev_day AND s.hours <= at_h) AS a,
          (SELECT arg_min({{'hours': s.hours, 'lat': s.lat, 'lon': s.lon}}, s.hours) FROM berg_states s WHERE s.iceberg_id = k.iceberg_id AND s.sensor = k.sensor AND s.prev_day = k.prev_day AND s.hours >= at_h) AS b
        FROM (SELECT DISTINCT iceberg_id, sensor, prev_day FROM berg_states) k, (VALUES {", ".join(f"({h}::DOUBLE)" for h in ASKED_H)}) x(at_h)) k)"""))
def berg_at(spark, sf):
    """Positions at several hours: on a horizon, between two by the shortest longitude arc, and outside all of them."""
    key = ["iceberg_id", "sensor", "prev_day"]
    states = stored(berg_states(spark, sf).select(*key, "hours", "lat", "lon"))
    asked = states.select(*key).distinct().select(*key, F.explode(F.array(*[F.lit(h) for h in ASKED_H])).alias("at_h"))
    return op.state_at(states, asked, key).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


START, GOAL = (-1500000.0, 800000.0), (900000.0, 2100000.0)
from .tracks import _RHO  # noqa: E402

define("approach", f"""SELECT iceberg_id, hours, sqrt(pow(x - (-1500000.0 + tt * 2400000.0), 2) + pow(y - (800000.0 + tt * 1300000.0), 2)) AS d
    FROM (SELECT *, greatest(0.0, least(1.0, ((x + 1500000.0) * 2400000.0 + (y - 800000.0) * 1300000.0)
          / (2400000.0 * 2400000.0 + 1300000.0 * 1300000.0))) AS tt FROM
      (SELECT *, {_RHO} * sin(radians(lon)) AS x, {_RHO} * cos(radians(lon)) AS y FROM berg_states))""", ["berg_states"])


@query("corridor_rank", using("approach", """SELECT iceberg_id, round(distance_m, 3) AS distance_m, at_hours,
    row_number() OVER (ORDER BY round(distance_m, 3), iceberg_id) AS rank FROM (SELECT iceberg_id, min(d) AS distance_m, arg_min(hours, d) AS at_hours
    FROM approach GROUP BY iceberg_id)"""))
def corridor_rank(spark, sf):
    near = op.nearest_approach(berg_states(spark, sf), START, GOAL).withColumn("distance_m", F.round("distance_m", 3))
    return global_rank(near, ["distance_m", "iceberg_id"], "rank")
