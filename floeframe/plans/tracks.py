"""Track queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import tracks as op
from ..sources import tables as t
from .registry import query
from .sql import define, gc_m, using

_R = 6371008.8
_DL = "((((lon1 - lon0) + 540.0) % 360.0 + 360.0) % 360.0 - 180.0)"
_PAIR = ", ".join(f"lag({c}) OVER w AS {a}" for c, a in [
    ("day", "prev_day"), ("lat", "lat0"), ("lon", "lon0"), ("flag", "flag0"), ("wind_u", "p_wind_u"),
    ("wind_v", "p_wind_v"), ("cur_u", "p_cur_u"), ("cur_v", "p_cur_v")])
define("steps", f"""SELECT *, {gc_m('lat0', 'lon0', 'lat1', 'lon1')} AS displacement_m,
    {_R} * radians({_DL}) * cos(radians((lat0 + lat1) * 0.5)) / elapsed_s AS vel_e,
    {_R} * radians(lat1 - lat0) / elapsed_s AS vel_n,
    CASE WHEN elapsed_days > 1 THEN 'gap_' || elapsed_days || 'd' END AS gap
    FROM (SELECT iceberg_id, sensor, prev_day, day, CAST(day - prev_day AS INTEGER) AS elapsed_days,
          CAST(day - prev_day AS DOUBLE) * 86400 AS elapsed_s, lat0, lon0, lat AS lat1, lon AS lon1,
          flag0 = 0 OR flag = 0 AS interpolated,
          p_wind_u AS wind_u, p_wind_v AS wind_v, p_cur_u AS cur_u, p_cur_v AS cur_v
          FROM (SELECT *, {_PAIR} FROM sightings WINDOW w AS (PARTITION BY iceberg_id, sensor ORDER BY day, src))
          WHERE day > prev_day)""", ["sightings"])
define("vel", """SELECT s.*, p.vel_e AS prev_e, p.vel_n AS prev_n FROM steps s LEFT JOIN steps p
    ON p.iceberg_id = s.iceberg_id AND p.sensor = s.sensor AND p.day = s.prev_day""", ["steps"])

_CUR = "(cur_u IS NOT NULL AND cur_v IS NOT NULL)"
_WIND = "(wind_u IS NOT NULL AND wind_v IS NOT NULL)"
_QUALITY = "CASE WHEN interpolated = FALSE THEN 'observed_to_observed' ELSE 'interpolated_endpoint' END"
WIDE = {"nic": "view", "sass": "click", "ascat": "purchase", "qscat": "signup", "ers": "error"}
FLAGLESS = ("ascat", "ers")                         # these families have no flag column


def wide_tracks(spark, sf):
    """Wide archive rows: five sensor triplets, sizes and one unknown column."""
    raw = t.sightings(spark, sf)
    aggs = []
    for name, event in WIDE.items():
        mine = F.col("sensor") == event
        last = F.max_by(F.struct(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "flag"),
                        F.when(mine, F.col("src")))
        aggs.append(last.alias(name))
    days = raw.groupBy("iceberg_id", "day").agg(*aggs, F.max("src").alias("src"))
    cols = ["iceberg_id", F.col("day").alias("date"), (F.col("src") % 20).cast("string").alias("size_1"),
            (F.col("src") % 7).cast("string").alias("size_2"), F.col("src").cast("string").alias("mask")]
    for name in WIDE:
        cols += [F.coalesce(F.col(f"{name}.lat").cast("string"), F.lit("0")).alias(f"{name}_1"),
                 F.coalesce(F.col(f"{name}.lon").cast("string"), F.lit("0")).alias(f"{name}_2")]
        if name not in FLAGLESS:
            cols.append(F.coalesce(F.col(f"{name}.flag").cast("string"), F.lit("1")).alias(f"{name}_3"))
    return days.select(*cols)


_MELT_ORACLE = using("sightings", """SELECT d.iceberg_id, d.date,
    CASE l.sensor WHEN 'view' THEN 'nic' WHEN 'click' THEN 'sass' WHEN 'purchase' THEN 'ascat' WHEN 'signup' THEN 'qscat' ELSE 'ers' END AS sensor,
    round(l.lat, 6) AS lat, round(l.lon, 6) AS lon,
    CASE WHEN l.sensor NOT IN ('purchase', 'error') THEN CAST(l.flag AS VARCHAR) END AS flag,
    CASE WHEN l.sensor NOT IN ('purchase', 'error') THEN l.flag = 0 END AS is_interpolated,
    CASE WHEN m % 20 > 0 THEN round((m % 20) * CAST(1.852 AS DOUBLE), 6) END AS size_major_km,
    CAST(m AS VARCHAR) AS mask
    FROM d JOIN l ON l.iceberg_id = d.iceberg_id AND l.day = d.date AND l.rn = 1""", also="""d AS (SELECT iceberg_id, day AS date, max(src) AS m
      FROM sightings GROUP BY 1, 2),
    l AS (SELECT *, row_number() OVER (PARTITION BY iceberg_id, sensor, day ORDER BY src DESC) AS rn
      FROM sightings)""")


@query("melt_sensors", _MELT_ORACLE)
def melt_sensors(spark, sf):
    out = op.melt_sensors(wide_tracks(spark, sf), list(WIDE))
    return out.select("iceberg_id", "date", "sensor", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
                      "flag", "is_interpolated", F.round("size_major_km", 6).alias("size_major_km"),
                      F.col("source_fields")["mask"].alias("mask"))


@query("steps", using("steps", """SELECT iceberg_id, sensor, prev_day, day, elapsed_days, elapsed_s, interpolated, gap,
    round(displacement_m / 1000, 6) AS displacement_km, round(displacement_m / elapsed_s, 6) AS speed,
    round(vel_e, 6) + 0.0 AS vel_e, round(vel_n, 6) + 0.0 AS vel_n FROM steps"""))
def steps(spark, sf):
    s = op.steps(t.sightings(spark, sf))
    return s.select("iceberg_id", "sensor", "prev_day", "day", "elapsed_days", "elapsed_s", "interpolated", "gap",
                    F.round(F.col("displacement_m") / 1000, 6).alias("displacement_km"),
                    F.round(F.col("displacement_m") / F.col("elapsed_s"), 6).alias("speed"),
                    (F.round("vel_e", 6) + 0.0).alias("vel_e"), (F.round("vel_n", 6) + 0.0).alias("vel_n"))


@query("step_audit", using("sightings", """SELECT sensor, count(*) AS reports, count(DISTINCT (iceberg_id, day)) AS fix_days,
    count(*) - count(DISTINCT (iceberg_id, day)) AS zero_elapsed_pairs FROM sightings GROUP BY sensor"""))
def step_audit(spark, sf):
    return op.step_audit(t.sightings(spark, sf))


@query("dup_groups", using("sightings", """SELECT src, iceberg_id, sensor, day,
    count(*) OVER (PARTITION BY iceberg_id, sensor, day) AS group_size FROM sightings"""))
def dup_groups(spark, sf):
    return op.duplicate_groups(t.sightings(spark, sf).select("iceberg_id", "sensor", "day", "src"))


@query("prev_velocity", using("vel", """SELECT iceberg_id, sensor, prev_day, day, round(prev_e, 6) + 0.0 AS prev_e,
    round(prev_n, 6) + 0.0 AS prev_n FROM vel"""))
def prev_velocity(spark, sf):
    v = op.previous_velocity(op.steps(t.sightings(spark, sf)))
    return v.select("iceberg_id", "sensor", "prev_day", "day", (F.round("prev_e", 6) + 0.0).alias("prev_e"),
                    (F.round("prev_n", 6) + 0.0).alias("prev_n"))


@query("match_states", using("steps", f"""SELECT
    CASE WHEN elapsed_days <= 3 THEN CAST(elapsed_days AS VARCHAR) ELSE 'gt3' END AS elapsed_class, {_QUALITY} AS quality,
    count(*) AS steps, count(*) FILTER (WHERE {_CUR}) AS with_current, count(*) FILTER (WHERE {_WIND}) AS with_wind,
    count(*) FILTER (WHERE {_CUR} AND {_WIND}) AS fully_matched, count(*) FILTER (WHERE {_CUR} AND NOT {_WIND}) AS current_only,
    count(*) FILTER (WHERE NOT {_CUR} AND {_WIND}) AS wind_only,
    count(*) FILTER (WHERE NOT {_CUR} AND NOT {_WIND}) AS unmatched FROM steps GROUP BY 1, 2"""))
def match_states(spark, sf):
    return op.match_summary(op.steps(t.sightings(spark, sf)))


@query("truth_join", using("observations steps", """SELECT o.sensor, count(*) AS matched, count(s.day) AS with_truth,
    count(*) - count(s.day) AS without_truth, round(avg(s.lat1), 6) AS mean_end_lat
    FROM observations o LEFT JOIN steps s ON s.iceberg_id = o.iceberg_id AND s.sensor = o.sensor
    AND s.prev_day = o.day AND s.day = o.day + 1 GROUP BY 1"""))
def truth_join(spark, sf):
    obs = t.observations(spark, sf)
    matches = obs.select("iceberg_id", "sensor", F.col("day").alias("start_day"),
                         F.date_add("day", 1).alias("end_day"))
    out = op.attach_truth(matches, op.steps(t.sightings(spark, sf)))
    return out.groupBy("sensor").agg(
        F.count(F.lit(1)).alias("matched"), F.count("lat1").alias("with_truth"),
        (F.count(F.lit(1)) - F.count("lat1")).alias("without_truth"), F.round(F.avg("lat1"), 6).alias("mean_end_lat"))


# A 6 x 12 degree wind lattice: node values are means of the reports around the node.
_NODE = """SELECT day, CAST(floor((lat + 80) / 6 + 0.5) AS INTEGER) AS lat_i,
    CAST(floor((lon + 180) / 12 + 0.5) AS INTEGER) % 30 AS lon_i, avg(wind_u) AS u, avg(wind_v) AS v
    FROM sightings WHERE wind_u IS NOT NULL GROUP BY ALL"""
define("wind", _NODE, ["sightings"])


def wind_lattice(spark, sf):
    return (t.sightings(spark, sf).where("wind_u IS NOT NULL")
            .groupBy("day", F.floor((F.col("lat") + 80) / 6 + 0.5).cast("int").alias("lat_i"),
                     (F.floor((F.col("lon") + 180) / 12 + 0.5) % 30).cast("int").alias("lon_i"))
            .agg(F.avg("wind_u").alias("u"), F.avg("wind_v").alias("v")))


@query("wind_scan", using("wind", """SELECT day, count(*) AS nodes, round(avg(sqrt(u * u + v * v)), 6) AS mean_speed
    FROM wind WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY day"""))
def wind_scan(spark, sf):
    return (wind_lattice(spark, sf).where(F.col("day").between("2024-01-05", "2024-01-20"))
            .groupBy("day").agg(F.count(F.lit(1)).alias("nodes"),
                                F.round(F.avg(F.hypot("u", "v")), 6).alias("mean_speed")))


def _blend(n: str) -> str:
    return (f"a.{n} * (1 - fy) * (1 - fx) + b.{n} * (1 - fy) * fx + c.{n} * fy * (1 - fx) + d.{n} * fy * fx")


_CORNER = " ".join(f"LEFT JOIN wind {a} ON {a}.day = p.day AND {a}.lat_i = i + {y} AND {a}.lon_i = (j + {x}) % 30"
                   for a, y, x in [("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1)])


@query("wind_bilinear", using("observations wind", f"""SELECT p.src, round({_blend('u')}, 6) AS sample_u,
    round({_blend('v')}, 6) AS sample_v,
    CASE WHEN a.u IS NULL OR b.u IS NULL OR c.u IS NULL OR d.u IS NULL THEN 'corner_missing' END AS reason
    FROM p {_CORNER}""", also="""p AS (SELECT *, CAST(floor((lat + 80) / 6) AS INTEGER) AS i,
      CAST(floor((lon + 180) / 12) AS INTEGER) % 30 AS j, (lat + 80) / 6 - floor((lat + 80) / 6) AS fy,
      (lon + 180) / 12 - floor((lon + 180) / 12) AS fx FROM observations)"""))
def wind_bilinear(spark, sf):
    corners = op.lattice_corners(wind_lattice(spark, sf), 30)
    out = op.bilinear(t.observations(spark, sf).select("src", "day", "lat", "lon"), corners,
                      -80.0, 6.0, -180.0, 12.0, 30)
    return out.select("src", F.round("sample_u", 6).alias("sample_u"), F.round("sample_v", 6).alias("sample_v"), "reason")


_T = "tan(pi() / 4 - {p} / 2) / pow((1 - 0.0818191908426215 * sin({p})) / (1 + 0.0818191908426215 * sin({p})), 0.0818191908426215 / 2)"
_SC = "(0.0818191908426215 * sin(radians(70.0)))"
_RHO = (f"(6378137.0 * (cos(radians(70.0)) / sqrt(1 - {_SC} * {_SC})) / (" + _T.format(p="radians(70.0)") + ") * ("
        + _T.format(p="radians(-lat)") + "))")
define("projected", f"""SELECT *, CAST(floor((4350000.0 - {_RHO} * cos(radians(lon))) / 500000.0) AS INTEGER) AS gr,
    CAST(floor(({_RHO} * sin(radians(lon)) + 3950000.0) / 500000.0) AS INTEGER) AS gc FROM sightings""", ["sightings"])
define("buoys", """SELECT day, gr, gc, avg(cur_u) AS u, avg(cur_v) AS v FROM projected
    WHERE sensor = 'signup' AND cur_u IS NOT NULL GROUP BY ALL""", ["projected"])


@query("point_to_cell", using("projected buoys", """SELECT p.src, p.gr, p.gc, round(b.u, 6) + 0.0 AS u, round(b.v, 6) + 0.0 AS v
    FROM projected p LEFT JOIN buoys b USING (day, gr, gc) WHERE p.sensor <> 'signup'"""))
def point_to_cell(spark, sf):
    """Current of the grid cell and day a fix lies in; NULL where the field has no value."""
    located = op.projected_cell(t.sightings(spark, sf), 500000.0)
    field = (located.where((F.col("sensor") == "signup") & F.col("cur_u").isNotNull())
             .groupBy("day", "gr", "gc").agg(F.avg("cur_u").alias("u"), F.avg("cur_v").alias("v")))
    return (located.where("sensor <> 'signup'").join(field, ["day", "gr", "gc"], "left")
            .select("src", "gr", "gc", (F.round("u", 6) + 0.0).alias("u"), (F.round("v", 6) + 0.0).alias("v")))


@query("step_bbox", using("steps", f"""SELECT least(ceil((max(lat0) + 1) * 4) / 4, 90.0) AS north,
    greatest(floor((min(lon0) - 1) * 4) / 4, -180.0) AS west, greatest(floor((min(lat0) - 1) * 4) / 4, -90.0) AS south,
    least(ceil((max(lon0) + 1) * 4) / 4, 180.0) AS east, count(*) AS candidates FROM steps WHERE {_CUR}"""))
def step_bbox(spark, sf):
    """Extent of the steps that have a current, snapped outward to a quarter degree."""
    s = op.steps(t.sightings(spark, sf)).where(op.has_current())
    return op.bounding_box(s.select(F.col("lat0").alias("lat"), F.col("lon0").alias("lon")))


@query("date_codes", """SELECT event_id, code, TRY_CAST(CASE WHEN d BETWEEN 1 AND 365
        OR (d = 366 AND y % 4 = 0) THEN make_date(y, 1, 1) + (d - 1) END AS DATE) AS parsed
    FROM (SELECT event_id, CAST(2020 + event_id % 6 AS INTEGER) AS y, CAST(event_id % 371 AS INTEGER) AS d,
        (2020 + event_id % 6) || lpad(CAST(event_id % 371 AS VARCHAR), 3, '0') AS code FROM events)""")
def date_codes(spark, sf):
    e = F.col("event_id")
    code = F.concat((e % 6 + 2020).cast("string"), F.lpad((e % 371).cast("string"), 3, "0"))
    return (t.read(spark, sf, "events").select("event_id", code.alias("code"))
            .withColumn("parsed", ex.date_from_yyyyddd(F.col("code"))))


@query("vector_ops", """SELECT event_id, round(sqrt(u * u + v * v), 6) AS speed,
    round(u * cos(radians(30.0)) - v * sin(radians(30.0)), 6) + 0.0 AS turned_e,
    round(u * sin(radians(30.0)) + v * cos(radians(30.0)), 6) + 0.0 AS turned_n,
    round(u * cos(radians(lon)) + v * sin(radians(lon)), 6) + 0.0 AS px,
    round(-u * sin(radians(lon)) + v * cos(radians(lon)), 6) + 0.0 AS py, round(lon2, 6) AS lon2, TRUE AS round_trip
    FROM (SELECT event_id, value / 50 AS u, value / 90 - 1 AS v, (user_id * 29 % 360) - 180 AS lon,
          CASE WHEN raw >= -180 AND raw < 180 THEN raw ELSE ((raw + 180) % 360 + 360) % 360 - 180 END AS lon2
          FROM (SELECT *, CAST(user_id * 53 % 900 - 450 AS DOUBLE) AS raw FROM events))""")
def vector_ops(spark, sf):
    """Speed, turning, rotation into the grid basis and back, longitude wrapping."""
    raw = t.read(spark, sf, "events").select(
        "event_id", (F.col("value") / 50).alias("u"), (F.col("value") / 90 - 1).alias("v"),
        ((F.col("user_id") * 29 % 360) - 180).cast("double").alias("lon"),
        (F.col("user_id") * 53 % 900 - 450).cast("double").alias("raw"))
    u, v, lon = F.col("u"), F.col("v"), F.col("lon")
    te, tn = ex.turn(u, v, F.lit(30.0))
    px, py = ex.to_projected(u, v, lon)
    be, bn = ex.to_geographic(px, py, lon)
    same = (F.abs(be - u) < 1e-9) & (F.abs(bn - v) < 1e-9)
    return raw.select("event_id", F.round(F.hypot(u, v), 6).alias("speed"), (F.round(te, 6) + 0.0).alias("turned_e"),
                      (F.round(tn, 6) + 0.0).alias("turned_n"), (F.round(px, 6) + 0.0).alias("px"),
                      (F.round(py, 6) + 0.0).alias("py"),
                      F.round(ex.normalise_longitude(F.col("raw")), 6).alias("lon2"), same.alias("round_trip"))


@query("size_units", using("sightings", """SELECT src, round(size_km, 6) AS size_km FROM sightings"""))
def size_units(spark, sf):
    return t.sightings(spark, sf).select("src", F.round("size_km", 6).alias("size_km"))
