"""Queries that write, read back and re-use stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import date_from_yyyyddd
from ..sources import sinks
from ..sources import tables as t
from ..sources.tracks_csv import read_tracks
from . import cost as cq
from . import drift as dr
from . import exposure as xp
from .registry import query
from .sql import using
from .tracks import wide_tracks

_FAMILIES = {"nic_sass_size": ["nic_1", "nic_2", "nic_3", "sass_1", "sass_2", "sass_3", "size_1", "size_2"],
             "nic_size": ["nic_1", "nic_2", "nic_3", "size_1", "size_2"], "ascat": ["ascat_1", "ascat_2"],
             "qscat_ers": ["qscat_1", "qscat_2", "qscat_3", "ers_1", "ers_2"]}


@query("track_union", using("sightings", """SELECT schema_family, sensor, count(*) AS fixes, count(DISTINCT iceberg_id) AS icebergs,
    count(flag) AS flagged, min(day) AS first_day, max(day) AS last_day, round(avg(size), 6) AS mean_size_km, round(avg(lat), 6) AS mean_lat FROM (
    SELECT 'nic+sass+size' AS schema_family, CASE sensor WHEN 'view' THEN 'nic' ELSE 'sass' END AS sensor, iceberg_id, day, flag, lat, size
      FROM l WHERE sensor IN ('view', 'click') UNION ALL
    SELECT 'nic+size', 'nic', iceberg_id, day, flag, lat, size FROM l WHERE sensor = 'view' UNION ALL
    SELECT 'ascat', 'ascat', iceberg_id, day, NULL, lat, NULL FROM l WHERE sensor = 'purchase' UNION ALL
    SELECT 'ers+qscat', CASE sensor WHEN 'signup' THEN 'qscat' ELSE 'ers' END, iceberg_id, day, CASE WHEN sensor = 'signup' THEN flag END, lat, NULL
      FROM l WHERE sensor IN ('signup', 'error')) GROUP BY ALL""", also="""l AS (
    SELECT s.iceberg_id, s.sensor, s.day, s.flag, round(s.lat, 6) AS lat, CASE WHEN m % 20 > 0 THEN (m % 20) * CAST(1.852 AS DOUBLE) END AS size
    FROM (SELECT *, row_number() OVER (PARTITION BY iceberg_id, sensor, day ORDER BY src DESC) AS rn FROM sightings) s
    JOIN (SELECT iceberg_id, day, max(src) AS m FROM sightings GROUP BY 1, 2) d
      ON d.iceberg_id = s.iceberg_id AND d.day = s.day WHERE rn = 1)"""))
def track_union(spark, sf):
    """Four header families and one malformed file, written as CSV and read back as one table."""
    root = sinks.scratch_path(spark, "tracks")
    wide = wide_tracks(spark, sf).withColumn("date", F.date_format("date", "yyyyDDD"))
    for name, cols in _FAMILIES.items():
        wide.select("date", "iceberg_id", *cols).write.option("header", "true").csv(f"{root}/{name}")
    wide.select("date", F.col("nic_1").alias("nic_1"), F.lit("x").alias("comment")).write.option("header", "true").csv(f"{root}/bad")
    seen, refused = read_tracks(spark, root)
    day = date_from_yyyyddd(F.col("date"))
    return (seen.groupBy("schema_family", "sensor").agg(
        F.count(F.lit(1)).alias("fixes"), F.countDistinct("iceberg_id").alias("icebergs"), F.count("flag").alias("flagged"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.round(F.avg("size_major_km"), 6).alias("mean_size_km"),
        F.round(F.avg("lat"), 6).alias("mean_lat")))


@query("sink_predictions", using("horizon_rows", """SELECT prev_day AS start_date, horizon_h, count(*) AS rows, round(avg(lat), 6) AS mean_lat,
    round(max(radius_km), 6) AS radius_km FROM horizon_rows GROUP BY ALL"""))
def sink_predictions(spark, sf):
    """Predictions written by start date and read back."""
    rows = dr.scored_population(spark, sf)
    out = dr.op.at_horizons(rows, dr.op.calibrated_radius(rows)).select(
        "iceberg_id", "sensor", F.col("prev_day").alias("start_date"), "horizon_h", "lat", "lon", "radius_km")
    path = sinks.scratch_path(spark, "predictions")
    sinks.write_predictions(out, path)
    return spark.read.schema(out.schema).parquet(path).groupBy("start_date", "horizon_h").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("lat"), 6).alias("mean_lat"), F.round(F.max("radius_km"), 6).alias("radius_km"))


@query("sink_exposure", using("field", """SELECT bucket, count(*) AS cells, round(sum(exposure), 4) AS total FROM field WHERE exposure > 0 GROUP BY bucket"""))
def sink_exposure(spark, sf):
    field = xp.exposure_field(spark, sf)
    path = sinks.scratch_path(spark, "exposure")
    sinks.write_exposure(field, path)
    return spark.read.schema(field.schema).parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("exposure"), 4).alias("total"))


@query("sink_report", using("env", """SELECT zone, count(*) AS cells, round(avg(env_cost) FILTER (WHERE isfinite(env_cost)), 6) AS mean_cost FROM env GROUP BY zone"""))
def sink_report(spark, sf):
    """A nested report per zone, written as JSON and read back."""
    x = F.when(F.col("env_cost") < float("inf"), F.col("env_cost"))
    report = cq.environment(spark, sf).groupBy("zone").agg(F.struct(F.count(F.lit(1)).alias("cells"), F.avg(x).alias("mean_cost")).alias("cost"))
    path = sinks.scratch_path(spark, "report")
    sinks.write_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    return back.select("zone", "cost.cells", F.round("cost.mean_cost", 6).alias("mean_cost"))


@query("case_increment", """SELECT CAST(o_orderdate AS DATE) AS origin, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def case_increment(spark, sf):
    """Cases of the first years are stored first; the second run computes only the missing origins."""
    orders = t.read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("origin"), "o_totalprice")
    origins = orders.select("origin").distinct()
    path = sinks.scratch_path(spark, "cases")

    def compute(missing):
        return orders.join(missing, "origin", "left_semi").groupBy("origin").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))

    sinks.append_new(origins.where("origin < '1998-01-01'"), path, ["origin"], compute)
    stored = sinks.append_new(origins, path, ["origin"], compute)
    return stored.select("origin", "orders", F.round("total", 2).alias("total"))
