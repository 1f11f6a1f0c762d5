"""Cost-surface queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import cost as op
from ..operators import risk as rk
from ..operators import timeline as tl
from ..sources import tables as t
from . import exposure as xp
from . import risk as rp
from .registry import query
from .sql import define, using

KEYS = ["zone", "bucket", "r", "c"]
CURRENT_WEIGHT, COVERAGE_WEIGHT, ICE_WEIGHT = 0.3, 10.0, 5.0

define("masked", "SELECT *, coalesce(land, FALSE) OR coalesce(shelf, FALSE) AS blocked FROM cost_cells", ["cost_cells"])
define("env", f"""SELECT *, sic IS NULL OR u IS NULL OR v IS NULL AS lacks, CASE WHEN blocked OR sic IS NULL OR u IS NULL OR v IS NULL
    THEN 'Infinity'::DOUBLE ELSE 1 + least(greatest(sic, 0), 100) / 100 + {CURRENT_WEIGHT} * least(sqrt(u * u + v * v) / 0.5, 1.0) END AS env_cost
    FROM masked""", ["masked"])
define("terms", f"""SELECT zone, r, c, d.polygon_id, dominant_fraction, contributors, classification, mapping_sensitive, indeterminate,
    CASE WHEN NOT coverage OR is_water IS NULL THEN 'uncharted' WHEN is_water THEN 'charted_water' WHEN NOT has_rio THEN 'charted_unknown_regime'
      ELSE 'charted_ice' END AS state,
    CASE WHEN coverage AND NOT is_water THEN conservative ELSE 0 END AS pol_cons, CASE WHEN coverage AND NOT is_water THEN optimistic ELSE 0 END AS pol_opt,
    CASE WHEN coverage THEN {COVERAGE_WEIGHT} * least(greatest(1 - dominant_fraction, 0), 1) ELSE 0 END AS coverage_cost
    FROM (SELECT *, dominant_fraction >= 0.2 AS coverage FROM dominant) d LEFT JOIN pens USING (polygon_id)""", ["dominant", "pens"])
define("composed", """SELECT e.*, coalesce(t.state, 'uncharted') AS state, t.polygon_id, t.dominant_fraction, t.contributors, t.classification,
    t.mapping_sensitive, t.indeterminate, coalesce(pol_cons, 0) AS pol_cons, coalesce(pol_opt, 0) AS pol_opt, coalesce(coverage_cost, 0) AS coverage_cost,
    env_cost + coalesce(pol_cons, 0) + coalesce(coverage_cost, 0) AS conservative_cost,
    env_cost + coalesce(pol_opt, 0) + coalesce(coverage_cost, 0) AS optimistic_cost FROM env e LEFT JOIN terms t USING (zone, r, c)""",
       ["env", "terms"])
define("final", f"""SELECT k.*, f.iceberg_id, CASE WHEN b.bucket IS NOT NULL THEN coalesce(f.exposure, 0) END AS exposure,
    {ICE_WEIGHT} * coalesce(f.exposure, 0) AS ice_cost, conservative_cost + {ICE_WEIGHT} * coalesce(f.exposure, 0) AS final_cost,
    b.bucket IS NULL AS exposure_omitted FROM composed k LEFT JOIN field f ON f.bucket = k.bucket AND f.r = k.r AND f.c = k.c
    LEFT JOIN (SELECT DISTINCT bucket FROM bergs) b ON b.bucket = k.bucket""", ["composed", "field", "bergs"])


def masked(spark, sf):
    return op.combined_mask(t.cost_cells(spark, sf), {"land": "land", "ice_shelf": "shelf", "bathymetry": None})


def environment(spark, sf):
    return op.environment_cost(masked(spark, sf), current_weight=CURRENT_WEIGHT)


def chart(spark, sf):
    cells = rk.dominant_polygons(t.cell_polygon_area(spark, sf)).withColumn("coverage", F.col("dominant_fraction") >= 0.2)
    return op.chart_terms(cells, rp.penalty_records(spark, sf), COVERAGE_WEIGHT)


def composed(spark, sf):
    return op.compose(environment(spark, sf), chart(spark, sf), ["zone", "r", "c"])


def final(spark, sf):
    buckets = t.bergs(spark, sf).select("bucket")
    return op.with_icebergs(composed(spark, sf), xp.exposure_field(spark, sf), buckets, ICE_WEIGHT)


@query("mask_or", using("masked", """SELECT zone, bucket, r, c, blocked, 'land,ice_shelf' AS supplied FROM masked"""))
def mask_or(spark, sf):
    return masked(spark, sf).select(*KEYS, "blocked", F.array_join("supplied", ",").alias("supplied"))


@query("env_cost", using("env", "SELECT zone, bucket, r, c, round(env_cost, 6) AS env_cost, lacks AND NOT blocked AS no_data FROM env"))
def env_cost(spark, sf):
    return environment(spark, sf).select(*KEYS, rounded(F.col("env_cost"), 6).alias("env_cost"), "no_data")


@query("composed_cost", using("composed", """SELECT zone, bucket, r, c, state, round(coverage_cost, 6) AS coverage_cost,
    round(conservative_cost, 6) AS conservative_cost, round(optimistic_cost, 6) AS optimistic_cost FROM composed"""))
def composed_cost(spark, sf):
    return composed(spark, sf).select(*KEYS, "state", *[rounded(F.col(c), 6).alias(c) for c in ("coverage_cost", "conservative_cost", "optimistic_cost")])


@query("composition_summary", using("composed", """SELECT state, pol_cons AS penalty, count(*) AS cells, count(*) FILTER (WHERE isfinite(env_cost)) AS finite,
    count(*) FILTER (WHERE contributors >= 2) AS mixed, count(*) FILTER (WHERE state <> 'uncharted' AND dominant_fraction < 1) AS partial,
    round(max(conservative_cost) FILTER (WHERE isfinite(env_cost)), 6) AS max_conservative FROM composed GROUP BY ROLLUP (state, pol_cons)"""))
def composition_summary(spark, sf):
    ok = op.finite(F.col("env_cost"))
    return (composed(spark, sf).withColumnRenamed("pol_cons", "penalty").rollup("state", "penalty").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(ok).alias("finite"), F.count_if(F.col("contributors") >= 2).alias("mixed"),
        F.count_if((F.col("state") != "uncharted") & (F.col("dominant_fraction") < 1)).alias("partial"),
        F.round(F.max(F.when(ok, F.col("conservative_cost"))), 6).alias("max_conservative")))


@query("cost_summary", using("env", """SELECT zone, count(*) AS cells, count(*) FILTER (WHERE isfinite(env_cost)) AS navigable,
    count(*) FILTER (WHERE blocked) AS blocked, count(*) FILTER (WHERE lacks AND NOT blocked) AS no_data,
    round(min(env_cost) FILTER (WHERE isfinite(env_cost)), 6) AS min_cost, round(avg(env_cost) FILTER (WHERE isfinite(env_cost)), 6) AS mean_cost,
    round(max(env_cost) FILTER (WHERE isfinite(env_cost)), 6) AS max_cost FROM env GROUP BY ROLLUP (zone)"""))
def cost_summary(spark, sf):
    x = F.when(op.finite(F.col("env_cost")), F.col("env_cost"))
    return environment(spark, sf).rollup("zone").agg(
        F.count(F.lit(1)).alias("cells"), F.count(x).alias("navigable"), F.count_if("blocked").alias("blocked"),
        F.count_if("no_data").alias("no_data"), F.round(F.min(x), 6).alias("min_cost"), F.round(F.avg(x), 6).alias("mean_cost"),
        F.round(F.max(x), 6).alias("max_cost"))


@query("iceberg_cost", using("final", """SELECT zone, bucket, r, c, round(exposure, 6) AS exposure, round(final_cost, 6) AS final_cost,
    exposure_omitted FROM final"""))
def iceberg_cost(spark, sf):
    return final(spark, sf).select(*KEYS, F.round("exposure", 6).alias("exposure"), F.round("final_cost", 6).alias("final_cost"), "exposure_omitted")


@query("objective_costs", using("final", """SELECT profile, count(*) AS cells, count(*) FILTER (WHERE isfinite(cost)) AS priceable,
    count(*) FILTER (WHERE cost IS NULL) AS refused, round(sum(cost) FILTER (WHERE isfinite(cost)), 4) AS total FROM (
    SELECT profile, CASE WHEN NOT isfinite(final_cost) THEN 'Infinity'::DOUBLE WHEN profile = 'fastest' THEN 0.2::DOUBLE
      WHEN profile = 'shortest_distance' THEN 1.0::DOUBLE WHEN profile = 'fuel_efficient' THEN CASE WHEN sic BETWEEN 0 AND 100 THEN 1 + 2 * pow(sic / 100, 1.5) END
      ELSE final_cost END AS cost
    FROM final, (VALUES ('fastest'), ('shortest_distance'), ('fuel_efficient'), ('risk_oriented')) p(profile)) GROUP BY profile"""))
def objective_costs(spark, sf):
    costs = op.objective_costs(final(spark, sf), KEYS, t.SPEED_MPS)
    x = F.when(op.finite(F.col("cost")), F.col("cost"))
    return costs.groupBy("profile").agg(F.count(F.lit(1)).alias("cells"), F.count(x).alias("priceable"),
                                        F.count_if(F.col("cost").isNull()).alias("refused"), F.round(F.sum(x), 4).alias("total"))


@query("quality_checks", using("final", """SELECT 'missing_cost' AS "check", count(*) FILTER (WHERE final_cost IS NULL) AS cells FROM final UNION ALL
    SELECT 'negative_cost', count(*) FILTER (WHERE final_cost < 0) FROM final UNION ALL
    SELECT 'exposure_out_of_range', count(*) FILTER (WHERE exposure NOT BETWEEN 0 AND 1) FROM final UNION ALL
    SELECT 'concentration_out_of_range', count(*) FILTER (WHERE sic NOT BETWEEN 0 AND 100) FROM final UNION ALL
    SELECT 'priceable', count(*) FILTER (WHERE isfinite(final_cost)) FROM final UNION ALL
    SELECT 'duplicate_cells', count(*) FROM (SELECT 1 FROM final GROUP BY zone, bucket, r, c HAVING count(*) > 1)"""))
def quality_checks(spark, sf):
    return op.quality_checks(final(spark, sf), KEYS)


define("requests", """SELECT o_orderkey AS request, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS departure, CAST(b AS INTEGER) AS bucket
    FROM orders, range(9) x(b)""")
define("fields", """SELECT CAST(o_orderdate AS DATE) AS origin, 24 AS lead_h, CAST(o_orderdate AS DATE) + 1 AS valid_day FROM orders WHERE o_orderstatus = 'P' UNION
    SELECT CAST(o_orderdate AS DATE), 48, CAST(o_orderdate AS DATE) + 2 FROM orders WHERE o_orderpriority = '1-URGENT'""")
define("sources", """SELECT request, bucket, valid_from, want_day, base_day, seen,
    CASE WHEN lead_h IS NOT NULL THEN 'model_forecast' WHEN want_day = base_day AND seen THEN 'observed' ELSE 'persistence' END AS source, lead_h
    FROM (SELECT request, bucket, valid_from, CAST(valid_from AS DATE) AS want_day, CAST(departure AS DATE) AS base_day,
      CAST(valid_from AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'O') AS seen,
      (SELECT min(f.lead_h) FROM fields f WHERE f.origin = CAST(departure AS DATE) AND CAST(f.valid_day AS TIMESTAMP) <= valid_from
         AND valid_from + to_hours(6) <= CAST(f.valid_day + 1 AS TIMESTAMP)) AS lead_h
      FROM (SELECT *, departure + to_hours(bucket * 6) AS valid_from FROM requests))""", ["requests", "fields"])


def bucket_requests(spark, sf):
    """Nine six-hour buckets after each order's departure; the archive's forecasts and observed days."""
    orders = t.read(spark, sf, "orders")
    hour = F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    requests = orders.select(F.col("o_orderkey").alias("request"), (F.col("o_orderdate") + hour).alias("departure"),
                             F.explode(F.array(*[F.lit(b) for b in range(9)])).alias("bucket"))
    day = F.col("o_orderdate").cast("date")
    fields = (orders.where("o_orderstatus = 'P'").select(day.alias("origin"), F.lit(24).alias("lead_h"), F.date_add(day, 1).alias("valid_day"))
              .unionByName(orders.where("o_orderpriority = '1-URGENT'")
                           .select(day.alias("origin"), F.lit(48).alias("lead_h"), F.date_add(day, 2).alias("valid_day"))))
    days = orders.where("o_orderstatus = 'O'").select(day.alias("day"))
    return requests, fields, days


def sources(spark, sf):
    return op.bucket_sources(*bucket_requests(spark, sf), 6.0)


@query("bucket_source", using("sources", """SELECT request, bucket, source, lead_h, source = 'persistence' AS persisted,
    CASE WHEN source = 'model_forecast' THEN want_day ELSE base_day END AS environment_day,
    seen AND want_day > base_day AS future_observation_available,
    CASE WHEN lead_h IS NOT NULL THEN NULL WHEN CAST(valid_from + INTERVAL 6 HOUR AS TIMESTAMP) > CAST(want_day + 1 AS TIMESTAMP) THEN 'window_spans_two_days'
      WHEN want_day = base_day THEN 'no_sub_daily_target' WHEN want_day - base_day > 2 THEN 'lead_not_modelled' ELSE 'no_forecast_for_day' END AS reason
    FROM sources"""))
def bucket_source(spark, sf):
    return sources(spark, sf).select("request", "bucket", "source", "lead_h", "persisted", "environment_day", "future_observation_available", "reason")


@query("timeline_summary", using("sources", """SELECT base_day, count(*) AS buckets, count(DISTINCT source) AS source_types, count(DISTINCT lead_h) AS leads,
    count(DISTINCT CASE WHEN source = 'model_forecast' THEN want_day ELSE base_day END) > 1 AS time_varying,
    string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM sources GROUP BY base_day"""))
def timeline_summary(spark, sf):
    # three source names exist, so the set is bounded
    return sources(spark, sf).groupBy("base_day").agg(
        F.count(F.lit(1)).alias("buckets"), F.countDistinct("source").alias("source_types"), F.countDistinct("lead_h").alias("leads"),
        (F.countDistinct("environment_day") > 1).alias("time_varying"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("date_alignment", using("sources", """SELECT request, bool_and(want_day = ed) AS aligned, count(*) AS rows, count(*) FILTER (WHERE want_day <> ed) AS misaligned,
    CASE WHEN bool_and(want_day = ed) THEN 'accepted' ELSE 'refused' END AS verdict
    FROM (SELECT *, CASE WHEN source = 'model_forecast' THEN want_day ELSE base_day END AS ed FROM sources) GROUP BY request"""))
def date_alignment(spark, sf):
    return op.date_alignment(sources(spark, sf), ["want_day", "environment_day"], ["request"])


_WINDOW = """SELECT request, CAST(b.bucket AS INTEGER) AS bucket, valid_from, CAST(departure AS DATE) AS base, CAST(valid_from AS DATE) AS want,
    CAST(departure AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'O') AS base_seen,
    CAST(valid_from AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'O') AS own_seen,
    (SELECT min(l) FROM (VALUES (24), (48)) x(l) WHERE CAST(departure AS DATE) + CAST(l // 24 AS INTEGER) = CAST(valid_from AS DATE)
       AND valid_from + to_hours(6) <= CAST(valid_from AS DATE) + INTERVAL 1 DAY) AS lead,
    date_diff('second', CAST(CAST(departure AS DATE) AS TIMESTAMP), valid_from) / 3600.0 AS asked
    FROM (SELECT *, departure + to_hours(bucket * 6) AS valid_from FROM requests) b"""
define("windowed", f"""SELECT w.*, f.lead_h AS made FROM ({_WINDOW}) w LEFT JOIN fields f ON f.origin = w.base AND f.lead_h = w.lead""", ["requests", "fields"])
_POLICY_SQL = {
    tl.PERSISTENCE: ("base_seen AND want = base", "'observed_analysis'", "base_seen", "base", "false", "'departure_analysis_absent'", "NULL"),
    tl.DATED_OBSERVATION: ("own_seen", "'observed_analysis'", "false", "want", "want > base", "'no_analysis_of_the_day'", "NULL"),
    tl.MODEL_FORECAST: ("made IS NOT NULL", "'model_forecast'", "false", "want", "false",
                        "CASE WHEN lead IS NOT NULL THEN 'field_not_made' WHEN asked = 0 THEN 'observation' WHEN asked IN (6, 12) THEN 'no_sub_daily_target' ELSE 'not_covered' END", "made"),
    tl.LONG_HORIZON: ("made IS NOT NULL", "'model_forecast'", "true", "want", "false", "CAST(NULL AS VARCHAR)", "made")}


def _policy_sql(policy: str) -> str:
    direct, name, carried, day, future, missing, lead = _POLICY_SQL[policy]
    return using("windowed", f"""SELECT request, bucket, source_type, lead_h, CASE source_type WHEN 'explicit_persistence' THEN base WHEN 'unavailable' THEN NULL ELSE {day} END
        AS environment_day, CASE WHEN source_type = 'explicit_persistence' THEN 'persisted_from_' || base END AS fallback,
        source_type = 'explicit_persistence' AS persisted, source_type = 'observed_analysis' AND {future} AS uses_future_observation,
        CASE WHEN source_type = 'unavailable' THEN {missing} END AS reason
        FROM (SELECT *, CAST({lead} AS INTEGER) AS lead_h, CASE WHEN {direct} THEN {name} WHEN {carried} THEN 'explicit_persistence' ELSE 'unavailable' END AS source_type FROM windowed)""")


def _policy(name: str, policy: str, on_missing: str):
    @query(name, _policy_sql(policy))
    def run(spark, sf):
        """Every bucket's environment under one policy."""
        return (tl.timeline(*bucket_requests(spark, sf), policy, 6 * 3600.0, on_missing)
                .select("request", "bucket", "source_type", "lead_h", "environment_day", "fallback", "persisted", "uses_future_observation", "reason"))
    return run


timeline_persistence = _policy("timeline_persistence", tl.PERSISTENCE, "refuse")
timeline_observation = _policy("timeline_observation", tl.DATED_OBSERVATION, "refuse")
timeline_forecast = _policy("timeline_forecast", tl.MODEL_FORECAST, "refuse")
timeline_evaluation = _policy("timeline_evaluation", tl.LONG_HORIZON, "persist")
