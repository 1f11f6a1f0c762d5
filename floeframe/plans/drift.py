"""Drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as op
from ..operators import tracks as tr
from ..session import stored
from ..sources import tables as t
from .registry import query
from .sql import define, gc_m, using
from .tracks import _CUR, _QUALITY, _WIND

_R = 6371008.8


def _advect(lat: str, lon: str, e: str, n: str, s: str) -> tuple[str, str]:
    end = f"(radians({lat}) + ({n}) * ({s}) / {_R})"
    out = f"({lon} + degrees(({e}) * ({s}) / ({_R} * cos((radians({lat}) + {end}) * 0.5))))"
    return (f"degrees({end})",
            f"CASE WHEN {out} >= -180 AND {out} < 180 THEN {out} ELSE (({out} + 180) % 360 + 360) % 360 - 180 END")


def _physics(windage: str, turn: str) -> tuple[str, str]:
    # the grid basis is orthonormal, so only the current is rotated back to east/north
    a, b = f"radians({turn})", "radians(lon0)"
    e = f"cur_u * cos({b}) - cur_v * sin({b}) + {windage} * (wind_u * cos({a}) - wind_v * sin({a}))"
    n = f"cur_u * sin({b}) + cur_v * cos({b}) + {windage} * (wind_u * sin({a}) + wind_v * cos({a}))"
    return e, n


def _scored(source: str, e: str, n: str) -> str:
    plat, plon = _advect("lat0", "lon0", e, n, "elapsed_s")
    dl = "((plon - lon1 + 540.0) % 360.0 + 360.0) % 360.0 - 180.0"
    return (f"SELECT *, {gc_m('plat', 'plon', 'lat1', 'lon1')} / 1000 AS err_km, "
            f"{_R} * radians({dl}) * cos(radians((plat + lat1) * 0.5)) AS err_e, "
            f"{_R} * radians(plat - lat1) AS err_n, {gc_m('lat0', 'lon0', 'plat', 'plon')} - displacement_m AS err_mag "
            f"FROM (SELECT *, {plat} AS plat, {plon} AS plon FROM {source})")


_ENV = f"{_CUR} AND {_WIND}"
define("env_steps", f"SELECT * FROM vel WHERE {_ENV}", ["vel"])
define("physics", _scored("env_steps", *_physics("0.02", "0.0")), ["env_steps"])
define("pop", f"""SELECT *, displacement_m > 0 AS moved FROM physics
    WHERE elapsed_days = 1 AND {_QUALITY} = 'observed_to_observed'""", ["physics"])
define("cuts", """SELECT min(prev_day) FILTER (WHERE rn = CAST(floor(n * 0.6::DOUBLE) AS BIGINT) + 1) AS d_train,
    min(prev_day) FILTER (WHERE rn = CAST(floor(n * 0.8::DOUBLE) AS BIGINT) + 1) AS d_val
    FROM (SELECT prev_day, row_number() OVER (ORDER BY prev_day) AS rn, count(*) OVER () AS n FROM pop WHERE moved)""", ["pop"])
define("split_pop", """SELECT pop.*, CASE WHEN prev_day < d_train THEN 'train' WHEN prev_day < d_val THEN 'validation'
    ELSE 'test' END AS split FROM pop, cuts""", ["pop", "cuts"])
define("radii", """SELECT quantile_cont(err_km, 0.5) AS q50, quantile_cont(err_km, 0.8) AS q80,
    quantile_cont(err_km, 0.9) AS q90 FROM split_pop WHERE moved AND split IN ('train', 'validation')""", ["split_pop"])

_SUMMARY = """count(*) AS n, round(avg(err_km), 6) AS mean_km, round(sqrt(avg(err_km * err_km)), 6) AS rmse_km,
    round(max(err_km), 6) AS max_km, round(avg(err_e) / 1000, 6) AS mean_east_km, round(avg(err_n) / 1000, 6) AS mean_north_km,
    round(avg(abs(err_e)) / 1000, 6) AS abs_east_km, round(avg(abs(err_n)) / 1000, 6) AS abs_north_km,
    round(avg(err_mag) / 1000, 6) AS mean_magnitude_km, round(quantile_cont(err_km, 0.5), 6) AS median_km,
    round(quantile_disc(err_km, 0.9), 6) AS p90_km"""


def _steps(spark, sf):
    return tr.steps(t.sightings(spark, sf))


def _env_steps(spark, sf):
    return tr.previous_velocity(_steps(spark, sf)).where(tr.has_current() & tr.has_wind())


def scored_population(spark, sf):
    """Scored population with its split; stored, because cuts, radii and results all read it."""
    pop = stored(op.with_physics(op.population(_steps(spark, sf))))
    return op.chronological_split(pop)


@query("drift_error", using("physics", f"SELECT elapsed_days, {_SUMMARY} FROM physics GROUP BY elapsed_days"))
def drift_error(spark, sf):
    rows = _steps(spark, sf).where(tr.has_current() & tr.has_wind())
    return op.error_summary(op.with_physics(rows), ["elapsed_days"])


define("both_physics", "SELECT 'physics' AS baseline, * FROM physics WHERE prev_e IS NOT NULL", ["physics"])
define("both_const", _scored("(SELECT 'persistence' AS baseline, * FROM env_steps WHERE prev_e IS NOT NULL)",
                             "prev_e", "prev_n"), ["env_steps"])


@query("common_rows", using("both_physics both_const", f"""SELECT baseline, {_SUMMARY} FROM
    (SELECT baseline, err_km, err_e, err_n, err_mag FROM both_physics UNION ALL
     SELECT baseline, err_km, err_e, err_n, err_mag FROM both_const) GROUP BY baseline"""))
def common_rows(spark, sf):
    """Both baselines on identical rows: those where each of them can be computed."""
    rows = _env_steps(spark, sf).where(F.col("prev_e").isNotNull())
    cols = ["baseline", "err_km", "err_e_m", "err_n_m", "err_mag_m"]
    both = (op.with_physics(rows).withColumn("baseline", F.lit("physics")).select(*cols)
            .unionByName(op.with_persistence(rows).withColumn("baseline", F.lit("persistence")).select(*cols)))
    return op.error_summary(both, ["baseline"])


@query("score_exclusions", using("vel", f"""SELECT CASE WHEN NOT ({_ENV}) AND prev_e IS NULL THEN 'missing_both'
    WHEN NOT ({_ENV}) THEN 'missing_current_or_wind' WHEN prev_e IS NULL THEN 'no_preceding_step' ELSE 'scored' END AS reason,
    count(*) AS n, count(*) FILTER (WHERE displacement_m = 0) AS not_moved FROM vel GROUP BY 1"""))
def score_exclusions(spark, sf):
    env, prev = tr.has_current() & tr.has_wind(), F.col("prev_e").isNotNull()
    rows = tr.previous_velocity(_steps(spark, sf))
    reason = (F.when(~env & ~prev, "missing_both").when(~env, "missing_current_or_wind")
              .when(~prev, "no_preceding_step").otherwise("scored"))
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"),
                                                    F.count_if(F.col("displacement_m") == 0).alias("not_moved"))


@query("population_filter", using("vel", f"""SELECT CASE WHEN elapsed_days <> 1 THEN 'wrong_window'
    WHEN {_QUALITY} <> 'observed_to_observed' THEN 'interpolated_endpoint'
    WHEN NOT ({_ENV}) THEN 'missing_current_or_wind' ELSE 'kept' END AS exclusion, count(*) AS n FROM vel GROUP BY 1"""))
def population_filter(spark, sf):
    return (_steps(spark, sf).groupBy(F.coalesce(op.exclusion(), F.lit("kept")).alias("exclusion"))
            .agg(F.count(F.lit(1)).alias("n")))


define("fit_rows", f"""SELECT *, row_number() OVER (ORDER BY prev_day, iceberg_id, sensor) AS rn, count(*) OVER () AS n
    FROM pop""", ["pop"])


@query("fit_split", using("fit_rows", """SELECT rn <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS fit, count(*) AS rows,
    min(prev_day) AS first_day, max(prev_day) AS last_day, round(avg(err_km), 6) AS mean_km FROM fit_rows GROUP BY 1"""))
def fit_split(spark, sf):
    rows = op.earliest_fraction(op.with_physics(op.population(_steps(spark, sf))))
    return rows.groupBy("fit").agg(F.count(F.lit(1)).alias("rows"), F.min("prev_day").alias("first_day"),
                                   F.max("prev_day").alias("last_day"), F.round(F.avg("err_km"), 6).alias("mean_km"))


@query("split_snap", using("split_pop", """SELECT split, count(*) AS rows, count(*) FILTER (WHERE moved) AS moved,
    min(prev_day) AS first_day, max(prev_day) AS last_day FROM split_pop GROUP BY split"""))
def split_snap(spark, sf):
    return (scored_population(spark, sf).groupBy("split")
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if("moved").alias("moved"),
                 F.min("prev_day").alias("first_day"), F.max("prev_day").alias("last_day")))


_TRY_E, _TRY_N = _physics("windage", "turn")
define("grid", """SELECT i * 13 + j AS ord, round(i * 0.1 / 40, 6)::DOUBLE AS windage, (-90 + j * 15)::DOUBLE AS turn
    FROM range(41) a(i), range(13) b(j)""")
define("fit_only", """SELECT lat0, lon0, lat1, lon1, elapsed_s, displacement_m, wind_u, wind_v, cur_u, cur_v FROM fit_rows
    WHERE rn <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT)""", ["fit_rows"])
define("sweep", "SELECT ord, windage, turn, round(avg(err_km), 6) AS mean_km FROM ("
       + _scored("(SELECT f.*, g.* FROM fit_only f, grid g)", _TRY_E, _TRY_N) + ") GROUP BY ALL", ["fit_only", "grid"])


def _fit_rows(spark, sf):
    """The fit set is small work to keep and read twice, so its lineage is cut once."""
    rows = op.earliest_fraction(op.population(_steps(spark, sf)))
    return stored(rows.where("fit"))


@query("calibration_grid", using("sweep", "SELECT CAST(ord AS INTEGER) AS ord, windage, turn, mean_km FROM sweep"))
def calibration_grid(spark, sf):
    return op.grid_errors(_fit_rows(spark, sf), op.coarse_grid())


define("coarse_best", "SELECT windage AS w0, turn AS t0 FROM sweep ORDER BY mean_km, ord LIMIT 1", ["sweep"])
define("fine", """SELECT (k + 8) * 13 + m + 6 AS ord, least(greatest(w0 + k * CAST(0.0025 AS DOUBLE) / 8, 0.0), 0.1)::DOUBLE AS windage,
    least(greatest(t0 + m * 15.0 / 6, -90.0), 90.0)::DOUBLE AS turn
    FROM range(-8, 9) a(k), range(-6, 7) b(m), coarse_best""", ["coarse_best"])
define("fine_sweep", "SELECT ord, windage, turn, round(avg(err_km), 6) AS mean_km FROM ("
       + _scored("(SELECT f.*, g.* FROM fit_only f, fine g)", _TRY_E, _TRY_N) + ") GROUP BY ALL", ["fit_only", "fine"])


@query("calibration_best", using("fine_sweep", """SELECT round(windage, 6) AS windage, round(turn, 4) AS turn, mean_km
    FROM fine_sweep ORDER BY mean_km, ord LIMIT 1"""))
def calibration_best(spark, sf):
    """Coarse winner refined by the finer sweep."""
    return op.calibrate(_fit_rows(spark, sf)).select(F.round("windage", 6).alias("windage"),
                                                     F.round("turn", 4).alias("turn"), "mean_km")


define("chosen", "SELECT windage AS w1, turn AS t1 FROM fine_sweep ORDER BY mean_km, ord LIMIT 1", ["fine_sweep"])
define("held", """SELECT lat0, lon0, lat1, lon1, elapsed_s, displacement_m, wind_u, wind_v, cur_u, cur_v, w1, t1
    FROM fit_rows, chosen WHERE rn > CAST(floor(n * 0.7::DOUBLE) AS BIGINT)""", ["fit_rows", "chosen"])


@query("calibration_effect", using("held", f"""SELECT 'configured' AS setting, count(*) AS n, round(avg(err_km), 6) AS mean_km
    FROM ({_scored('held', *_physics('0.02', '0.0'))}) UNION ALL
    SELECT 'fitted', count(*), round(avg(err_km), 6) FROM ({_scored('held', *_physics('w1', 't1'))})"""))
def calibration_effect(spark, sf):
    """Held-out error of the configured and of the fitted parameters."""
    rows = stored(op.earliest_fraction(op.population(_steps(spark, sf))))
    best = op.calibrate(rows.where("fit")).first()
    held = rows.where("NOT fit")
    parts = [op.with_physics(held, w, d).agg(F.lit(name).alias("setting"), F.count(F.lit(1)).alias("n"),
                                             F.round(F.avg("err_km"), 6).alias("mean_km"))
             for name, w, d in (("configured", 0.02, 0.0), ("fitted", best["windage"], best["turn"]))]
    return parts[0].unionByName(parts[1])


@query("radius_q90", using("radii", """SELECT s.*, round(q50, 6) AS q50, round(q80, 6) AS q80, round(q90, 6) AS q90 FROM radii,
    (SELECT count(*) AS n, min(prev_day) AS date_min, max(prev_day) AS date_max, round(avg(err_e) / 1000, 6) AS mean_east,
     round(avg(err_n) / 1000, 6) AS mean_north, round(stddev_samp(err_e) / 1000, 6) AS stdev_east,
     round(stddev_samp(err_n) / 1000, 6) AS stdev_north, round(corr(err_e, err_n), 6) AS correlation,
     round(stddev_samp(err_e) / stddev_samp(err_n), 6) AS anisotropy
     FROM split_pop WHERE moved AND split IN ('train', 'validation')) s"""))
def radius_q90(spark, sf):
    out = op.calibrated_radius(scored_population(spark, sf))
    return out.select("n", "date_min", "date_max", *[F.round(c, 6).alias(c) for c in (
        "mean_east", "mean_north", "stdev_east", "stdev_north", "correlation", "anisotropy", "q50", "q80", "q90")])


@query("coverage", using("radii", """SELECT split, count(*) AS n, round(avg(err_km), 6) AS mean_km,
    round(avg(CASE WHEN err_km <= q50 THEN 1.0 ELSE 0.0 END), 6) AS inside_q50,
    round(avg(CASE WHEN err_km <= q80 THEN 1.0 ELSE 0.0 END), 6) AS inside_q80,
    round(avg(CASE WHEN err_km <= q90 THEN 1.0 ELSE 0.0 END), 6) AS inside_q90
    FROM split_pop, radii WHERE moved GROUP BY split"""))
def coverage(spark, sf):
    rows = scored_population(spark, sf)
    return op.coverage(rows, op.calibrated_radius(rows))


_HLAT, _HLON = _advect("lat0", "lon0", "ve", "vn", "horizon_h * 3600")
define("horizon_rows", f"""SELECT *, {_HLAT} AS lat, {_HLON} AS lon, q90 * pow(horizon_h / 24, 0.5) AS radius_km FROM
    (SELECT *, {_R} * radians(((plon - lon0 + 540.0) % 360.0 + 360.0) % 360.0 - 180.0) * cos(radians((plat + lat0) * 0.5)) / elapsed_s AS ve,
     {_R} * radians(plat - lat0) / elapsed_s AS vn
     FROM split_pop, radii, (VALUES (24.0::DOUBLE), (48.0::DOUBLE), (72.0::DOUBLE)) h(horizon_h))""", ["split_pop", "radii"])


@query("horizon_expand", using("horizon_rows", """SELECT iceberg_id, sensor, prev_day, horizon_h, round(lat, 6) AS lat,
    round(lon, 6) AS lon, round(radius_km, 6) AS radius_km, horizon_h > 24 AS extrapolated_uncertainty,
    horizon_h * 3600 > elapsed_s AS extrapolated_position FROM horizon_rows"""))
def horizon_expand(spark, sf):
    rows = scored_population(spark, sf)
    out = op.at_horizons(rows, op.calibrated_radius(rows))
    return out.select("iceberg_id", "sensor", "prev_day", "horizon_h", F.round("lat", 6).alias("lat"),
                      F.round("lon", 6).alias("lon"), F.round("radius_km", 6).alias("radius_km"),
                      "extrapolated_uncertainty", "extrapolated_position")


@query("redundancy", using("split_pop", """SELECT pair, round(abs(corr(a, b)), 6) AS abs_corr,
    round(quantile_cont(a / nullif(b, 0), 0.5), 6) AS median_ratio, coalesce(abs(corr(a, b)) > 0.999, FALSE) AS degenerate
    FROM (SELECT 'plat/lat0' AS pair, plat AS a, lat0 AS b FROM split_pop UNION ALL
          SELECT 'wind_u/cur_u', wind_u, cur_u FROM split_pop UNION ALL
          SELECT 'wind_v/cur_v', wind_v, cur_v FROM split_pop) GROUP BY pair"""))
def redundancy(spark, sf):
    from ..operators.models import feature_redundancy
    return feature_redundancy(scored_population(spark, sf), [("plat", "lat0"), ("wind_u", "cur_u"), ("wind_v", "cur_v")])
