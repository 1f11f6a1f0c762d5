"""Drift baselines, calibration and empirical uncertainty radii."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions.ordered import exact_quantiles, global_rank
from ..session import spread, stored
from . import tracks as tr

# --- fixed values: limits of the two drift parameters --------------------------
WINDAGE = (0.0, 0.1)
TURN_DEG = (-90.0, 90.0)
COARSE = (40, 12)               # intervals of the first sweep
HORIZONS_H = [24.0, 48.0, 72.0]
# -------------------------------------------------------------------------------


def drift_velocity(windage: Column, turn_deg: Column) -> tuple[Column, Column]:
    """Current plus turned wind, summed in the grid basis, back as east/north."""
    we, wn = ex.turn(F.col("wind_u"), F.col("wind_v"), turn_deg)
    wx, wy = ex.to_projected(we, wn, F.col("lon0"))
    return ex.to_geographic(F.col("cur_u") + windage * wx, F.col("cur_v") + windage * wy, F.col("lon0"))


def with_physics(rows: DataFrame, windage=0.02, turn_deg=0.0) -> DataFrame:
    """Predicted end and its error against the observed end (which only ever scores)."""
    ve, vn = drift_velocity(F.lit(windage), F.lit(turn_deg))
    moved = rows.withColumn("_ve", ve).withColumn("_vn", vn)
    lat, lon = ex.advect(F.col("lat0"), F.col("lon0"), F.col("_ve"), F.col("_vn"), F.col("elapsed_s"))
    return _with_errors(moved.withColumn("plat", lat).withColumn("plon", lon).drop("_ve", "_vn"))


def with_persistence(rows: DataFrame) -> DataFrame:
    lat, lon = ex.advect(F.col("lat0"), F.col("lon0"), F.col("prev_e"), F.col("prev_n"), F.col("elapsed_s"))
    return _with_errors(rows.withColumn("plat", lat).withColumn("plon", lon))


def _with_errors(df: DataFrame) -> DataFrame:
    p, o = (F.col("plat"), F.col("plon")), (F.col("lat1"), F.col("lon1"))
    east, north = ex.displacement(*o, *p)
    made = ex.great_circle_m(F.col("lat0"), F.col("lon0"), *p)
    return (df.withColumn("err_km", ex.great_circle_m(*p, *o) / 1000)
            .withColumn("err_e_m", east).withColumn("err_n_m", north)
            .withColumn("err_mag_m", made - F.col("displacement_m")))


def error_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, median, RMSE, nearest-rank p90, maximum and signed components per key."""
    df = stored(df.select(*keys, "err_km", "err_e_m", "err_n_m", "err_mag_m"))     # read by two branches
    km = lambda c: F.round(c / 1000, 6)
    stats = df.groupBy(*keys).agg(
        F.count("err_km").alias("n"), F.round(F.avg("err_km"), 6).alias("mean_km"),
        F.round(F.sqrt(F.avg(F.col("err_km") * F.col("err_km"))), 6).alias("rmse_km"),
        F.round(F.max("err_km"), 6).alias("max_km"),
        km(F.avg("err_e_m")).alias("mean_east_km"), km(F.avg("err_n_m")).alias("mean_north_km"),
        km(F.avg(F.abs("err_e_m"))).alias("abs_east_km"), km(F.avg(F.abs("err_n_m"))).alias("abs_north_km"),
        km(F.avg("err_mag_m")).alias("mean_magnitude_km"))
    ranks = exact_quantiles(df, keys, "err_km", {"median_km": (0.5, "linear"), "p90_km": (0.9, "nearest")})
    return stats.join(ranks.select(*keys, F.round("median_km", 6).alias("median_km"),
                                   F.round("p90_km", 6).alias("p90_km")), keys, "left")


def exclusion() -> Column:
    """Why a step is not scored; NULL when it is."""
    return (F.when(F.col("elapsed_days") != 1, "wrong_window")
            .when(tr.quality() != "observed_to_observed", "interpolated_endpoint")
            .when(~(tr.has_current() & tr.has_wind()), "missing_current_or_wind"))


def population(steps: DataFrame) -> DataFrame:
    """Clean one-day steps with both inputs; ``moved`` marks a changed position."""
    return (steps.where(exclusion().isNull())
            .withColumn("moved", F.col("displacement_m") > 0))


def chronological_split(pop: DataFrame, train=0.6, validation=0.2) -> DataFrame:
    """Cut dates at row positions among *moved* rows, applied to all rows.

    Rows are counted per date first, so the only unpartitioned window runs over
    the calendar. The single row of cut dates is broadcast.
    """
    per_day = pop.where("moved").groupBy("prev_day").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("prev_day").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("prev_day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = (per_day.withColumn("_hi", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(whole)))
    at = lambda f: F.min(F.when(F.col("_hi") > F.floor(F.col("_all") * f), F.col("prev_day")))
    cuts = cum.agg(at(train).alias("d_train"), at(train + validation).alias("d_val"))
    return (pop.join(F.broadcast(cuts), F.lit(True))
            .withColumn("split", F.when(F.col("prev_day") < F.col("d_train"), "train")
                        .when(F.col("prev_day") < F.col("d_val"), "validation").otherwise("test"))
            .drop("d_train", "d_val"))


def earliest_fraction(rows: DataFrame, fraction: float = 0.7) -> DataFrame:
    """Mark the first ``fraction`` of the rows in time order (ties by id, sensor) as the fit set."""
    ranked = global_rank(rows, ["prev_day", "iceberg_id", "sensor"], "_rank")
    total = ranked.agg(F.max("_rank").alias("_total"))
    return (ranked.join(F.broadcast(total), F.lit(True))
            .withColumn("fit", F.col("_rank") <= F.floor(F.col("_total") * fraction))
            .drop("_rank", "_total"))


@dataclass(frozen=True)
class Sweep:
    """A rectangular parameter grid, turn varying fastest; values are clamped to the limits."""

    windage0: float
    windage_step: float
    windages: int
    turn0: float
    turn_step: float
    turns: int

    def columns(self, i: Column) -> tuple[Column, Column]:
        clamp = lambda v, lim: F.greatest(F.lit(lim[0]), F.least(F.lit(lim[1]), v))
        w = self.windage0 + F.floor(i / self.turns) * self.windage_step
        d = self.turn0 + (i % self.turns) * self.turn_step
        return clamp(F.round(w, 9), WINDAGE), clamp(d, TURN_DEG)


def coarse_grid() -> Sweep:
    (c0, c1), (t0, t1) = WINDAGE, TURN_DEG
    return Sweep(c0, (c1 - c0) / COARSE[0], COARSE[0] + 1, t0, (t1 - t0) / COARSE[1], COARSE[1] + 1)


def fine_grid(windage: float, turn_deg: float) -> Sweep:
    """A finer sweep round a coarse winner."""
    dc = (WINDAGE[1] - WINDAGE[0]) / COARSE[0] / 8
    dt = (TURN_DEG[1] - TURN_DEG[0]) / COARSE[1] / 6
    return Sweep(windage - 8 * dc, dc, 17, turn_deg - 6 * dt, dt, 13)


def grid_errors(rows: DataFrame, grid: Sweep) -> DataFrame:
    """Mean error of every parameter pair.

    The grid has a fixed size: rows are dealt out evenly, expanded and averaged
    in the same task, and only one partial sum per pair is shuffled.
    """
    tried = (spread(rows.select("lat0", "lon0", "lat1", "lon1", "elapsed_s", *tr.ENV))
             .withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(grid.windages * grid.turns - 1)))))
    windage, turn_deg = grid.columns(F.col("ord"))
    tried = tried.withColumn("windage", windage).withColumn("turn", turn_deg)
    ve, vn = drift_velocity(F.col("windage"), F.col("turn"))
    tried = tried.withColumn("_ve", ve).withColumn("_vn", vn)
    lat, lon = ex.advect(F.col("lat0"), F.col("lon0"), F.col("_ve"), F.col("_vn"), F.col("elapsed_s"))
    err = ex.great_circle_m(lat, lon, F.col("lat1"), F.col("lon1")) / 1000
    return tried.groupBy("ord", "windage", "turn").agg(F.round(F.avg(err), 6).alias("mean_km"))


def best_pair(errors: DataFrame) -> DataFrame:
    """Smallest mean error; ties go to the first in grid order. One row."""
    return errors.agg(F.min_by(F.struct("windage", "turn", "mean_km"), F.struct("mean_km", "ord")).alias("b")).select("b.*")


def calibrate(rows: DataFrame) -> DataFrame:
    """Coarse then fine sweep on ``rows``; the one coarse winner is read by the driver."""
    winner = best_pair(grid_errors(rows, coarse_grid())).first()
    return best_pair(grid_errors(rows, fine_grid(winner["windage"], winner["turn"])))


def radius_points() -> dict[str, tuple[float, str]]:
    return {"q50": (0.5, "linear"), "q80": (0.8, "linear"), "q90": (0.9, "linear")}


def calibrated_radius(rows: DataFrame, min_rows: int = 1) -> DataFrame:
    """Quantile radii of train and validation errors with component statistics; one row.

    Fewer than ``min_rows`` errors fail the job: a radius is never left out without a word.
    """
    use = rows.where(F.col("moved") & F.col("split").isin("train", "validation"))
    e, n = F.col("err_e_m") / 1000, F.col("err_n_m") / 1000
    stats = use.agg(F.count(F.lit(1)).alias("n"), F.min("prev_day").alias("date_min"), F.max("prev_day").alias("date_max"),
                    F.avg(e).alias("mean_east"), F.avg(n).alias("mean_north"), F.stddev_samp(e).alias("stdev_east"),
                    F.stddev_samp(n).alias("stdev_north"), F.corr(e, n).alias("correlation"))
    radii = exact_quantiles(use, [], "err_km", radius_points())
    short = F.format_string("only %d errors, at least " + str(min_rows) + " are needed", F.col("n"))
    enough = F.when(F.col("n") >= min_rows, F.col("n")).otherwise(F.raise_error(short).cast("long"))
    return (stats.withColumn("n", enough).join(F.broadcast(radii), F.lit(True))
            .withColumn("anisotropy", F.col("stdev_east") / F.nullif(F.col("stdev_north"), F.lit(0.0))))


def coverage(rows: DataFrame, radii: DataFrame) -> DataFrame:
    """Share of errors at or inside each radius, per split."""
    joined = rows.where("moved").join(F.broadcast(radii.select("q50", "q80", "q90")), F.lit(True))
    inside = lambda q: F.round(F.avg(F.when(F.col("err_km") <= F.col(q), 1.0).otherwise(0.0)), 6).alias(f"inside_{q}")
    return joined.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("err_km"), 6).alias("mean_km"),
                                       *[inside(q) for q in ("q50", "q80", "q90")])


def at_horizons(rows: DataFrame, radii: DataFrame, horizons=HORIZONS_H) -> DataFrame:
    """Every prediction at every output horizon: position, radius, extrapolation flags."""
    de, dn = ex.displacement(F.col("lat0"), F.col("lon0"), F.col("plat"), F.col("plon"))
    out = (rows.join(F.broadcast(radii.select(F.col("q90").alias("_r"))), F.lit(True))
           .withColumn("_e", de / F.col("elapsed_s")).withColumn("_n", dn / F.col("elapsed_s"))
           .withColumn("horizon_h", F.explode(F.array(*[F.lit(h) for h in horizons]))))
    lat, lon = ex.advect(F.col("lat0"), F.col("lon0"), F.col("_e"), F.col("_n"), F.col("horizon_h") * 3600)
    return (out.withColumn("lat", lat).withColumn("lon", lon)
            .withColumn("radius_km", F.col("_r") * ex.growth_factor(F.col("horizon_h")))
            .withColumn("extrapolated_uncertainty", F.col("horizon_h") > 24.0)
            .withColumn("extrapolated_position", F.col("horizon_h") * 3600 > F.col("elapsed_s"))
            .drop("_r", "_e", "_n"))
