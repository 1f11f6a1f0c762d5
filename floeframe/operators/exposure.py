"""Iceberg exposure per cell: windowed distance join, max-combine, what-if."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..session import spread


BROADCAST_CELLS = 2_000_000       # about 80 MB of (r, c, lat, lon, cos); beyond it the join shuffles


@dataclass(frozen=True)
class Lattice:
    """A regular geographic lattice; ``wrap`` columns make it circumpolar."""

    lat0: float
    dlat: float
    lon0: float
    dlon: float
    rows: int
    cols: int
    wrap: bool = False


def candidate_cells(bergs: DataFrame, grid: Lattice, scale: float = 1.25, extra: int = 3) -> DataFrame:
    """Every cell index in a generous window round each centre.

    A circle of angle rho round latitude lat spans asin(sin(rho) / cos(lat)) of
    longitude to each side, and all longitudes once it reaches a pole, so no cell
    inside the radius can be left out.
    """
    deg_m = ex.EARTH_RADIUS_M * math.pi / 180
    radius = F.col("radius_km") * 1000.0
    half_r = F.ceil(radius * scale / (grid.dlat * deg_m)) + extra
    reach = F.degrees(radius * scale / ex.EARTH_RADIUS_M)
    polar = F.abs("lat") + reach >= 90.0
    ratio = F.sin(F.radians(reach)) / F.cos(F.radians(F.abs("lat")))
    half_c = F.when(polar, F.lit(grid.cols)).otherwise(F.ceil(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) / grid.dlon) + extra)
    r0 = F.floor((F.col("lat") - grid.lat0) / grid.dlat)
    c0 = F.floor((F.col("lon") - grid.lon0) / grid.dlon)
    r_lo, r_hi = F.greatest(r0 - half_r, F.lit(0)), F.least(r0 + half_r, F.lit(grid.rows - 1))
    if grid.wrap:
        half_c = F.least(half_c, F.lit(grid.cols // 2))
        c_lo, c_hi = c0 - half_c, F.least(c0 + half_c, c0 - half_c + grid.cols - 1)
    else:
        c_lo, c_hi = F.greatest(c0 - half_c, F.lit(0)), F.least(c0 + half_c, F.lit(grid.cols - 1))
    out = (bergs.where(radius > 0)
           .withColumn("_r0", r_lo).withColumn("_r1", r_hi).withColumn("_c0", c_lo).withColumn("_c1", c_hi)
           .where((F.col("_r0") <= F.col("_r1")) & (F.col("_c0") <= F.col("_c1")))
           .withColumn("r", F.explode(F.sequence(F.col("_r0").cast("int"), F.col("_r1").cast("int"))))
           .withColumn("c", F.explode(F.sequence(F.col("_c0").cast("int"), F.col("_c1").cast("int")))))
    if grid.wrap:
        out = out.withColumn("c", F.pmod("c", F.lit(grid.cols)))
    return out.drop("_r0", "_r1", "_c0", "_c1")


def cells_in_radius(bergs: DataFrame, cells: DataFrame, grid: Lattice, shape: str = "linear",
                    scale: float = 1.25, extra: int = 3) -> DataFrame:
    """(berg, cell) pairs strictly inside the radius with their exposure.

    An equi-join on the candidate cell index, then the exact great-circle test;
    the number of candidates per berg depends on the radius only.
    """
    radius = F.col("radius_km") * 1000.0
    centres = (spread(bergs).withColumns({"blat": F.col("lat"), "blon": F.col("lon")}))
    tried = candidate_cells(centres, grid, scale, extra).drop("lat", "lon").withColumns(
        {"_bcos": F.cos(F.radians("blat")), "_far": F.pow(F.sin(radius / (2 * ex.EARTH_RADIUS_M)), F.lit(2.0)) * (1 + 1e-9)})
    places = cells.select("r", "c", "lat", "lon", F.cos(F.radians("lat")).alias("_cos"))
    if grid.rows * grid.cols <= BROADCAST_CELLS:
        places = F.broadcast(places)              # the lattice itself bounds this side
    # cosines are taken once per berg and per cell; most candidates then fall to
    # the latitude test or to the squared half-chord, before any arc sine
    half_lat = F.sin(F.radians(F.col("blat") - F.col("lat")) / 2)
    half_lon = F.sin(F.radians(ex.shortest_arc(F.col("blon") - F.col("lon"))) / 2)
    near = (tried.join(places, ["r", "c"])
            .where(F.abs(F.col("lat") - F.col("blat")) <= F.degrees(radius / ex.EARTH_RADIUS_M) * (1 + 1e-9))
            .withColumn("_h", half_lat * half_lat + F.col("_cos") * F.col("_bcos") * (half_lon * half_lon))
            .where(F.col("_h") <= F.col("_far"))
            .withColumn("distance_m", 2.0 * ex.EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt("_h")))))
    return (near.where(F.col("distance_m") < radius).drop("_h", "_far", "_cos", "_bcos")
            .withColumn("exposure", ex.exposure_value(F.col("distance_m"), radius, shape))
            .where(F.col("exposure") > 0))


def strongest(pairs: DataFrame, keys=("bucket", "r", "c"), order: str = "iceberg_id") -> DataFrame:
    """Max exposure per cell and the berg it comes from; ties keep the first berg.

    ``max_by`` combines on the map side, so a crowded cell costs one row per task.
    """
    best = F.max_by(F.struct("iceberg_id", "exposure"), F.struct(F.col("exposure"), -F.col(order)))
    return pairs.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.iceberg_id", "b.exposure")


def summary(field: DataFrame, total_cells: DataFrame) -> DataFrame:
    """Per bucket: affected cells and their share, maximum, mean over non-zero, contributors."""
    out = field.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.max("exposure"), 6).alias("max_exposure"),
        F.round(F.avg("exposure"), 6).alias("mean_exposure"), F.countDistinct("iceberg_id").alias("contributors"))
    return (out.join(F.broadcast(total_cells.agg(F.count(F.lit(1)).alias("_all"))), F.lit(True))
            .withColumn("fraction", F.round(F.col("cells") / F.col("_all"), 6)).drop("_all"))


def inject(field: DataFrame, added: DataFrame, from_bucket: int) -> DataFrame:
    """Add one berg's exposure from a bucket on, combined by maximum; existing values win ties."""
    old = field.select("bucket", "r", "c", "iceberg_id", "exposure", F.lit(0).alias("_late"))
    new = (added.where(F.col("bucket") >= from_bucket)
           .select("bucket", "r", "c", "iceberg_id", "exposure", F.lit(1).alias("_late")))
    both = old.unionByName(new)
    best = F.max_by(F.struct("iceberg_id", "exposure"), F.struct(F.col("exposure"), -F.col("_late")))
    return (both.groupBy("bucket", "r", "c").agg(best.alias("b"), F.max(F.when(F.col("_late") == 0, F.col("exposure"))).alias("before"))
            .select("bucket", "r", "c", "b.iceberg_id", "b.exposure", "before"))


def nearest_approach(states: DataFrame, start: tuple[float, float], goal: tuple[float, float]) -> DataFrame:
    """Per berg the state closest to the start-goal segment, measured on the grid plane."""
    x, y = ex.polar_xy(F.col("lat"), F.col("lon"))
    (ax, ay), (bx, by) = start, goal
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    along = (((x - ax) * dx + (y - ay) * dy) / length) if length else F.lit(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    d = F.hypot(x - (ax + t * dx), y - (ay + t * dy))
    return (states.withColumn("_d", d).groupBy("iceberg_id")
            .agg(F.min("_d").alias("distance_m"), F.min_by("hours", F.struct("_d", "hours")).alias("at_hours")))


def state_at(states: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Where each key's body is at each asked hour: keys, at_h, lat, lon, from_h, to_h, exact, outside.

    ``states`` has (keys, hours, lat, lon), ``asked`` (keys, at_h). Both are united and walked once in the order of hours: the last
    state before and the first after bracket an hour, with no join. Longitude takes the shorter arc, an hour that has a state of its own is
    exact, and one before the first or after the last state is outside and has no position; nothing is carried beyond a forecast. Of
    several states of one hour the first by position counts. A key's rows are its horizons and the hours asked of it.
    """
    one = states.groupBy(*keys, "hours").agg(F.min(F.struct("lat", "lon")).alias("_p")).select(*keys, "hours", F.struct("hours", "_p.lat", "_p.lon").alias("_s"))
    rows = (one.withColumn("_asked", F.lit(False))
            .unionByName(asked.select(*keys, F.col("at_h").cast("double").alias("hours"), F.lit(True).alias("_asked")), allowMissingColumns=True))
    window = Window.partitionBy(*keys).orderBy("hours", "_asked")            # a state comes before a question of the same hour
    rows = (rows.withColumn("_a", F.last("_s", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_b", F.first("_s", ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing)))
            .where("_asked"))
    exact = F.coalesce(F.col("_a.hours") == F.col("hours"), F.lit(False))
    outside = ~exact & (F.col("_a").isNull() | F.col("_b").isNull())
    f = (F.col("hours") - F.col("_a.hours")) / (F.col("_b.hours") - F.col("_a.hours"))
    between = lambda c, gap: F.when(exact, F.col(f"_a.{c}")).when(~outside, F.col(f"_a.{c}") + gap * f)
    return (rows.withColumn("lat", between("lat", F.col("_b.lat") - F.col("_a.lat")))
            .withColumn("lon", between("lon", ex.shortest_arc(F.col("_b.lon") - F.col("_a.lon"))))
            .select(*keys, F.col("hours").alias("at_h"), "lat", F.when(F.col("lon").isNotNull(), ex.normalise_longitude(F.col("lon"))).alias("lon"),
                    F.col("_a.hours").alias("from_h"), F.when(exact, F.col("_a.hours")).otherwise(F.col("_b.hours")).alias("to_h"), exact.alias("exact"), outside.alias("outside")))
