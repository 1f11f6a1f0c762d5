"""Track observations: melting, steps, duplicates, matching with the environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as ex

KEY = ["iceberg_id", "sensor"]
ENV = ["wind_u", "wind_v", "cur_u", "cur_v"]
SCHEMA_COLUMNS = {"iceberg_id", "date", "size_1", "size_2"}


def melt_sensors(wide: DataFrame, sensors: list[str], keep=("iceberg_id", "date")) -> DataFrame:
    """One row per sensor triplet; (0,0) means no data even when flagged.

    A sensor without a flag column gets NULL flags. Columns the schema does not
    know go into ``source_fields`` untouched. What is not a number counts as missing;
    ``rejected_fixes`` counts it.
    """
    known = SCHEMA_COLUMNS | set(keep) | {f"{s}_{i}" for s in sensors for i in (1, 2, 3)}
    extra = [c for c in wide.columns if c not in known]
    entries = [x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]
    fields = F.create_map(*entries) if entries else F.lit(None).cast("map<string,string>")
    triplets = []
    for s in sensors:
        flag = F.col(f"{s}_3") if f"{s}_3" in wide.columns else F.lit(None)
        triplets.append(F.struct(F.lit(s).alias("sensor"), F.col(f"{s}_1").try_cast("double").alias("lat"),
                                 F.col(f"{s}_2").try_cast("double").alias("lon"),
                                 flag.cast("string").alias("flag")))
    size = lambda c: ex.nm_to_km(F.expr(f"try_cast({c} AS double)")) if c in wide.columns else F.lit(None).cast("double")
    out = wide.select(*keep, size("size_1").alias("size_major_km"), size("size_2").alias("size_minor_km"),
                      fields.alias("source_fields"), F.explode(F.array(*triplets)).alias("t"))
    return (out.select(*keep, "t.sensor", "t.lat", ex.normalise_longitude(F.col("t.lon")).alias("lon"),
                       "t.flag", (F.col("t.flag").try_cast("double") == 0).alias("is_interpolated"),
                       "size_major_km", "size_minor_km", "source_fields")
            .where(F.col("lat").isNotNull() & F.col("lon").isNotNull()
                   & ~((F.col("lat") == 0) & (F.col("lon") == 0))))


def rejected_fixes(wide: DataFrame, sensors: list[str], by: list[str]) -> DataFrame:
    """Records per group and sensor whose latitude or longitude is neither blank nor a number."""
    odd = lambda c: F.coalesce((F.trim(c) != "") & F.col(c).try_cast("double").isNull(), F.lit(False))
    counts = F.explode(F.array(*[F.struct(F.lit(s).alias("sensor"), (odd(f"{s}_1") | odd(f"{s}_2")).alias("odd")) for s in sensors]))
    return (wide.select(*by, counts.alias("t")).where("t.odd")
            .groupBy(*by, F.col("t.sensor").alias("sensor")).agg(F.count(F.lit(1)).alias("rejected")))


def days_of_fixes(sightings: DataFrame) -> DataFrame:
    """First and last report of each day; this leaves one row per key and calendar day.

    Same-day reports make no step, so they are reduced before the window: a hot
    iceberg then costs a calendar of rows, however often it was reported.
    """
    rest = [c for c in sightings.columns if c not in (*KEY, "day")]
    return (sightings.groupBy(*KEY, "day")
            .agg(F.min_by(F.struct(*rest), "src").alias("first"), F.max_by(F.struct(*rest), "src").alias("last"),
                 F.count(F.lit(1)).alias("reports")))


def steps(sightings: DataFrame) -> DataFrame:
    """Consecutive fixes per iceberg and sensor; gaps kept and flagged, sensors never joined."""
    daily = days_of_fixes(sightings)
    w = Window.partitionBy(*KEY).orderBy("day")
    paired = (daily.withColumn("prev", F.lag("last").over(w)).withColumn("prev_day", F.lag("day").over(w))
              .where(F.col("prev_day").isNotNull()))
    a, b = "prev.", "first."
    flat = paired.select(
        *KEY, "prev_day", "day", F.datediff("day", "prev_day").alias("elapsed_days"),
        F.col(a + "lat").alias("lat0"), F.col(a + "lon").alias("lon0"),
        F.col(b + "lat").alias("lat1"), F.col(b + "lon").alias("lon1"),
        ((F.col(a + "flag") == 0) | (F.col(b + "flag") == 0)).alias("interpolated"),
        *[F.col(a + c).alias(c) for c in ENV])
    seconds = F.col("elapsed_days") * 86400.0
    ends = (F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1"))
    east, north = ex.displacement(*ends)
    return (flat.withColumn("elapsed_s", seconds)
            .withColumn("displacement_m", ex.great_circle_m(*ends))
            .withColumn("vel_e", east / seconds).withColumn("vel_n", north / seconds)
            .withColumn("gap", F.when(F.col("elapsed_days") > 1,
                                      F.concat(F.lit("gap_"), F.col("elapsed_days").cast("string"), F.lit("d")))))


def step_audit(sightings: DataFrame) -> DataFrame:
    """Reports, days and pairs without positive elapsed time, per sensor."""
    return (days_of_fixes(sightings).groupBy("sensor")
            .agg(F.sum("reports").alias("reports"), F.count(F.lit(1)).alias("fix_days"),
                 F.sum(F.col("reports") - 1).alias("zero_elapsed_pairs")))


def duplicate_groups(sightings: DataFrame) -> DataFrame:
    """Every report with the size of its (iceberg, sensor, day) group; nothing removed.

    An aggregate joined back, not a window: AQE can split a hot group.
    """
    sizes = sightings.groupBy(*KEY, "day").agg(F.count(F.lit(1)).alias("group_size"))
    return sightings.join(sizes, [*KEY, "day"])


def previous_velocity(step_rows: DataFrame) -> DataFrame:
    """Velocity of the step that ends where this one starts; the last source row wins."""
    prev = (step_rows.groupBy(*KEY, F.col("day").alias("prev_day"))
            .agg(F.max_by(F.struct("vel_e", "vel_n"), "prev_day").alias("p"))
            .select(*KEY, "prev_day", F.col("p.vel_e").alias("prev_e"), F.col("p.vel_n").alias("prev_n")))
    return step_rows.join(prev, [*KEY, "prev_day"], "left")


def has_current() -> Column:
    return F.col("cur_u").isNotNull() & F.col("cur_v").isNotNull()


def has_wind() -> Column:
    return F.col("wind_u").isNotNull() & F.col("wind_v").isNotNull()


def quality() -> Column:
    """Clean only when both endpoints are known to be observed."""
    return F.when(F.col("interpolated") == False, "observed_to_observed").otherwise("interpolated_endpoint")  # noqa: E712


def match_state() -> Column:
    return (F.when(has_current() & has_wind(), "fully_matched").when(has_current(), "current_only")
            .when(has_wind(), "wind_only").otherwise("unmatched"))


def match_summary(step_rows: DataFrame) -> DataFrame:
    days = F.col("elapsed_days")
    return (step_rows.groupBy(F.when(days <= 3, days.cast("string")).otherwise("gt3").alias("elapsed_class"),
                              quality().alias("quality"))
            .agg(F.count(F.lit(1)).alias("steps"), F.count_if(has_current()).alias("with_current"),
                 F.count_if(has_wind()).alias("with_wind"),
                 *[F.count_if(match_state() == s).alias(s)
                   for s in ("fully_matched", "current_only", "wind_only", "unmatched")]))


def attach_truth(matches: DataFrame, step_rows: DataFrame) -> DataFrame:
    """Observed end of each matched row, NULL where no step was observed."""
    truth = step_rows.select(*KEY, F.col("prev_day").alias("start_day"), F.col("day").alias("end_day"),
                             "lat1", "lon1")
    return matches.join(truth, [*KEY, "start_day", "end_day"], "left")


def lattice_corners(lattice: DataFrame, lon_count: int | None) -> DataFrame:
    """Per lattice cell its four corner values, or fewer where one is missing.

    Built on the lattice side, so each sample point joins once and is never
    exploded. ``lon_count`` makes the longitude axis wrap (a global axis).
    """
    corners = lattice.withColumn("o", F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])))
    j = F.col("lon_i") - F.col("o.b")
    corners = (corners.withColumn("lat_i", F.col("lat_i") - F.col("o.a"))
               .withColumn("lon_i", (F.pmod(j, F.lit(lon_count)) if lon_count else j).cast("int")))
    aggs = []
    for a in (0, 1):
        for b in (0, 1):
            here = (F.col("o.a") == a) & (F.col("o.b") == b)
            aggs += [F.max(F.when(here, F.col(x))).alias(f"{x}{a}{b}") for x in ("u", "v")]
    return corners.groupBy("day", "lat_i", "lon_i").agg(*aggs)


def bilinear(points: DataFrame, corners: DataFrame, lat0: float, dlat: float, lon0: float, dlon: float,
             lon_count: int | None) -> DataFrame:
    """Bilinear sample at each point of its own day; a missing corner voids it, no extrapolation."""
    y, x = (F.col("lat") - lat0) / dlat, (ex.normalise_longitude(F.col("lon")) - lon0) / dlon
    j = F.floor(x)
    placed = (points.withColumn("lat_i", F.floor(y).cast("int"))
              .withColumn("lon_i", (F.pmod(j, F.lit(lon_count)) if lon_count else j).cast("int"))
              .withColumn("_fy", y - F.floor(y)).withColumn("_fx", x - F.floor(x)))
    joined = placed.join(corners, ["day", "lat_i", "lon_i"], "left")
    fy, fx = F.col("_fy"), F.col("_fx")
    mix = lambda n: ((1 - fy) * ((1 - fx) * F.col(f"{n}00") + fx * F.col(f"{n}01"))
                     + fy * ((1 - fx) * F.col(f"{n}10") + fx * F.col(f"{n}11")))
    u, v = mix("u"), mix("v")                      # NULL as soon as one corner is NULL
    return (joined.withColumn("sample_u", F.when(v.isNotNull(), u))
            .withColumn("sample_v", F.when(u.isNotNull(), v))
            .withColumn("reason", F.when(u.isNull() | v.isNull(), "corner_missing"))
            .drop("_fy", "_fx", *[f"{n}{a}{b}" for n in "uv" for a in (0, 1) for b in (0, 1)]))


def projected_cell(df: DataFrame, cell_m: float, left: float = -3950000.0, top: float = 4350000.0) -> DataFrame:
    """Grid row and column of a geographic position."""
    x, y = ex.polar_xy(F.col("lat"), F.col("lon"))
    return df.withColumn("gr", ex.row_of(y, top, cell_m)).withColumn("gc", ex.col_of(x, left, cell_m))


def bounding_box(df: DataFrame, margin: float = 1.0, lattice: float = 0.25) -> DataFrame:
    """Extent plus a margin, snapped outward; a circumpolar extent stays whole."""
    k = 1 / lattice
    down = lambda c: F.floor(c * k) / k
    up = lambda c: F.ceil(c * k) / k
    return df.agg(
        F.least(up(F.max("lat") + margin), F.lit(90.0)).alias("north"),
        F.greatest(down(F.min("lon") - margin), F.lit(-180.0)).alias("west"),
        F.greatest(down(F.min("lat") - margin), F.lit(-90.0)).alias("south"),
        F.least(up(F.max("lon") + margin), F.lit(180.0)).alias("east"),
        F.count(F.lit(1)).alias("candidates"))
