"""Cost surfaces: environment, chart penalties, exposure, objectives, source of each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import length, resistance_factor

INF = float("inf")                 # a cell that cannot be priced
MODELLED_DAYS = 2                  # leads with a model: 24 h and 48 h
PROFILES = ["fastest", "shortest_distance", "fuel_efficient", "risk_oriented"]


def finite(c: Column) -> Column:
    return c.isNotNull() & (c < INF)


def combined_mask(df: DataFrame, masks: dict[str, str | None]) -> DataFrame:
    """OR of the masks that were supplied; ``supplied`` names them, so that
    "not supplied" stays apart from "all false"."""
    blocked = F.lit(False)
    for c in masks.values():
        if c is not None:
            blocked = blocked | F.coalesce(F.col(c), F.lit(False))
    given = [F.lit(n) for n, c in masks.items() if c is not None]
    return df.withColumn("blocked", blocked).withColumn(
        "supplied", F.array(*given) if given else F.array().cast("array<string>"))


def environment_cost(df: DataFrame, base=1.0, ice_weight=1.0, ice_exponent=1.0, current_weight=0.0,
                     current_reference=0.5) -> DataFrame:
    """Base plus ice plus optional current term; blocked or missing input -> Infinity."""
    sic = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("sic")))
    cost = F.lit(base) + ice_weight * F.pow(sic / 100.0, F.lit(ice_exponent))
    missing = F.col("sic").isNull()
    if current_weight > 0:
        speed = length(F.col("u"), F.col("v"))
        cost = cost + current_weight * F.least(speed / current_reference, F.lit(1.0))
        missing = missing | F.col("u").isNull() | F.col("v").isNull()
    return (df.withColumn("no_data", missing & ~F.col("blocked"))
            .withColumn("env_cost", F.when(F.col("blocked") | missing, F.lit(INF)).otherwise(cost)))


def chart_terms(chart: DataFrame, penalties: DataFrame, weight: float) -> DataFrame:
    """State, penalties and coverage term of each chart cell, before any time bucket is joined."""
    joined = chart.join(penalties, "polygon_id", "left")
    state = (F.when(~F.col("coverage") | F.col("polygon_id").isNull(), "uncharted")
             .when(F.col("is_water").isNull(), "uncharted").when(F.col("is_water"), "charted_water")
             .when(~F.col("has_rio"), "charted_unknown_regime").otherwise("charted_ice"))
    priced = F.col("state").isin("charted_ice", "charted_unknown_regime")
    charted = F.col("coverage") & F.col("polygon_id").isNotNull()
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("dominant_fraction")))
    return (joined.withColumn("state", state)
            .withColumn("pol_cons", F.when(priced, F.col("conservative")).otherwise(F.lit(0.0)))
            .withColumn("pol_opt", F.when(priced, F.col("optimistic")).otherwise(F.lit(0.0)))
            .withColumn("coverage_cost", F.when(charted, weight * share).otherwise(F.lit(0.0))))


def compose(env: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Environment plus chart terms; a cell without a chart row is uncharted and pays neither."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = env.join(terms, keys, "left").withColumn("state", F.coalesce("state", F.lit("uncharted")))
    for c in ("pol_cons", "pol_opt", "coverage_cost"):
        out = out.withColumn(c, zero(c))
    return (out.withColumn("conservative_cost", F.col("env_cost") + F.col("pol_cons") + F.col("coverage_cost"))
            .withColumn("optimistic_cost", F.col("env_cost") + F.col("pol_opt") + F.col("coverage_cost")))


def with_icebergs(composed: DataFrame, exposure: DataFrame, buckets: DataFrame, weight: float = 5.0,
                  on_missing: str = "omit", branch: str = "conservative_cost") -> DataFrame:
    """Composed cost plus weighted exposure.

    An absent exposure row is zero only inside a bucket that exists; a missing
    bucket fails the job or is stamped as an omission.
    """
    known = buckets.select("bucket").distinct().withColumn("_known", F.lit(True))
    out = (composed.join(exposure.select("bucket", "r", "c", "iceberg_id", "exposure"), ["bucket", "r", "c"], "left")
           .join(F.broadcast(known), "bucket", "left"))
    gone = F.raise_error(F.lit("no exposure field for a bucket")).cast("double") if on_missing == "error" else F.lit(None).cast("double")
    out = out.withColumn("exposure", F.when(F.col("_known"), F.coalesce("exposure", F.lit(0.0))).otherwise(gone))
    term = weight * F.coalesce("exposure", F.lit(0.0))
    return (out.withColumn("ice_cost", term).withColumn("final_cost", F.col(branch) + term)
            .withColumn("exposure_omitted", F.col("_known").isNull()).drop("_known"))


def objective_costs(final: DataFrame, keys: list[str], speed: float) -> DataFrame:
    """One row per cell and profile; every profile keeps the risk cost's finite pattern.

    A cell the risk cost can price but whose concentration is missing gets NULL
    for fuel: the caller counts those as refusals.
    """
    ok = finite(F.col("final_cost"))
    cost = {"fastest": F.lit(1.0 / speed), "shortest_distance": F.lit(1.0),
            "fuel_efficient": resistance_factor(F.col("sic")), "risk_oriented": F.col("final_cost")}
    rows = F.array(*[F.struct(F.lit(n).alias("profile"), F.when(ok, cost[n]).otherwise(F.lit(INF)).alias("cost"))
                     for n in PROFILES])
    return final.select(*keys, F.explode(rows).alias("p")).select(*keys, "p.profile", "p.cost")


def at_arrival(points: DataFrame, field: DataFrame, keys: list[str], bucket: Column, buckets: DataFrame,
               on_missing: str = "infinite") -> DataFrame:
    """Field values at each point's arrival bucket; a missing bucket is an error or unpriceable."""
    known = buckets.select("bucket").distinct().withColumn("_known", F.lit(True))
    out = (points.withColumn("bucket", bucket).join(field, ["bucket", *keys], "left").join(F.broadcast(known), "bucket", "left"))
    if on_missing == "error":
        lost = F.raise_error(F.lit("arrival outside every bucket")).cast("boolean")
        return out.withColumn("bucket_known", F.when(F.col("_known"), True).otherwise(lost)).drop("_known")
    return out.withColumn("bucket_known", F.coalesce("_known", F.lit(False))).drop("_known")


def bucket_sources(requests: DataFrame, fields: DataFrame, days: DataFrame, bucket_h: float) -> DataFrame:
    """Environment of each (request, bucket): forecast, own-day observation, or named persistence.

    A forecast covers a bucket only if the bucket lies wholly in the field's
    half-open target day (``reason`` says why none does), so the interval join becomes an equi-join on that day
    followed by the containment test; the lowest lead wins.
    """
    seconds = lambda h: F.make_dt_interval(secs=F.lit(float(h * 3600)))
    begin = F.col("departure") + F.make_dt_interval(secs=(F.col("bucket") * bucket_h * 3600).cast("double"))
    end = begin + seconds(bucket_h)
    r = (requests.withColumn("valid_from", begin).withColumn("valid_to", end)
         .withColumn("base_day", F.to_date("departure")).withColumn("want_day", F.to_date(begin)))
    inside = F.col("valid_to") <= F.date_add("want_day", 1).cast(dict(r.dtypes)["valid_from"])
    r = r.withColumn("_day", F.when(inside, F.col("want_day")))
    offers = (fields.groupBy(F.col("origin").alias("base_day"), F.col("valid_day").alias("_day"))
              .agg(F.min("lead_h").alias("lead_h")))
    seen = days.select(F.col("day").alias("want_day")).distinct().withColumn("_seen", F.lit(True))
    out = r.join(offers, ["base_day", "_day"], "left").join(seen, "want_day", "left")
    own = F.col("want_day") == F.col("base_day")
    source = (F.when(F.col("lead_h").isNotNull(), "model_forecast").when(own & F.col("_seen"), "observed")
              .otherwise("persistence"))
    return (out.withColumn("source", source).withColumn("persisted", F.col("source") == "persistence")
            .withColumn("environment_day", F.when(F.col("source") == "model_forecast", F.col("want_day")).otherwise(F.col("base_day")))
            .withColumn("future_observation_available", F.coalesce("_seen", F.lit(False)) & (F.col("want_day") > F.col("base_day")))
            .withColumn("reason", F.when(F.col("lead_h").isNotNull(), F.lit(None).cast("string"))
                        .when(F.col("_day").isNull(), "window_spans_two_days")
                        .when(own, "no_sub_daily_target")
                        .when(F.datediff("want_day", "base_day") > MODELLED_DAYS, "lead_not_modelled").otherwise("no_forecast_for_day"))
            .drop("_day", "_seen"))


def date_alignment(df: DataFrame, columns: list[str], keys: list[str], override: bool = False) -> DataFrame:
    """Do the dates of all inputs agree per key? Disagreement is refused, or stamped when overridden."""
    same = F.lit(True)
    for c in columns[1:]:
        same = same & F.coalesce(F.col(columns[0]) == F.col(c), F.lit(False))
    out = df.groupBy(*keys).agg(F.bool_and(same).alias("aligned"), F.count(F.lit(1)).alias("rows"),
                                F.count_if(~same).alias("misaligned"))
    verdict = F.when(F.col("aligned"), "accepted").otherwise("overridden" if override else "refused")
    return out.withColumn("verdict", verdict)


def quality_checks(final: DataFrame, keys: list[str]) -> DataFrame:
    """Refusal reasons as counts: one row per check."""
    cost, e, s = F.col("final_cost"), F.col("exposure"), F.col("sic")
    checks = {"missing_cost": cost.isNull() | F.isnan(cost), "negative_cost": cost < 0, "exposure_out_of_range": ~e.between(0, 1),
              "concentration_out_of_range": ~s.between(0, 100), "priceable": finite(cost)}
    one = final.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    repeats = (final.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("duplicate_cells")))
    both = one.join(F.broadcast(repeats), F.lit(True))
    return both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("cells"))
                                           for n in [*checks, "duplicate_cells"]])).alias("x")).select("x.*")
