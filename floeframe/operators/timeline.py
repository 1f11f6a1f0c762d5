"""Which environment prices each bucket of a voyage, by named policy, with refusals as rows.

A policy says which field a bucket may use; a validity rule says how far one field's claim reaches. Nothing is stretched to a
window it does not cover and nothing is substituted unless the caller asks for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: policies, validity rules, and the leads that are registered, with why they can or cannot price a bucket ---
PERSISTENCE = "persistence_from_departure_analysis"
DATED_OBSERVATION = "dated_observation_hindcast"
MODEL_FORECAST = "model_forecast_when_supported"
LONG_HORIZON = "long_horizon_forecast_evaluation"
POLICIES = (PERSISTENCE, DATED_OBSERVATION, MODEL_FORECAST, LONG_HORIZON)
TARGET_DAY, EXACT_TIME = "target_composite_day", "exact_valid_time"
LEADS = {0: "observation", 6: "no_sub_daily_target", 12: "no_sub_daily_target", 24: "modelled", 48: "modelled"}
# -----------------------------------------------------------------------------------------------------------------------------
ON_MISSING = ("error", "refuse", "persist")


def windows(requests: DataFrame, bucket_s: float) -> DataFrame:
    """``requests`` (request, departure, bucket) with the bucket's window, the departure's day and the day the window opens on."""
    if not (math.isfinite(bucket_s) and bucket_s > 0):
        raise ValueError(f"a bucket has a length above zero, not {bucket_s}")
    number = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.raise_error(F.lit("a bucket number is zero or more")).cast("int"))
    at = lambda n: F.col("departure") + F.make_dt_interval(secs=(n * bucket_s).cast("decimal(18,6)"))
    return (requests.withColumn("bucket", number).withColumn("valid_from", at(F.col("bucket"))).withColumn("valid_to", at(F.col("bucket") + 1))
            .withColumn("analysis_day", F.to_date("departure")).withColumn("want_day", F.to_date("valid_from")))


def covering_lead(rule: str, leads: dict[int, str] = LEADS) -> Column:
    """The lowest modelled lead whose field, issued at the start of ``analysis_day``, covers the whole of [valid_from, valid_to].

    By ``TARGET_DAY`` a field holds for its half-open day; by ``EXACT_TIME`` it is an instant, and covers only that instant.
    """
    def covers(lead: int) -> Column:
        valid = F.col("analysis_day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(lead))
        begin, end = F.col("valid_from").cast("timestamp_ntz"), F.col("valid_to").cast("timestamp_ntz")
        if rule == EXACT_TIME:
            return (begin == valid) & (end == valid)
        opens = F.date_trunc("day", valid).cast("timestamp_ntz")
        return (begin >= opens) & (end <= opens + F.make_dt_interval(days=F.lit(1)))
    if rule not in (TARGET_DAY, EXACT_TIME):
        raise ValueError(f"no validity rule {rule!r}")
    fits = [F.when(covers(lead), lead) for lead, status in sorted(leads.items()) if status == "modelled"]
    return F.coalesce(*fits) if fits else F.lit(None).cast("int")


def resolved(asked: DataFrame, fields: DataFrame, rule: str = TARGET_DAY, leads: dict[int, str] = LEADS) -> DataFrame:
    """``asked`` (analysis_day, valid_from, valid_to) with lead_h, model and reason: the field that may price it, or why none may.

    ``fields``: origin, lead_h, and optionally model. The covering lead's field is the only one asked for: if it was never made, no other
    origin or lead stands in. Each window meets at most one field, whatever the archive's size.
    """
    if "model" not in fields.columns:
        fields = fields.withColumn("model", F.lit(None).cast("string"))
    there = fields.groupBy(F.col("origin").alias("analysis_day"), F.col("lead_h").alias("_lead")).agg(F.min("model").alias("model"), F.lit(True).alias("_made"))
    out = asked.withColumn("_lead", covering_lead(rule, leads)).join(there, ["analysis_day", "_lead"], "left")
    hours = (F.unix_timestamp(F.col("valid_from").cast("timestamp")) - F.unix_timestamp(F.col("analysis_day").cast("timestamp"))) / 3600.0
    registered = F.lit(None).cast("string")
    for lead, status in leads.items():
        if status != "modelled":
            registered = F.when(hours == lead, F.lit(status)).otherwise(registered)
    reason = F.when(F.col("_made"), None).when(F.col("_lead").isNotNull(), "field_not_made").otherwise(F.coalesce(registered, F.lit("not_covered")))
    return out.withColumn("lead_h", F.when(F.col("_made"), F.col("_lead"))).withColumn("reason", reason).drop("_lead", "_made")


def timeline(requests: DataFrame, fields: DataFrame, days: DataFrame, policy: str, bucket_s: float, on_missing: str = "error",
             rule: str = TARGET_DAY) -> DataFrame:
    """One row per (request, bucket): source_type, environment_day, lead_h, fallback, flags, and the reason of a refusal.

    Policies: carry the departure day's analysis; the analysis of each window's own day; the forecast that covers the window (the evaluation
    policy resolves alike, and is told apart in ``policy``). Where there is nothing, ``on_missing`` ends the job
    ("error"), gives an ``unavailable`` row ("refuse"), or carries the departure's analysis forward, flagged ("persist").
    ``days``: day of each analysis there is; an empty archive is not checked against.
    """
    if policy not in POLICIES or on_missing not in ON_MISSING:
        raise ValueError(f"no policy {policy!r} or no rule {on_missing!r} for what is missing")
    if policy in (MODEL_FORECAST, LONG_HORIZON) and rule != TARGET_DAY:
        raise ValueError(f"policy {policy!r} is bound to the rule {TARGET_DAY!r}, not {rule!r}")
    out = windows(requests, bucket_s)
    have = days.select("day").distinct()
    checked = not have.isEmpty()
    seen = lambda on, name: have.select(F.col("day").alias(on), F.lit(True).alias(name))
    out = out.join(seen("analysis_day", "_base"), "analysis_day", "left").join(seen("want_day", "_own"), "want_day", "left")
    base_there = F.coalesce("_base", F.lit(not checked))
    if policy in (MODEL_FORECAST, LONG_HORIZON):
        out = resolved(out, fields, rule)
        direct, day, name = F.col("lead_h").isNotNull(), F.date_add("analysis_day", F.floor(F.col("lead_h") / 24).cast("int")), F.lit("model_forecast")
        missing, carried = F.col("reason"), F.lit(on_missing == "persist")
        future = F.lit(False)
    elif policy == PERSISTENCE:
        out = out.withColumn("lead_h", F.lit(None).cast("int")).withColumn("model", F.lit(None).cast("string"))
        direct, day, name = base_there & (F.col("want_day") == F.col("analysis_day")), F.col("analysis_day"), F.lit("observed_analysis")
        missing, carried, future = F.lit("departure_analysis_absent"), base_there, F.lit(False)
    else:
        out = out.withColumn("lead_h", F.lit(None).cast("int")).withColumn("model", F.lit(None).cast("string"))
        direct, day, name = F.col("_own").isNotNull(), F.col("want_day"), F.lit("observed_analysis")
        missing = F.when(F.lit(on_missing == "persist"), F.lit("departure_analysis_absent")).otherwise(F.lit("no_analysis_of_the_day"))
        carried, future = F.lit(on_missing == "persist") & base_there, F.col("want_day") > F.col("analysis_day")
    lost = F.concat_ws(" ", F.lit("nothing is substituted for bucket"), "bucket", F.lit("on"), "want_day", missing)
    refused = F.raise_error(lost).cast("string") if on_missing == "error" else F.lit("unavailable")
    source = F.when(direct, name).when(carried, "explicit_persistence").otherwise(refused)
    persisted = F.col("source_type") == "explicit_persistence"
    return (out.withColumn("source_type", source).withColumn("persisted", persisted)
            .withColumn("environment_day", F.when(persisted, F.col("analysis_day")).when(F.col("source_type") != "unavailable", day))
            .withColumn("fallback", F.when(persisted, F.concat(F.lit("persisted_from_"), F.col("analysis_day").cast("string"))))
            .withColumn("uses_future_observation", (F.col("source_type") == "observed_analysis") & future)
            .withColumn("reason", F.when(F.col("source_type") == "unavailable", missing)).withColumn("policy", F.lit(policy))
            .select("request", "bucket", "policy", "valid_from", "valid_to", "analysis_day", "want_day", "environment_day", "source_type", "lead_h", "model",
                    "fallback", "persisted", "uses_future_observation", "reason"))
