"""Scenarios, outcomes, selections, lineage and the backtest roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scenarios(requests: DataFrame, offsets_h: list[int], profiles: list[str]) -> DataFrame:
    """Each requested (site, reference time) at every departure offset and profile.

    Offsets and profiles are short parameter lists, expanded inside the row; a
    negative offset is refused before any work starts.
    """
    if any(h < 0 for h in offsets_h):
        raise ValueError("a departure before the reference time is refused")
    out = requests.withColumn("offset_h", F.explode(F.array(*[F.lit(h) for h in offsets_h])))
    out = out.withColumn("departure", F.col("reference") + F.make_dt_interval(hours=F.col("offset_h")))
    return out.withColumn("profile", F.explode(F.array(*[F.lit(x) for x in profiles])))


SLOT_US = 6 * 3600 * 1_000_000       # departures fall into slots of six hours, 64 slots to a number


def departure_counts(rows: DataFrame, by: str) -> DataFrame:
    """Scenarios, distinct departures and their first and last, per site.

    Distinct departures are bits: equal places within a slot share numbers of 64 slots, combined on the map side, so that a
    site has one row per 16 days and place instead of one per departure.
    """
    at = F.unix_micros(F.col("departure").cast("timestamp"))
    place = F.pmod(at, F.lit(SLOT_US))
    slot = ((at - place) / SLOT_US).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_slot", F.lit(64)).cast("int"))
    words = (rows.withColumn("_slot", slot).groupBy(by, place.alias("_place"), F.call_function("shiftright", F.col("_slot"), F.lit(6)).alias("_word"))
             .agg(F.count(F.lit(1)).alias("_n"), F.bit_or(bit).alias("_bits"), F.min("departure").alias("_first"), F.max("departure").alias("_last")))
    return words.groupBy(by).agg(F.sum("_n").alias("scenarios"), F.sum(F.bit_count("_bits")).alias("departures"),
                                 F.min("_first").alias("first_departure"), F.max("_last").alias("last_departure"))


def outcome(blocked_end: Column, departs_s: Column, horizon_s: Column, dates_agree: Column) -> Column:
    """Why a scenario is not searched, in the order the checks run; a high cost is never a reason."""
    return (F.when(~dates_agree, "historical_date_mismatch").when(departs_s >= horizon_s, "forecast_unavailable")
            .when(blocked_end, "hard_navigation_constraint").otherwise("searchable"))


def mission_summary(options: DataFrame, by: str) -> DataFrame:
    """Options, feasible options and objectives available per site or departure."""
    ok = F.col("feasible")
    # the profiles are a short fixed list, so the set is bounded
    return options.groupBy(by).agg(
        F.count(F.lit(1)).alias("options"), F.count_if(ok).alias("feasible_options"), F.bool_or(ok).alias("any_feasible"),
        F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("profile")))), ",").alias("objectives"))


def select_option(options: DataFrame, keys: list[str], objective: str, direction: str, order: list[str]) -> DataFrame:
    """The caller's criterion among feasible options, with the number of ties; there is no default."""
    if direction not in ("min", "max"):
        raise ValueError("direction must be 'min' or 'max'")
    ok = options.where(F.col("feasible") & F.col(objective).isNotNull())
    value = F.col(objective) if direction == "min" else -F.col(objective)
    # ties are counted per (group, value) first, so one pass over small partials is enough
    per_value = ok.groupBy(*keys, F.col(objective).alias("value"), value.alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first"))
    best = F.min_by(F.struct("value", F.col("_n").alias("ties"), "_first"), "_v")
    return per_value.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.value", "b.ties", "b._first.*")


def lineage(artifacts: DataFrame, records: DataFrame) -> DataFrame:
    """Artifact hash to its one training record; none or several stay unresolved, with the reason."""
    known = records.groupBy("sha").agg(F.count(F.lit(1)).alias("matches"), F.min("dataset").alias("_dataset"))
    out = artifacts.join(known, "sha", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return (out.withColumn("dataset", F.when(F.col("matches") == 1, F.col("_dataset")))
            .withColumn("link", F.when(F.col("sha").isNull(), "no_hash").when(F.col("matches") == 1, "resolved")
                        .when(F.col("matches") == 0, "no_record").otherwise("ambiguous")).drop("_dataset"))


def skip_reasons(origins: DataFrame, days: DataFrame, window: tuple[str, str], leads: list[int], span: int) -> DataFrame:
    """First reason why an origin cannot be backtested, NULL when it can.

    Every needed day is one row (origin, offset), so all presence checks are one
    equi-join and one aggregate instead of one anti-join per reason.
    """
    offsets = sorted({0, *leads, *range(span)})
    need = origins.select("origin", F.explode(F.array(*[F.lit(k) for k in offsets])).alias("k"))
    need = need.withColumn("day", F.date_add("origin", F.col("k")))
    have = days.select("day").distinct().withColumn("_seen", F.lit(True))
    found = need.join(have, "day", "left").withColumn("gone", F.col("_seen").isNull())
    lost = lambda ks: F.bool_or(F.col("gone") & F.col("k").isin(*ks))
    flags = found.groupBy("origin").agg(lost([0]).alias("no_origin"), lost(leads).alias("no_target"),
                                        lost(list(range(span))).alias("no_realised"))
    inside = F.col("origin").between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date"))
    return flags.select("origin", F.when(~inside, "outside_held_out").when(F.col("no_origin"), "no_origin_observation")
                        .when(F.col("no_target"), "no_target_observation")
                        .when(F.col("no_realised"), "no_realised_observation").alias("reason"))


def backtest_rollup(cases: DataFrame) -> DataFrame:
    """Attempted, included, changed and realised cases, and which plan met the lower cost."""
    inc = F.col("reason").isNull()
    real = inc & F.col("realised_a").isNotNull() & F.col("realised_b").isNotNull()
    d = F.col("realised_b") - F.col("realised_a")
    return cases.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(inc).alias("included"), F.count_if(~inc).alias("skipped"),
        F.count_if(inc & F.col("changed")).alias("changed"), F.count_if(real).alias("realised"), F.count_if(inc & ~real).alias("not_realised"),
        F.count_if(real & F.col("changed") & (d < 0)).alias("forecast_lower"),
        F.count_if(real & F.col("changed") & (d > 0)).alias("persistence_lower"),
        F.count_if(real & (~F.col("changed") | (d == 0))).alias("tied_or_identical"))
