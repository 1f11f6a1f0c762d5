"""Environment policies bucket by bucket, refusals included, and states at any hour."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from floeframe.operators import exposure
from floeframe.operators import timeline as tl


def voyage(spark, departure="2025-01-08 06:00:00", buckets=(0, 1, 3, 4, 8)):
    return spark.createDataFrame([(1, b) for b in buckets], "request int, bucket int").withColumn("departure", F.lit(departure).cast("timestamp_ntz"))


def day_table(spark, *days):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "day date")


def made(spark, *leads):
    return spark.createDataFrame([(dt.date(2025, 1, 8), lead, "m") for lead in leads], "origin date, lead_h int, model string")


def told(df, *columns):
    return {r["bucket"]: tuple(str(r[c]) if isinstance(r[c], dt.date) else r[c] for c in columns) for r in df.collect()}


def test_persistence_carries_the_departure_day_and_says_so(spark):
    out = tl.timeline(voyage(spark), made(spark), day_table(spark, "2025-01-08"), tl.PERSISTENCE, 21600.0)
    assert told(out, "source_type", "environment_day", "fallback") == {
        b: ("observed_analysis", "2025-01-08", None) if b < 3 else ("explicit_persistence", "2025-01-08", "persisted_from_2025-01-08") for b in (0, 1, 3, 4, 8)}
    absent = voyage(spark), made(spark), day_table(spark, "2025-01-07"), tl.PERSISTENCE, 21600.0
    assert set(told(tl.timeline(*absent, on_missing="refuse"), "source_type", "reason").values()) == {("unavailable", "departure_analysis_absent")}
    with pytest.raises(Exception, match="nothing is substituted"):
        tl.timeline(*absent).collect()
    assert "unavailable" not in str(told(tl.timeline(voyage(spark), made(spark), day_table(spark), tl.PERSISTENCE, 21600.0), "source_type"))


def test_dated_observations_are_flagged_and_never_substituted_unasked(spark):
    asked = voyage(spark), made(spark), day_table(spark, "2025-01-08", "2025-01-09"), tl.DATED_OBSERVATION, 21600.0
    with pytest.raises(Exception, match="2025-01-10"):
        tl.timeline(*asked).collect()
    out = told(tl.timeline(*asked, on_missing="persist"), "source_type", "environment_day", "uses_future_observation", "persisted")
    assert out[0] == ("observed_analysis", "2025-01-08", False, False) and out[3] == out[4] == ("observed_analysis", "2025-01-09", True, False)
    late = told(tl.timeline(voyage(spark, buckets=(8,)), *asked[1:], on_missing="persist"), "source_type", "environment_day", "persisted")
    assert late == {8: ("explicit_persistence", "2025-01-08", True)}
    gone = told(tl.timeline(voyage(spark), made(spark), day_table(spark, "2025-01-09"), tl.DATED_OBSERVATION, 21600.0, on_missing="persist"), "source_type", "reason")
    assert gone[0] == ("unavailable", "departure_analysis_absent") and gone[3] == ("observed_analysis", None)


def test_a_forecast_prices_only_windows_inside_its_day(spark):
    asked = voyage(spark, buckets=(0, 1, 2, 3, 6, 7, 12)), made(spark, 24), day_table(spark, "2025-01-08"), tl.MODEL_FORECAST, 21600.0
    out = told(tl.timeline(*asked, on_missing="refuse"), "source_type", "lead_h", "environment_day", "reason")
    none = lambda why: ("unavailable", None, None, why)
    assert out == {0: none("no_sub_daily_target"), 1: none("no_sub_daily_target"), 2: none("not_covered"), 3: ("model_forecast", 24, "2025-01-09", None),
                   6: ("model_forecast", 24, "2025-01-09", None), 7: none("field_not_made"), 12: none("not_covered")}
    shifted = voyage(spark, "2025-01-08 20:00:00", (0, 1)), *asked[1:]           # 20-02 spans two days
    assert told(tl.timeline(*shifted, on_missing="refuse"), "source_type", "reason") == {0: ("unavailable", "not_covered"), 1: ("model_forecast", None)}
    with pytest.raises(Exception, match="nothing is substituted for bucket"):
        tl.timeline(*asked).collect()
    kept = told(tl.timeline(*asked[:3], tl.LONG_HORIZON, 21600.0, "persist"), "source_type", "policy", "environment_day")
    assert kept[0] == ("explicit_persistence", tl.LONG_HORIZON, "2025-01-08") and kept[3][0] == "model_forecast"


def test_an_exact_time_rule_covers_its_instant_only(spark):
    day = dt.datetime(2025, 1, 8)
    rows = [(1, day.date(), day + dt.timedelta(hours=a), day + dt.timedelta(hours=b)) for a, b in ((24, 24), (24, 30), (25, 25), (48, 48))]
    asked = spark.createDataFrame(rows, "request int, analysis_day date, valid_from timestamp_ntz, valid_to timestamp_ntz")
    got = [(r["lead_h"], r["reason"]) for r in tl.resolved(asked, made(spark, 24), tl.EXACT_TIME).orderBy("valid_from", "valid_to").collect()]
    assert got == [(24, None), (None, "not_covered"), (None, "not_covered"), (None, "field_not_made")]


@pytest.mark.parametrize("bad", [dict(policy="whatever"), dict(on_missing="guess"), dict(bucket_s=0.0), dict(bucket_s=float("nan")),
                                 dict(policy=tl.MODEL_FORECAST, rule=tl.EXACT_TIME)])
def test_senseless_timelines_are_refused(spark, bad):
    with pytest.raises(ValueError):
        tl.timeline(voyage(spark), made(spark), day_table(spark), **{"policy": tl.PERSISTENCE, "bucket_s": 21600.0, **bad})


def test_a_negative_bucket_is_refused(spark):
    with pytest.raises(Exception, match="zero or more"):
        tl.timeline(voyage(spark, buckets=(-1, 0)), made(spark), day_table(spark), tl.PERSISTENCE, 21600.0).collect()


def test_states_bracket_any_hour(spark):
    states = spark.createDataFrame([("a", 0.0, -60.0, 179.0), ("a", 24.0, -61.0, -179.0), ("a", 48.0, -61.5, -178.0), ("b", 24.0, -70.0, 10.0)],
                                   "id string, hours double, lat double, lon double")
    asked = spark.createDataFrame([(i, h) for i in "abc" for h in (-1.0, 0.0, 6.0, 24.0, 30.0, 48.0, 49.0)], "id string, at_h double")
    out = {(r["id"], r["at_h"]): r for r in exposure.state_at(states, asked, ["id"]).collect()}
    assert len(out) == 21
    near = out["a", 6.0]
    assert (near["lat"], near["lon"], near["from_h"], near["to_h"], near["exact"], near["outside"]) == (-60.25, pytest.approx(179.5), 0.0, 24.0, False, False)
    assert out["a", 30.0]["lon"] == pytest.approx(-178.75) and out["a", 24.0]["exact"] and out["a", 24.0]["lon"] == -179.0
    assert all(out["a", h]["outside"] and out["a", h]["lat"] is None for h in (-1.0, 49.0))
    assert [h for h in (-1.0, 0.0, 24.0, 30.0) if not out["b", h]["outside"]] == [24.0] and out["c", 24.0]["outside"]
