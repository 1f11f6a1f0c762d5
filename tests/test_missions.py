"""Missions: departures as bits, sites placed before scenarios multiply."""

import datetime as dt
import random

from pyspark.sql import functions as F

from floeframe.operators import missions as op
from floeframe.plans import missions


def test_departures_are_counted_by_bits(spark):
    rng = random.Random(5)
    base = dt.datetime(1969, 12, 20)
    rows = [(s, base + dt.timedelta(hours=rng.randrange(700), minutes=rng.choice([0, 0, 30]))) for s in range(3) for _ in range(200)]
    df = op.scenarios(spark.createDataFrame(rows, "site int, reference timestamp"), [0, 6, 12, 18], ["a", "b"])
    got = {r["site"]: tuple(r)[1:] for r in op.departure_counts(df, "site").collect()}
    want = {r["site"]: tuple(r)[1:] for r in df.groupBy("site").agg(
        F.count(F.lit(1)), F.countDistinct("departure"), F.min("departure"), F.max("departure")).collect()}
    assert got == want


def test_sites_are_placed_before_scenarios_multiply(spark):
    """No join above the expansion into offsets and profiles."""
    plan = missions.option_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, x in enumerate(plan) if "Generate explode" in x)
    assert not [x for x in plan[:first] if "Join" in x]
