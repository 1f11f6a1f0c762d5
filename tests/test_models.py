"""Model jobs on tables with a planted signal, and what a forecast may know."""

import datetime as dt
import inspect

import pytest
from pyspark.sql import functions as F

from floeframe.operators import forecast as fc
from floeframe.operators import models as op
from floeframe.plans import models as plans
from floeframe.plans.models import SETTINGS
from floeframe.sources import tables as t


def test_importance_finds_the_planted_feature(spark):
    mixed = lambda k, m: F.abs(F.xxhash64(F.lit(k), "id")) % m
    rows = spark.range(2000).select("id", mixed(1, 100).cast("double").alias("a"), mixed(2, 100).cast("double").alias("b"))
    rows = rows.withColumn("label", F.col("a") * 0.9 + 0.01 * F.col("b"))
    fitted = op.fit(rows, ["a", "b"], trees=3, depth=3)
    got = {r["feature"]: r["importance"] for r in op.permutation_importance(rows, fitted, ["a", "b"], "label", F.struct("id"), repeats=2).collect()}
    assert got["a"] > 15 and abs(got["b"]) < 1
    table = {r["predictor"]: r["mae"] for r in op.skill_table(op.predict(rows, fitted, "model").withColumn("none", F.lit(45.0)),
                                                             {"model": "model", "none": "none"}, "label", []).collect()}
    assert table["model"] < table["none"] / 3


def test_fits_have_the_rounds_of_the_reference(spark):
    assert op.rounds_used([5.0, 4.0, 4.5, 3.0, 3.0, 3.1, 3.2, 1.0], 3) == 7 and op.rounds_used([3.0, 2.0, 1.0], 3) == 3
    given = {k: v.default for k, v in inspect.signature(op.fit).parameters.items()}
    assert (given["trees"], given["depth"], given["step"], given["leaf_rows"], given["patience"]) == (200, 5, 0.1, 50, 20)
    assert [(s["trees"], s["depth"], s["step"], s["leaf_rows"]) for s in SETTINGS] == [(100, 4, 0.05, 20), (200, 5, 0.05, 20), (100, 4, 0.1, 40)]
    noise = spark.range(600).select(F.rand(1).alias("a"), F.rand(2).alias("label"))
    _, model = op.fit(noise, ["a"], trees=12, depth=2, leaf_rows=5, step=1.0, patience=2)
    assert 3 <= model.getNumTrees < 12                 # noise gets no better, so the rounds end early


def test_a_short_fit_comes_first_and_rows_decide_the_tasks(spark, monkeypatch):
    asked, whole = [], op.GBTRegressor.fit
    monkeypatch.setattr(op.GBTRegressor, "fit", lambda self, rows, params=None: (asked.append((self.getMaxIter(), rows.rdd.getNumPartitions())), whole(self, rows, params))[1])
    noise = spark.range(600).select(F.rand(1).alias("a"), F.rand(2).alias("label"))
    _, model = op.fit(noise, ["a"], trees=40, depth=2, leaf_rows=5, step=1.0, patience=2)
    assert asked[0][0] == op.PROBE * 2 and asked[-1][0] == model.getNumTrees and (40 not in [n for n, _ in asked])
    assert {tasks for _, tasks in asked} == {1}        # however many partitions the rows come in
    assert [op.fit_tasks(n) for n in (0, 1, op.TASK_ROWS, op.TASK_ROWS + 1, 5 * op.TASK_ROWS)] == [1, 1, 1, 2, 5]
    assert op.together([lambda: 1, lambda: 2]) == [1, 2]


def test_a_forecast_needs_no_observation_of_its_valid_day(spark):
    day = dt.date(2025, 12, 5)
    ice = spark.createDataFrame([(day, 0, 0, 50.0), (day, 0, 1, None), (day, 0, 2, 70.0)], "day date, r int, c int, sic double")
    currents = spark.createDataFrame([(day, 0, c, 0.1, 0.2) for c in (0, 1)], "day date, r int, c int, u double, v double")
    rows = fc.origin_rows(ice, currents)
    assert [(r["c"], r["valid_day"]) for r in rows.collect()] == [(0, dt.date(2025, 12, 6))]
    assert fc.supervised_rows(ice, currents).count() == 0
    assert fc.refuse_later_inputs(rows, "day", ["ice_day", "current_day"]).count() == 1
    late = rows.withColumn("current_day", F.date_add("day", 1))
    with pytest.raises(Exception, match="later than its origin"):
        fc.refuse_later_inputs(late, "day", ["ice_day", "current_day"]).collect()


def test_a_changed_cell_is_found(spark):
    a = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "k int, v double")
    b = spark.createDataFrame([(1, 5.0), (2, None), (3, 8.0)], "k int, v double")
    assert op.field_difference(a, a, ["k"], ["v"]).first()["differing"] == 0
    assert op.field_difference(a, b, ["k"], ["v"]).first()["differing"] == 2


def test_rows_of_a_forecast_are_shuffled_once(spark, monkeypatch, capsys):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(plans, "stored", lambda df: df)
    rows = plans.split_rows(spark, sf)
    rows.explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    columns = ["day", "r", "c", "target_day", *[F.round(x, 9).alias(x) for x in ("sic", "label", "u", "v")]]
    joined = fc.with_split(fc.supervised_rows(t.ice_cells(spark, sf), t.current_cells(spark, sf)), base="day", target="target_day")
    one, two = rows.select(*columns), joined.select(*columns)
    assert one.count() == two.count() > 0 and one.exceptAll(two).isEmpty()


def test_the_rows_of_a_fit_occupy_several_cores(spark):
    assert op.fit_tasks(400_000) >= 4                  # a task of so many rows took 0.2 s a level, and other cores waited


def test_rounds_that_end_at_once_cost_few(spark, monkeypatch):
    asked, whole = [], op.GBTRegressor.fit
    monkeypatch.setattr(op.GBTRegressor, "fit", lambda self, rows, params=None: (asked.append(self.getMaxIter()), whole(self, rows, params))[1])
    noise = spark.range(600).select(F.rand(1).alias("a"), F.rand(2).alias("label"))
    for counted, trees, want in ((5, 40, [6, 5]), (9, 40, [6, 12, 9]), (99, 15, [6, 12, 15])):      # [12, 5] before
        asked.clear()
        monkeypatch.setattr(op, "rounds_used", lambda losses, patience: min(len(losses), counted))
        assert op.fit(noise, ["a"], trees=trees, depth=1, patience=4)[1].getNumTrees == want[-1] and asked == want


def test_equal_rows_are_fitted_once_and_count_as_many(spark, monkeypatch):
    asked, whole = [], op.GBTRegressor.fit
    monkeypatch.setattr(op.GBTRegressor, "fit", lambda self, rows, params=None: (asked.append(rows.count()), whole(self, rows, params))[1])
    mixed = lambda k, m: F.abs(F.xxhash64(F.lit(k), "id")) % m
    rows = spark.range(3000).select(mixed(1, 8).cast("double").alias("a"), (mixed(2, 25) % 6).cast("double").alias("b"), mixed(3, 3).alias("n"))
    rows = rows.select("a", "b", (F.col("a") * F.col("b") + F.col("n")).alias("label"))
    assembler, model = op.fit(rows, ["a", "b"], trees=6, depth=3, leaf_rows=150, patience=None)
    plain = op.GBTRegressor(featuresCol="features", labelCol="label", maxIter=6, maxDepth=3, seed=7, minInstancesPerNode=150, stepSize=0.1)
    one, two = model, plain.fit(assembler.transform(rows))
    assert asked == [rows.distinct().count(), 3000]                     # [3000, 3000] before
    spots = assembler.transform(rows.select("a", "b").distinct())
    both = one.transform(spots).select("a", "b", F.col("prediction").alias("p")).join(two.transform(spots).select("a", "b", "prediction"), ["a", "b"])
    assert both.where(F.abs(F.col("p") - F.col("prediction")) > 1e-9).isEmpty() and both.count() == 48
    asked.clear()
    _, model = op.fit(rows, ["a", "b"], trees=30, depth=2, patience=4)  # rows kept out are weighted too
    assert asked and max(asked) < rows.distinct().count() and model.getNumTrees > 1


@pytest.mark.parametrize("few, total, split", [(50, 200, True), (49, 200, False), (49, 98, False), (50, 100, True)])
def test_a_leaf_holds_its_rows_however_often_they_repeat(spark, few, total, split):
    rows = spark.range(total).select(F.when(F.col("id") < few, 1.0).otherwise(0.0).alias("a"))
    _, model = op.fit(rows.withColumn("label", F.col("a") * 100), ["a"], trees=1, depth=1, leaf_rows=50)
    assert (model.totalNumNodes == 3) == split


def test_rows_and_donors_of_all_repeats_are_ranked_side_by_side(spark, monkeypatch):
    jobs, side_by_side = [], op.together
    monkeypatch.setattr(op, "together", lambda some: (jobs.append(len(some)), side_by_side(some))[1])
    rows = spark.range(400).select("id", F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("label"))
    fitted = op.fit(rows, ["a"], trees=2, depth=3)
    got = op.permutation_importance(rows, fitted, ["a"], "label", F.struct("id"), repeats=3).collect()
    assert jobs == [4] and got[0]["importance"] > 100          # [] before: one after the other
