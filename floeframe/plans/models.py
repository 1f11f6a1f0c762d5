"""Modelling queries: skill is compared, never single predictions, so only their inputs have SQL twins."""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import forecast as fop
from ..operators import models as op
from ..session import stored
from ..sources import tables as t
from . import drift as dr
from .registry import query
from .sql import using

#: Most rows of each band in a fit, whatever the size of the input; bands with fewer give all they have.
QUOTAS = {"open": 500_000, "miz": 500_000, "ice": 1_000_000}


def split_rows(spark, sf, lead=1):
    """Supervised rows with features and split; read several times, so stored once."""
    rows = op.with_features(fop.supervised_cells(t.forecast_cells(spark, sf), lead))
    return stored(fop.with_split(rows, base="day", target="target_day"))


def training_sample(rows, quotas=QUOTAS, strict=False):
    """Training rows by quota; with ``strict`` a band that cannot fill its quota fails the job."""
    train = rows.where("split = 'train'")
    return stored(fop.stratified_sample(train, quotas, fop.cell_hash(), ["day", "r", "c"], strict=strict))


@query("gbt_skill")
def gbt_skill(spark, sf):
    """Boosted trees on the stratified sample, scored on whole validation and test splits."""
    rows = split_rows(spark, sf)
    fitted = op.fit(training_sample(rows), op.FEATURES)
    scored = op.predict(rows.where("split <> 'train'"), fitted, "model")
    return op.skill_table(scored, {"model": "model", "persistence": "sic"}, "label", ["split"])


@query("gbt_skill_48h")
def gbt_skill_48h(spark, sf):
    """The two-day lead has its own rows, its own fit and its own scores."""
    rows = split_rows(spark, sf, lead=2)
    scored = op.predict(rows.where("split <> 'train'"), op.fit(training_sample(rows), op.FEATURES), "model")
    return op.skill_table(scored, {"model": "model", "persistence": "sic"}, "label", ["split"])


@query("ablation")
def ablation(spark, sf):
    """Persistence, one feature and all features on the same sample."""
    rows = split_rows(spark, sf)
    sample = training_sample(rows)
    scored = rows.where("split <> 'train'")
    sets = {"sic_only": ["sic"], "all_features": op.FEATURES}
    for name, fitted in zip(sets, op.together([partial(op.fit, sample, features) for features in sets.values()])):
        scored = op.predict(scored, fitted, name).drop("clipped")
    table = op.skill_table(scored, {"persistence": "sic", "sic_only": "sic_only", "all_features": "all_features"}, "label", ["split"])
    base = table.where("predictor = 'persistence'").select("split", F.col("mae_miz").alias("_base"))
    return table.join(F.broadcast(base), "split").withColumn("miz_gain", F.round(F.col("_base") - F.col("mae_miz"), 6)).drop("_base")


@query("importance")
def importance(spark, sf):
    rows = split_rows(spark, sf)
    fitted = op.fit(training_sample(rows), op.FEATURES)
    return op.permutation_importance(rows.where("split = 'val'"), fitted, op.FEATURES, "label",
                                     F.struct("day", "r", "c"), repeats=5)


RESIDUAL_FEATURES = ["lat0", "lon0", "wind_u", "wind_v", "cur_u", "cur_v", "disp_e", "disp_n"]
#: The three fixed settings; depths 4 and 5 hold 15 and 31 leaves. All rounds are kept.
SETTINGS = [{"trees": 100, "depth": 4, "step": 0.05, "leaf_rows": 20}, {"trees": 200, "depth": 5, "step": 0.05, "leaf_rows": 20},
            {"trees": 100, "depth": 4, "step": 0.1, "leaf_rows": 40}]


@query("residual_model")
def residual_model(spark, sf):
    """East and north residual models on moved training rows; the setting is chosen on validation only."""
    pop = dr.scored_population(spark, sf)
    de, dn = ex.displacement(F.col("lat0"), F.col("lon0"), F.col("plat"), F.col("plon"))
    oe, on = ex.displacement(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1"))
    rows = stored(pop.withColumn("disp_e", de).withColumn("disp_n", dn).withColumn("res_e", oe - de).withColumn("res_n", on - dn))
    train = rows.where("moved AND split = 'train'")
    parts = None
    fits = [(k, comp) for k in range(len(SETTINGS)) for comp in ("e", "n")]
    models = dict(zip(fits, op.together([partial(op.fit, train, RESIDUAL_FEATURES, f"res_{comp}", patience=None, **SETTINGS[k]) for k, comp in fits])))
    for k in range(len(SETTINGS)):
        scored = rows.where("moved AND split <> 'train'")
        for comp in ("e", "n"):
            scored = op.predict(scored, models[k, comp], f"fix_{comp}", clip=None)
        s = F.col("elapsed_s")
        lat, lon = ex.advect(F.col("lat0"), F.col("lon0"), (F.col("disp_e") + F.col("fix_e")) / s, (F.col("disp_n") + F.col("fix_n")) / s, s)
        err = ex.great_circle_m(lat, lon, F.col("lat1"), F.col("lon1")) / 1000
        one = scored.groupBy("split").agg(F.lit(k).alias("setting"), F.count(F.lit(1)).alias("n"), F.avg("err_km").alias("physics_km"),
                                          F.avg(err).alias("corrected_km"))
        parts = one if parts is None else parts.unionByName(one)
    parts = stored(parts)
    chosen = (parts.where("split = 'validation'").orderBy("corrected_km", "setting").limit(1).select(F.col("setting").alias("_s")))
    return (parts.join(F.broadcast(chosen), F.lit(True)).withColumn("chosen", F.col("setting") == F.col("_s")).drop("_s")
            .withColumn("physics_km", F.round("physics_km", 4)).withColumn("corrected_km", F.round("corrected_km", 4)))


def held_out_origins(spark, sf):
    """Every cell of the test days that has its features, whether or not the next day was observed."""
    rows = op.with_features(fop.origin_rows(t.ice_cells(spark, sf), t.current_cells(spark, sf)))
    return fop.refuse_later_inputs(rows.where(fop.split_of(F.col("day")) == "test"), "day", ["ice_day", "current_day"])


@query("predict_inputs", using("ice_cells current_cells", """SELECT day AS origin, CAST(day + 1 AS DATE) AS valid_day, count(*) AS cells,
    round(avg(sic), 6) AS mean_sic, round(avg(sqrt(u * u + v * v)), 6) AS mean_speed FROM ice_cells JOIN current_cells USING (day, r, c)
    WHERE sic IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL AND day BETWEEN DATE '2025-12-01' AND DATE '2025-12-31' GROUP BY day"""))
def predict_inputs(spark, sf):
    """What ``predict_field`` predicts from, by origin."""
    return held_out_origins(spark, sf).groupBy(F.col("day").alias("origin"), "valid_day").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.avg("sic"), 6).alias("mean_sic"), F.round(F.avg("speed"), 6).alias("mean_speed"))


@query("predict_field")
def predict_field(spark, sf):
    """Batch prediction of the held-out origins, clipped to 0..100 with the clipped cells counted."""
    fitted = op.fit(training_sample(split_rows(spark, sf)), op.FEATURES)
    out = op.predict(held_out_origins(spark, sf), fitted, "model")
    return out.groupBy(F.col("day").alias("origin"), "valid_day").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if("clipped").alias("clipped"), F.round(F.avg("model"), 4).alias("mean_sic"),
        F.count_if(~F.col("model").between(0, 100)).alias("out_of_range"))


@query("hindcast")
def hindcast(spark, sf):
    """Model, persistence and observation on commonly valid cells of one origin in and one out of training."""
    rows = split_rows(spark, sf)
    fitted = op.fit(training_sample(rows), op.FEATURES)
    picked = rows.where(F.col("day").isin(dt.date(2025, 1, 8), dt.date(2025, 12, 15)))
    scored = op.predict(picked, fitted, "model").withColumn("in_training", F.col("split") == "train")
    return op.skill_table(scored, {"model": "model", "persistence": "sic"}, "label", ["day", "in_training"])
