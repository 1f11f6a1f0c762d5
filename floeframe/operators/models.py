"""Boosted-tree jobs on Spark ML, and the audits around them."""

from __future__ import annotations

import math
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from . import forecast as fc

FEATURES = ["sic", "u", "v", "speed"]
SIC_RANGE = (0.0, 100.0)
PROBE = 1.5                      # times the patience: rounds of the first, short fit; the second has twice as many
TASK_ROWS = 100_000              # rows of one task in the passes of a fit


def leakage_audit(pairs: DataFrame) -> DataFrame:
    """Splits must be disjoint, in order, and one lead apart (aggregates per day first)."""
    days = (pairs.groupBy("base_day", "target_day").agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("split", fc.split_of(F.col("base_day")))
            .withColumn("tsplit", fc.split_of(F.col("target_day"))))
    lead = F.datediff("target_day", "base_day")
    edge = lambda f, s: f(F.when(F.col("split") == s, F.col("base_day")))
    per_day = days.groupBy("base_day").agg(F.countDistinct("split").alias("splits"))
    shared = per_day.agg(F.count_if(F.col("splits") > 1).alias("shared_keys"))
    return days.agg(
        F.coalesce(F.sum(F.when(F.col("split") != F.col("tsplit"), F.col("rows"))), F.lit(0)).alias("straddling"),
        F.bool_and(lead == 1).alias("one_lead"), F.countDistinct(lead).alias("leads"),
        (edge(F.max, "train") < edge(F.min, "val")).alias("train_before_val"),
        (edge(F.max, "val") < edge(F.min, "test")).alias("val_before_test"),
    ).join(F.broadcast(shared), F.lit(True))          # two one-row tables


def field_difference(stored: DataFrame, now: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Row count and rows that differ, in either direction."""
    cols = key + values
    a, b = stored.select(*cols), now.select(*cols)
    tag = (a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
           .groupBy(*cols).agg(F.sum("_s").alias("_net"), F.count_if(F.col("_s") == 1).alias("_n")))
    return tag.agg(F.lit("stored").alias("side"), F.sum("_n").alias("cells"),
                   F.sum(F.abs("_net")).cast("long").alias("differing"))


def with_features(rows: DataFrame) -> DataFrame:
    return rows.withColumn("speed", F.hypot("u", "v"))


def rounds_used(losses: list[float], patience: int, tol: float = 1e-7) -> int:
    """Rounds until none of the last ``patience`` validation losses is below the one before them."""
    for m in range(patience, len(losses)):
        if min(losses[m - patience + 1:m + 1]) >= losses[m - patience] - tol:
            return m + 1
    return len(losses)


def fit_tasks(rows: int) -> int:
    """Tasks of a fit's passes: as many as its rows are worth, since a level of a tree is a job of its own, of 0.1 s or less."""
    return max(1, -(-rows // TASK_ROWS))


def leaf_limit(gbt: GBTRegressor, leaf_rows: int, rows: int) -> dict:
    """Settings for at least ``leaf_rows`` of the ``rows`` in a leaf, where a weighted row stands for several.

    Spark takes a share of the weight below one half; with fewer than two leaves' rows nothing is split, as by its count of rows.
    """
    if rows < 2 * leaf_rows:
        return {gbt.minInstancesPerNode: leaf_rows}
    return {gbt.minWeightFractionPerNode: (leaf_rows - 0.5) / rows}


def fit(rows: DataFrame, features: list[str], label: str = "label", trees: int = 200, depth: int = 5, seed: int = 7,
        leaf_rows: int = 50, step: float = 0.1, patience: int | None = 20):
    """A fitted (assembler, model) pair: up to ``trees`` rounds, ``depth`` levels, at least ``leaf_rows`` rows in a leaf.

    With ``patience`` a tenth of ``rows``, picked by hash, is kept out of the fit and the rounds end when that many in a row
    bring no lower loss on it. Spark's own rule ends at the first such round, so the rounds are fitted and counted first, a few
    (``PROBE``), then twice as many and only then all of them; the same seed and rows then give the same trees again, up to the
    counted one. Measured values repeat, so equal rows are stored once, with their number as weight: the passes grow with the
    distinct rows, while means, losses, splits and ``leaf_rows`` count them all. The distinct rows are dealt out evenly,
    ``TASK_ROWS`` to a task, however few files they come from.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    gbt = GBTRegressor(featuresCol="features", labelCol=label, weightCol="_rows", predictionCol="prediction", maxIter=trees, maxDepth=depth,
                       seed=seed, stepSize=step)
    held = F.pmod(F.xxhash64(*features, label), F.lit(10)) == 0
    rows = stored(rows.groupBy(*features, label).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_held", held))
    part = {r["_held"]: (r["n"], r["rows"]) for r in
            rows.groupBy("_held").agg(F.count(F.lit(1)).alias("n"), F.sum("_rows").alias("rows")).collect()}
    ready = assembler.transform(rows.repartition(fit_tasks(sum(n for n, _ in part.values()))))
    if patience is None or trees <= patience or len(part) < 2:
        return assembler, gbt.copy(leaf_limit(gbt, leaf_rows, sum(all_rows for _, all_rows in part.values()))).fit(ready)
    used, kept_out = ready.where(~F.col("_held")), ready.where("_held")
    gbt = gbt.copy(leaf_limit(gbt, leaf_rows, part[False][1]))
    few = math.ceil(PROBE * patience)
    for upto in (min(trees, few), min(trees, 2 * few), trees):
        model = gbt.copy({gbt.maxIter: upto}).fit(used)
        best = rounds_used(model.evaluateEachIteration(kept_out, "squared"), patience)
        if best < upto or upto == trees:
            return assembler, model if best == upto else gbt.copy({gbt.maxIter: best}).fit(used)


def together(jobs: list) -> list:
    """Results of ``jobs`` (functions of nothing), run side by side: a fit is a long chain of short Spark jobs that leave cores idle."""
    inherits = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPool(len(jobs)) as pool:
        return pool.map(lambda job: inherits(job)(), jobs, chunksize=1)


def predict(rows: DataFrame, fitted, name: str = "prediction", clip=SIC_RANGE) -> DataFrame:
    assembler, model = fitted
    out = model.transform(assembler.transform(rows)).drop("features")
    if clip:
        raw = F.col("prediction")
        out = (out.withColumn("clipped", ~raw.between(*clip))
               .withColumn("prediction", F.greatest(F.lit(clip[0]), F.least(raw, F.lit(clip[1])))))
    return out.withColumnRenamed("prediction", name) if name != "prediction" else out


def skill_table(rows: DataFrame, predictions: dict[str, str], truth: str, by: list[str]) -> DataFrame:
    """Skill of several prediction columns on the same rows, one row per predictor."""
    long = rows.withColumn("_p", F.explode(F.array(*[
        F.struct(F.lit(name).alias("predictor"), F.col(c).cast("double").alias("value"))
        for name, c in predictions.items()])))
    p, y = F.col("_p.value"), F.col(truth)
    return (long.groupBy(*by, F.col("_p.predictor").alias("predictor"))
            .agg(*fc.skill(p, y), *fc.banded(p, y), F.round(F.avg(p - y), 6).alias("bias")))


def permutation_importance(rows: DataFrame, fitted, features: list[str], label: str,
                           order: Column, repeats: int = 5, seed: int = 11) -> DataFrame:
    """Rise of the mean absolute error when one feature is shuffled among the rows.

    In each repeat the donors are ranked by a hash of their order key, so that a row's donor has nothing to do with its
    place or day; rows and donors meet by rank (range sort plus slice offsets), so no task holds all rows. All features
    of a repeat are exchanged in the same pass, and rows and donors of all repeats are ranked side by side.
    """
    from ..functions.ordered import global_rank
    hashed = lambda k: F.struct(F.xxhash64(F.lit(seed + k), order).alias("h"), order.alias("key")).alias("_o")
    sides = [rows.select(*features, label, order.alias("_o")), *[rows.select(F.struct(*features).alias("_d"), hashed(k)) for k in range(repeats)]]
    ranked, *dealt = together([partial(global_rank, side, ["_o"], "_rank") for side in sides])
    base = predict(rows, fitted, clip=None).agg(F.avg(F.abs(F.col("prediction") - F.col(label))).alias("base"))
    swapped = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"_d.{g}" if g == f else g).alias(g) for g in features]) for f in features]))
    parts = []
    for k, donors in enumerate(dealt):
        mixed = ranked.join(donors.select("_rank", "_d"), "_rank").select(label, swapped.alias("_s")).select(label, "_s.*")
        parts.append(predict(mixed, fitted, clip=None).groupBy("feature").agg(
            F.lit(k).alias("repeat"), F.avg(F.abs(F.col("prediction") - F.col(label))).alias("mae")))
    scored = reduce(DataFrame.unionByName, parts)
    return (scored.groupBy("feature").agg(F.avg("mae").alias("mae"), F.stddev_samp("mae").alias("spread"))
            .join(F.broadcast(base), F.lit(True))
            .select("feature", F.round(F.col("mae") - F.col("base"), 6).alias("importance"),
                    F.round("spread", 6).alias("spread")))


def feature_redundancy(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Absolute correlation and median ratio of feature pairs."""
    from ..functions.ordered import exact_quantiles
    long = rows.select(F.explode(F.array(*[
        F.struct(F.lit(f"{a}/{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b"))
        for a, b in pairs])).alias("p")).select("p.*")
    ratio = long.withColumn("ratio", F.col("a") / F.nullif(F.col("b"), F.lit(0.0)))
    mid = exact_quantiles(ratio, ["pair"], "ratio", {"median_ratio": (0.5, "linear")})
    stats = long.groupBy("pair").agg(F.abs(F.corr("a", "b")).alias("abs_corr"))
    return stats.join(mid, "pair", "left").select(
        "pair", F.round("abs_corr", 6).alias("abs_corr"), F.round("median_ratio", 6).alias("median_ratio"),
        F.coalesce(F.col("abs_corr") > 0.999, F.lit(False)).alias("degenerate"))
