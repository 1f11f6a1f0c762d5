"""Forecast-chain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as op
from ..sources import tables as t
from .registry import query
from .sql import define, using

define("pairs", """SELECT b.day AS base_day, b.r, b.c, b.sic, x.day AS target_day, x.sic AS target_sic
    FROM ice_cells b JOIN ice_cells x ON x.day = b.day + 1 AND x.r = b.r AND x.c = b.c""", ["ice_cells"])
define("rows1", """SELECT i.day, i.r, i.c, i.sic, k.u, k.v, p.target_day, p.target_sic AS label
    FROM ice_cells i JOIN current_cells k USING (day, r, c)
    JOIN pairs p ON p.base_day = i.day AND p.r = i.r AND p.c = i.c
    WHERE i.sic IS NOT NULL AND k.u IS NOT NULL AND k.v IS NOT NULL AND p.target_sic IS NOT NULL""",
       ["ice_cells", "current_cells", "pairs"])

_SKILL = """count(*) AS n, round(avg(abs(sic - target_sic)), 6) AS mae,
    round(sqrt(avg((sic - target_sic) * (sic - target_sic))), 6) AS rmse,
    round(1 - sum((sic - target_sic) * (sic - target_sic)) / nullif(var_pop(target_sic) * count(*), 0), 6) AS r2"""
_BANDS = ", ".join(f"""round(avg(abs(sic - target_sic)) FILTER (WHERE {cond}), 6) AS mae_{b},
    count(*) FILTER (WHERE {cond}) AS n_{b}""" for b, cond in
    [("open", "target_sic < 15"), ("miz", "target_sic >= 15 AND target_sic < 80"), ("ice", "target_sic >= 80")])
_SPLIT = ("CASE WHEN {0} BETWEEN DATE '1900-01-01' AND DATE '2025-09-30' THEN 'train' "
          "WHEN {0} BETWEEN DATE '2025-10-01' AND DATE '2025-11-30' THEN 'val' "
          "WHEN {0} BETWEEN DATE '2025-12-01' AND DATE '2025-12-31' THEN 'test' END")
_BAND = "CASE WHEN {0} < 15 THEN 'open' WHEN {0} < 80 THEN 'miz' WHEN {0} >= 80 THEN 'ice' END"
_HASH = ("((date_diff('day', DATE '1970-01-01', day) * 7919 + CAST(r AS BIGINT) * 104729 "
         "+ CAST(c AS BIGINT) * 1299709) * 48271) % 2147483648")


@query("persistence_skill", using("pairs", f"""SELECT base_day, {_SKILL}, {_BANDS} FROM pairs
    WHERE sic IS NOT NULL AND target_sic IS NOT NULL GROUP BY ROLLUP (base_day)"""))
def persistence_skill(spark, sf):
    return op.persistence_skill(t.ice_cells(spark, sf))


@query("banded_mae", using("pairs", f"""SELECT {_BANDS} FROM pairs
    WHERE sic IS NOT NULL AND target_sic IS NOT NULL"""))
def banded_mae(spark, sf):
    pairs = op.lead_pairs(t.ice_cells(spark, sf)).dropna(subset=["sic", "target_sic"])
    return pairs.agg(*op.banded(F.col("sic"), F.col("target_sic")))


@query("lead_pairs", using("ice_cells", """SELECT b.day AS base_day, x.day AS target_day, b.r, b.c,
    round(b.sic, 6) AS sic, round(x.sic, 6) AS target_sic
    FROM ice_cells b JOIN ice_cells x ON x.day = b.day + 2 AND x.r = b.r AND x.c = b.c"""))
def lead_pairs(spark, sf):
    return (op.lead_pairs(t.ice_cells(spark, sf), lead=2)
            .select("base_day", "target_day", "r", "c", F.round("sic", 6).alias("sic"),
                    F.round("target_sic", 6).alias("target_sic")))


@query("valid_rows", using("rows1", """SELECT day, r, c, round(sic, 6) AS sic, round(u, 6) + 0.0 AS u,
    round(v, 6) + 0.0 AS v, round(sqrt(u * u + v * v), 6) AS speed, round(label, 6) AS label FROM rows1"""))
def valid_rows(spark, sf):
    """Complete feature rows: every feature and the label present."""
    rows = op.supervised_rows(t.ice_cells(spark, sf), t.current_cells(spark, sf))
    return (rows.select("day", "r", "c", F.round("sic", 6).alias("sic"), (F.round("u", 6) + 0.0).alias("u"),
                    (F.round("v", 6) + 0.0).alias("v"), F.round(F.hypot("u", "v"), 6).alias("speed"),
                    F.round("label", 6).alias("label")))


@query("grid_subsample", using("ice_cells", """SELECT day, count(*) AS cells, count(sic) AS valid, round(avg(sic), 6) AS mean_sic
    FROM ice_cells WHERE r % 4 = 0 AND c % 4 = 0 GROUP BY day"""))
def grid_subsample(spark, sf):
    """The stride operator itself: every fourth row and column of each daily field."""
    return (op.subsample(t.ice_cells(spark, sf), 4).groupBy("day")
            .agg(F.count(F.lit(1)).alias("cells"), F.count("sic").alias("valid"), F.round(F.avg("sic"), 6).alias("mean_sic")))


@query("split_counts", using("pairs", f"""SELECT split, base_day, count(*) AS n,
    min(target_day) AS first_target, max(target_day) AS last_target
    FROM (SELECT *, {_SPLIT.format('base_day')} AS split, {_SPLIT.format('target_day')} AS tsplit FROM pairs
          WHERE sic IS NOT NULL AND target_sic IS NOT NULL)
    WHERE split = tsplit GROUP BY ROLLUP (split, base_day)"""))
def split_counts(spark, sf):
    pairs = op.lead_pairs(t.ice_cells(spark, sf)).dropna(subset=["sic", "target_sic"])
    return (op.with_split(pairs).rollup("split", "base_day")
            .agg(F.count(F.lit(1)).alias("n"), F.min("target_day").alias("first_target"),
                 F.max("target_day").alias("last_target")))


@query("cells_scan", using("pairs", """SELECT base_day, count(*) AS pairs, count(sic) AS with_base,
    round(sum(target_sic), 2) AS target_sum FROM pairs
    WHERE base_day BETWEEN DATE '2025-03-01' AND DATE '2025-03-31' GROUP BY base_day"""))
def cells_scan(spark, sf):
    """Only the base days of one month and their target days are opened in a stored archive."""
    from ..sources.sinks import read_days, scratch_path, write_cells
    path = scratch_path(spark, "cells")
    write_cells(t.ice_cells(spark, sf), path)
    cells = read_days(spark, path, "2025-03-01", "2025-04-01")
    return (op.lead_pairs(cells).groupBy("base_day")
            .agg(F.count(F.lit(1)).alias("pairs"), F.count("sic").alias("with_base"),
                 F.round(F.sum("target_sic"), 2).alias("target_sum"))
            .where(F.col("base_day") <= "2025-03-31"))


@query("regrid_mean", using("products", """SELECT day, CAST(floor(((c + 0.5) * 6250 - 3125) / 25000) AS INTEGER) AS ci,
    CAST(floor(((r + 0.5) * 6250 - 3125) / 25000) AS INTEGER) AS cj, round(avg(a), 6) AS mean, count(a) AS contributors
    FROM (SELECT day, r, c, CASE WHEN a BETWEEN 0 AND 100 THEN a END AS a FROM products)
    WHERE ((c + 0.5) * 6250 - 3125) >= 0 AND ((r + 0.5) * 6250 - 3125) >= 0
      AND ((r + 0.5) * 6250 - 3125) < 125000
    GROUP BY ALL HAVING count(a) >= 2"""))
def regrid_mean(spark, sf):
    fine = t.products(spark, sf).drop("ci", "cj").withColumn("a", op.in_range(F.col("a")))
    out = op.regrid(fine, "a", 3125.0, 3125.0, 6250.0, 25000.0, (5, 1 << 30), min_cells=2)
    return out.select("day", "ci", "cj", F.round("mean", 6).alias("mean"), "contributors")


define("compared", """SELECT f.day, f.ci, f.cj, f.a, f.n_a, g.b, g.land, g.sd FROM
    (SELECT day, c // 4 AS ci, r // 4 AS cj, avg(a) AS a, count(a) AS n_a
     FROM (SELECT day, r, c, CASE WHEN a BETWEEN 0 AND 100 THEN a END AS a FROM products) GROUP BY ALL) f
    JOIN (SELECT day, c // 4 AS ci, r // 4 AS cj, avg(b) AS b, min(flags) % 2 = 1 AS land,
                 max(flags) - min(flags) AS sd
          FROM products GROUP BY ALL) g USING (day, ci, cj)""", ["products"])


@query("product_compare", using("compared", """SELECT day, count(*) FILTER (WHERE NOT land) AS ocean,
    count(*) FILTER (WHERE ok) AS compared,
    round(100.0 * count(*) FILTER (WHERE ok) / nullif(count(*) FILTER (WHERE NOT land), 0), 9) AS kept_percent,
    round(avg(abs(a - b)) FILTER (WHERE ok), 9) AS mae,
    round(sqrt(avg((a - b) * (a - b)) FILTER (WHERE ok)), 9) AS rmse,
    round(avg(a - b) FILTER (WHERE ok), 9) AS bias,
    round(avg(abs(a - b)) FILTER (WHERE ok AND b >= 15 AND b < 80), 9) AS miz_mae,
    round(avg(sd) FILTER (WHERE ok), 9) AS unc_mean, max(sd) FILTER (WHERE ok) AS unc_max
    FROM (SELECT *, NOT land AND n_a >= 1 AS ok FROM compared) GROUP BY ROLLUP (day)"""))
def product_compare(spark, sf):
    """Two products on a common coarse grid: per day and pooled (day NULL)."""
    fine = t.products(spark, sf, block=4)
    coarse = (fine.groupBy("day", "ci", "cj")
              .agg(F.avg(op.in_range(F.col("a"))).alias("a"),
                   F.count(op.in_range(F.col("a"))).alias("n_a"), F.avg("b").alias("b"),
                   op.has_flag(F.min("flags")).alias("land"),
                   (F.max("flags") - F.min("flags")).alias("sd")))
    ok = ~F.col("land") & (F.col("n_a") >= 1)
    a, b = F.when(ok, F.col("a")), F.when(ok, F.col("b"))
    miz = F.when(op.band_of(b) == "miz", F.abs(a - b))
    ocean = F.count_if(~F.col("land"))
    return coarse.rollup("day").agg(
        ocean.alias("ocean"), F.count_if(ok).alias("compared"),
        F.round(100.0 * F.count_if(ok) / F.nullif(ocean, F.lit(0)), 9).alias("kept_percent"),
        F.round(F.avg(F.abs(a - b)), 9).alias("mae"), F.round(F.sqrt(F.avg((a - b) * (a - b))), 9).alias("rmse"),
        F.round(F.avg(a - b), 9).alias("bias"), F.round(F.avg(miz), 9).alias("miz_mae"),
        F.round(F.avg(F.when(ok, F.col("sd"))), 9).alias("unc_mean"), F.max(F.when(ok, F.col("sd"))).alias("unc_max"))


@query("product_agreement", using("compared", """SELECT count(*) AS n, round(avg(a - b), 6) AS bias,
    round(CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END, 6) AS pearson,
    quantile_cont(sd, 0.5) AS unc_median FROM compared WHERE a IS NOT NULL AND NOT land"""))
def product_agreement(spark, sf):
    """Pooled bias, correlation and the median uncertainty (a bounded integer here)."""
    fine = t.products(spark, sf, block=4)
    coarse = (fine.groupBy("day", "ci", "cj")
              .agg(F.avg(op.in_range(F.col("a"))).alias("a"), F.avg("b").alias("b"),
                   op.has_flag(F.min("flags")).alias("land"),
                   (F.max("flags") - F.min("flags")).alias("sd"))
              .where(F.col("a").isNotNull() & ~F.col("land")))
    # ``sd`` takes at most seven values, so the exact percentile keeps seven counters
    return coarse.agg(F.count(F.lit(1)).alias("n"), *op.agreement(F.col("a"), F.col("b")),
                      F.percentile("sd", 0.5).alias("unc_median"))


@query("block_any", using("products", """SELECT day, r // 5 AS br, c // 5 AS bc, bool_or(flags % 2 = 1) AS any_land,
    round(avg(CASE WHEN a BETWEEN 0 AND 100 THEN a END), 6) AS mean_valid FROM products GROUP BY ALL"""))
def block_any(spark, sf):
    return op.block_any(t.products(spark, sf), 5)


@query("flag_counts", using("products", """SELECT bit, count(*) FILTER (WHERE (flags & bit) <> 0) AS cells,
    count(*) FILTER (WHERE (flags & bit) <> 0 AND a > 100) AS out_of_range
    FROM products, (VALUES (1), (2), (4)) AS v(bit) GROUP BY bit"""))
def flag_counts(spark, sf):
    cells = t.products(spark, sf).withColumn("bit", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    on = F.col("flags").bitwiseAND(F.col("bit")) != 0
    return cells.groupBy("bit").agg(F.count_if(on).alias("cells"),
                                    F.count_if(on & (F.col("a") > 100)).alias("out_of_range"))


@query("stratified_sample", using("rows1", f"""SELECT band, day, r, c, round(sic, 6) AS sic FROM (
    SELECT *, row_number() OVER (PARTITION BY band ORDER BY h, day, r, c) AS rn FROM (
      SELECT *, {_BAND.format('sic')} AS band, {_HASH} AS h FROM rows1))
    WHERE rn <= CASE band WHEN 'open' THEN 10 WHEN 'miz' THEN 60 ELSE 20 END"""))
def stratified_sample(spark, sf):
    rows = op.supervised_rows(t.ice_cells(spark, sf), t.current_cells(spark, sf))
    out = op.stratified_sample(rows, {"open": 10, "miz": 60, "ice": 20}, op.cell_hash(), ["day", "r", "c"])
    return out.select("band", "day", "r", "c", F.round("sic", 6).alias("sic"))


@query("usable_days", using("ice_cells current_cells", """SELECT day FROM ice_cells WHERE sic IS NOT NULL
    INTERSECT SELECT day FROM current_cells"""))
def usable_days(spark, sf):
    ice = t.ice_cells(spark, sf).where("sic IS NOT NULL").select("day")
    return ice.intersect(t.current_cells(spark, sf).select("day"))


@query("leakage_audit", using("pairs", f"""SELECT count(*) FILTER (WHERE split <> tsplit) AS straddling,
    bool_and(target_day - base_day = 1) AS one_lead, count(DISTINCT target_day - base_day) AS leads,
    max(base_day) FILTER (WHERE split = 'train') < min(base_day) FILTER (WHERE split = 'val') AS train_before_val,
    max(base_day) FILTER (WHERE split = 'val') < min(base_day) FILTER (WHERE split = 'test') AS val_before_test,
    (SELECT count(*) FROM (SELECT base_day, count(DISTINCT {_SPLIT.format('base_day')}) AS k FROM pairs GROUP BY 1)
     WHERE k > 1) AS shared_keys
    FROM (SELECT *, {_SPLIT.format('base_day')} AS split, {_SPLIT.format('target_day')} AS tsplit FROM pairs)"""))
def leakage_audit(spark, sf):
    from ..operators import models
    return models.leakage_audit(op.lead_pairs(t.ice_cells(spark, sf)))


@query("field_equal", using("ice_cells", """SELECT 'stored' AS side, count(*) AS cells, CAST(0 AS BIGINT) AS differing FROM ice_cells
    UNION ALL SELECT 'whole_percent', count(*), 2 * count(*) FILTER (WHERE sic <> floor(sic)) FROM ice_cells"""))
def field_equal(spark, sf):
    """A stored field equals the recomputed one; one cut to whole percents differs, once on each side, wherever that cuts something."""
    from ..operators.models import field_difference
    from ..sources.sinks import scratch_table
    now = t.ice_cells(spark, sf)
    stored = scratch_table(now, "field_equal")
    cut = now.withColumn("sic", F.floor("sic").cast("double"))
    return (field_difference(stored, now, ["day", "r", "c"], ["sic"])
            .unionByName(field_difference(stored, cut, ["day", "r", "c"], ["sic"]).withColumn("side", F.lit("whole_percent"))))
