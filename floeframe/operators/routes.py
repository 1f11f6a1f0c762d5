"""Routes as ordered cells: distances, clocks, prices, comparison, geometry groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import length
from ..functions.ordered import with_following, with_next_and_running
from .cost import finite

ROUTE = ["route_id"]


def segment_m(cell_m: float) -> Column:
    """Length to the next point; 0 at the last one."""
    return F.coalesce(length(F.col("next_r") - F.col("r"), F.col("next_c") - F.col("c")) * cell_m, F.lit(0.0))


def clocked(points: DataFrame, cell_m: float, speed: float, longest: int | None = None) -> DataFrame:
    """Distance to the next point, distance so far and arrival seconds of each point; ``longest``, if known, is the most points of a route."""
    out = with_next_and_running(points, ROUTE, "seq", ["r", "c"], lambda: segment_m(cell_m), "dist_m", longest=longest)
    return (out.drop("next_r", "next_c").withColumnRenamed("dist_m_before", "along_m")
            .withColumn("arrival_s", F.col("along_m") / speed))


def trapezoids(priced: DataFrame, terms: list[str], longest: int | None = None) -> DataFrame:
    """``dist * (value + next value) / 2`` per segment for every term (0 at the last point)."""
    out = with_following(priced, ROUTE, "seq", terms, longest=longest)
    segs = {f"{t}_seg": F.expr(f"CASE WHEN next_{t} IS NOT NULL THEN dist_m * 0.5D * ({t} + next_{t}) ELSE 0D END") for t in terms}
    return out.withColumns(segs).drop(*[f"next_{t}" for t in terms])


def price(priced: DataFrame, terms: list[str], total: str, longest: int | None = None) -> DataFrame:
    """Per-term sums of each route; one unpriceable point voids the route, with a reason."""
    marked = priced.withColumn("_bad", ~finite(F.col(total)))
    safe = [F.when(~F.col("_bad"), F.col(c)).alias(c) for c in [*terms, total]]
    segs = trapezoids(marked.select("route_id", "seq", "dist_m", "arrival_s", "bucket_known", "_bad", *safe), [*terms, total], longest)
    sums = segs.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("dist_m").alias("distance_m"), F.max("arrival_s").alias("travel_s"),
        F.count_if("_bad").alias("unpriceable"), F.count_if(~F.col("bucket_known")).alias("outside_buckets"),
        *[F.sum(f"{t}_seg").alias(f"{t}_sum") for t in [*terms, total]])
    ok = F.col("unpriceable") == 0
    added = sum((F.col(f"{t}_sum") for t in terms), F.lit(0.0))
    return (sums.withColumn("reason", F.when(F.col("outside_buckets") > 0, "outside_buckets").when(~ok, "unpriceable_cell"))
            .withColumn("reconciles", F.when(ok, F.abs(added - F.col(f"{total}_sum"))
                                             <= 1e-9 * F.greatest(F.abs(f"{total}_sum"), F.lit(1.0))))
            .select("route_id", "cells", "distance_m", "travel_s", "unpriceable", "reason", "reconciles",
                    *[F.when(ok, F.col(f"{t}_sum")).alias(t) for t in [*terms, total]]))


def as_pairs(points: DataFrame, fields: list[str]) -> DataFrame:
    """Route k beside route k + 1: each row is sent to the two pairs it belongs to."""
    sides = F.array(F.struct(F.col("route_id").alias("pair"), F.lit("a").alias("side")),
                    F.struct((F.col("route_id") - 1).alias("pair"), F.lit("b").alias("side")))
    return points.select(F.explode(sides).alias("s"), *fields).select("s.pair", "s.side", *fields)


def cell_overlap(paired: DataFrame, cell: list[str]) -> DataFrame:
    """Shared and one-sided cells per pair, over distinct cells."""
    per_cell = paired.groupBy("pair", *cell).agg(F.bool_or(F.col("side") == "a").alias("a"), F.bool_or(F.col("side") == "b").alias("b"))
    return per_cell.groupBy("pair").agg(
        F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"),
        F.count_if(~F.col("a") & F.col("b")).alias("only_b"))


def first_divergence(paired: DataFrame, cell: list[str]) -> DataFrame:
    """First index at which two paths differ.

    ``first_difference`` is the shorter length for a prefix and NULL for equal
    paths; ``first_conflict`` looks only where both have a point.
    """
    # plain values and not structs, so that rows are reduced by hash and never sorted
    there = [F.bool_or(F.col("side") == side).alias(f"_{side}") for side in "ab"]
    values = [F.max(F.when(F.col("side") == side, F.col(x))).alias(f"_{side}_{x}") for side in "ab" for x in cell]
    by_seq = paired.groupBy("pair", "seq").agg(*there, *values)
    both = F.col("_a") & F.col("_b")
    differs = ~reduce(lambda same, x: same & F.col(f"_a_{x}").eqNullSafe(F.col(f"_b_{x}")), cell, both)
    return by_seq.groupBy("pair").agg(
        F.min(F.when(differs, F.col("seq"))).alias("first_difference"), F.min(F.when(differs & both, F.col("seq"))).alias("first_conflict"),
        F.count_if("_a").alias("len_a"), F.count_if("_b").alias("len_b"))


def geometry_groups(points: DataFrame, cell: list[str]) -> DataFrame:
    """Routes with the same ordered cells; the first route of a group represents it.

    Length and three order-aware fingerprints choose a representative, then each
    route is checked against it point by point, so a fingerprint clash shows up
    as ``verified = false`` instead of a wrong group. No list of points is built.
    """
    h = F.xxhash64("seq", *cell)
    prints = points.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("len"), F.sum(h.cast("decimal(38,0)")).alias("f1"), F.bit_xor(h).alias("f2"),
        F.bit_xor(F.xxhash64(F.lit(17), *cell, "seq")).alias("f3"))
    head = prints.groupBy("len", "f1", "f2", "f3").agg(F.min("route_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    routes = prints.join(head, ["len", "f1", "f2", "f3"]).select("route_id", "rep", "members", "len")
    mine = points.join(routes.where("route_id <> rep").select("route_id", "rep"), "route_id")
    theirs = points.select(F.col("route_id").alias("rep"), "seq", *[F.col(c).alias(f"_{c}") for c in cell])
    same = F.lit(True)
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    bad = (mine.join(theirs, ["rep", "seq"], "left").groupBy("route_id").agg(F.bool_and(same).alias("_same")))
    return (routes.join(bad, "route_id", "left").withColumn("verified", F.coalesce("_same", F.lit(True))).drop("_same"))


def position_at(points: DataFrame, elapsed_s: Column) -> DataFrame:
    """Where the vessel is ``elapsed_s`` after its first point; the last point once arrived."""
    out = with_following(points, ROUTE, "seq", ["r", "c", "arrival_s"])
    start = points.groupBy("route_id").agg(F.min("arrival_s").alias("_t0"), F.max("seq").alias("_last"))
    out = out.join(start, "route_id").withColumn("_t", F.col("_t0") + F.greatest(F.lit(0.0), elapsed_s))
    here = (F.col("_t") >= F.col("arrival_s")) & (F.col("_t") < F.col("next_arrival_s"))
    done = (F.col("seq") == F.col("_last")) & (F.col("_t") >= F.col("arrival_s"))
    span = F.col("next_arrival_s") - F.col("arrival_s")
    f = F.when(here & (span > 0), (F.col("_t") - F.col("arrival_s")) / span).otherwise(F.lit(0.0))
    return (out.where(here | done)
            .select("route_id", "seq", (F.col("r") + f * F.coalesce(F.col("next_r") - F.col("r"), F.lit(0))).alias("r"),
                    (F.col("c") + f * F.coalesce(F.col("next_c") - F.col("c"), F.lit(0))).alias("c"), f.alias("fraction"), done.alias("arrived")))


def vertex_at_fraction(points: DataFrame, fraction: float) -> DataFrame:
    """Interior vertex nearest a share of the path length; the earliest wins a tie."""
    ends = points.groupBy("route_id").agg(F.max("along_m").alias("_total"), F.max("seq").alias("_last"))
    out = points.join(ends, "route_id")
    interior = (F.col("_last") < 2) | ((F.col("seq") > 0) & (F.col("seq") < F.col("_last")))
    gap = F.abs(F.col("along_m") - fraction * F.col("_total"))
    best = F.min_by(F.struct("seq", "r", "c", "along_m"), F.struct(F.round(gap, 6), F.col("seq")))
    return (out.where(interior).groupBy("route_id").agg(best.alias("b"), F.max("_total").alias("total_m"))
            .select("route_id", "b.*", "total_m"))


def nearest_point(points: DataFrame, row: float, col: float, cell_m: float) -> DataFrame:
    """Route cell closest to a position; the first wins a tie."""
    d = F.hypot(F.col("r") - row, F.col("c") - col) * cell_m
    return (points.withColumn("_d", d).groupBy("route_id")
            .agg(F.min_by(F.struct("seq", "r", "c", F.col("_d").alias("distance_m")), F.struct("_d", "seq")).alias("b"))
            .select("route_id", "b.*"))


WORD = 64                # positions in one bitmap word


def bitmaps(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """keys, word, bits: the set of positions (0 and up) of each key, 64 to a number; combined on the map side, of fixed size."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(position), F.lit(WORD)).cast("int"))
    return (rows.where(F.col(position) >= 0).groupBy(*keys, F.floor(F.col(position) / WORD).cast("long").alias("word"))
            .agg(F.bit_or(bit).alias("bits")))


def positions(words: DataFrame, bits: Column, name: str) -> DataFrame:
    """One row per position in ``bits``; ``words`` keeps its other columns."""
    there = F.filter(F.array(*[F.lit(i) for i in range(WORD)]), lambda i: F.call_function("shiftright", F.col("_bits"), i).bitwiseAND(1) == 1)
    return (words.withColumn("_bits", bits).withColumn("_at", F.explode(there))
            .withColumn(name, (F.col("word") * WORD + F.col("_at")).cast("int")).drop("_bits", "_at"))


def bucket_status(used: DataFrame, fields: DataFrame) -> DataFrame:
    """route_id, bucket, status: ``priced`` or ``missing`` for buckets a route used, ``display_only`` for fields it never reached.

    ``used`` has (route_id, bucket), repeats allowed; ``fields`` has one bucket per loaded field. A route that used no bucket has no rows.
    """
    mine = bitmaps(used, ["route_id"], "bucket")
    loaded = bitmaps(fields, [], "bucket").select("word", F.col("bits").alias("_field"))
    # the loaded fields as one row of one entry per 64 buckets, for every route
    listed = F.broadcast(loaded.agg(F.collect_list(F.struct("word", "_field")).alias("_fields")))
    all_words = (mine.select("route_id").distinct().join(listed, F.lit(True)).select("route_id", F.inline("_fields"))
                 .join(mine, ["route_id", "word"], "full")
                 .withColumns({"_field": F.coalesce("_field", F.lit(0)), "bits": F.coalesce("bits", F.lit(0))}))
    sets = {"priced": F.col("bits").bitwiseAND(F.col("_field")), "missing": F.col("bits").bitwiseAND(F.bitwise_not("_field")),
            "display_only": F.col("_field").bitwiseAND(F.bitwise_not("bits"))}
    rows = all_words.select("route_id", "word", F.explode(F.array(*[F.struct(F.lit(k).alias("status"), v.alias("_set")) for k, v in sets.items()])).alias("s"))
    return positions(rows.select("route_id", "word", "s.*").where("_set <> 0"), F.col("_set"), "bucket").select("route_id", "bucket", "status")


def contributors(priced: DataFrame) -> DataFrame:
    """route_id, iceberg_id, cells, max_exposure, first_seq: the icebergs that dominate cells of a route, as rows."""
    return (priced.where(F.col("iceberg_id").isNotNull()).groupBy("route_id", "iceberg_id")
            .agg(F.count(F.lit(1)).alias("cells"), F.max("exposure").alias("max_exposure"), F.min("seq").alias("first_seq")))
