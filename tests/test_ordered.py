"""Ranks, quantiles and block passes against plain Python, with hot keys and tiny blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from floeframe.functions import ordered
from floeframe.functions.ordered import (dense_sequence, exact_quantiles, first_by_hash, global_rank,
                                         with_following, with_next_and_running)
from floeframe.plans.catalogue import QUERIES


def skewed(spark, n=600):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}", i, float(rng.randrange(40))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, id long, v double").repartition(7)


def test_global_rank_is_a_total_order(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["rank"] for r in global_rank(df, ["v", "id"]).collect()}
    assert got == {r[1]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])))}


@pytest.mark.parametrize("keys", [["k"], []])
def test_exact_quantiles(spark, keys):
    rows, df = skewed(spark)
    got = exact_quantiles(df, keys, "v", {"mid": (0.5, "linear"), "p90": (0.9, "nearest")}).collect()
    groups = {}
    for k, _, v in rows:
        groups.setdefault(k if keys else None, []).append(v)
    assert len(got) == len(groups)
    for r in got:
        s = sorted(groups[r["k"] if keys else None])
        pos = 0.5 * (len(s) - 1)
        lo = math.floor(pos)
        hi = min(lo + 1, len(s) - 1)
        assert r["mid"] == pytest.approx(s[lo] * (1 - pos + lo) + s[hi] * (pos - lo))
        assert r["p90"] == s[math.ceil(0.9 * len(s)) - 1]


@pytest.mark.parametrize("hot_rows", [50, 10_000])
def test_dense_sequence_with_and_without_hot_keys(spark, hot_rows):
    rows, df = skewed(spark)
    got = {r["id"]: r["seq"] for r in dense_sequence(df, ["k"], ["v", "id"], F.floor(F.col("v") / 7), hot_rows=hot_rows).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for i, r in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: (x[2], x[1]))):
            want[r[1]] = i
    assert got == want


def paths(spark):
    rng = random.Random(5)
    rows = [(k, s, float(rng.randrange(10))) for k, n in (("a", 23), ("b", 4), ("c", 1), ("d", 8)) for s in range(n)]
    return rows, spark.createDataFrame(rows, "k string, seq int, v double")


@pytest.mark.parametrize("block", [4, 1000])
def test_following_and_running_across_blocks(spark, block):
    rows, df = paths(spark)
    at = {(k, s): v for k, s, v in rows}
    for r in with_following(df, ["k"], "seq", ["v"], block=block).collect():
        assert r["next_v"] == at.get((r["k"], r["seq"] + 1))
    step = lambda: F.coalesce(F.col("next_v") - F.col("v"), F.lit(0.0))
    out = with_next_and_running(df, ["k"], "seq", ["v"], step, "d", block=block).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["d_before"] == pytest.approx(at[(r["k"], r["seq"])] - at[(r["k"], 0)])


def test_first_by_hash_is_exact_and_strict(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else "cold", i, rng.randrange(2 ** 31)) for i in range(900)]
    df = spark.createDataFrame(rows, "band string, id long, h long")
    got = {r["id"] for r in first_by_hash(df, "band", "h", ["id"], {"hot": 100, "cold": 7}, buckets=8).collect()}
    want = set()
    for band, n in (("hot", 100), ("cold", 7)):
        want |= {r[1] for r in sorted((x for x in rows if x[0] == band), key=lambda x: (x[2], x[1]))[:n]}
    assert got == want
    with pytest.raises(ValueError):
        first_by_hash(df, "band", "h", ["id"], {"cold": 10_000})


def test_keys_that_fit_a_block_are_shuffled_once(spark, capsys):
    rows = spark.range(200).select((F.col("id") % 7).alias("k"), (F.col("id") / 7).cast("int").alias("seq"), F.rand(3).alias("x"))
    step = lambda: F.coalesce(F.col("next_x") - F.col("x"), F.lit(0.0))
    cut = ordered.with_next_and_running(rows, ["k"], "seq", ["x"], step, "d", block=8)
    whole = ordered.with_next_and_running(rows, ["k"], "seq", ["x"], step, "d", longest=29)
    near = lambda df: {(r["k"], r["seq"]): (r["x"], r["next_x"], r["d"], round(r["d_before"], 9)) for r in df.collect()}
    assert near(cut) == near(whole) and len(near(whole)) == 200
    follow = lambda **how: sorted(map(tuple, ordered.with_following(rows, ["k"], "seq", ["x"], **how).select("k", "seq", "next_x").collect()))
    assert follow(block=8) == follow(longest=29) == follow(block=8, longest=29)
    whole.groupBy("k").agg(F.sum("d")).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_a_route_is_numbered_once_when_it_is_priced(spark, capsys):
    QUERIES["route_price"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("row_number()") == 1 and plan.count("Exchange hashpartitioning(route_id") == 2      # once by route, once priced


def test_a_long_route_still_goes_block_by_block(spark):
    rows = spark.range(50).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("seq"))
    got = ordered.with_next_and_running(rows, ["k"], "seq", ["seq"], lambda: F.lit(1.0), "d", block=8, longest=50).orderBy("seq").collect()
    assert [r["d_before"] for r in got] == [float(i) for i in range(50)] and [r["next_seq"] for r in got] == [*range(1, 50), None]
