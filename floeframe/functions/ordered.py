"""Ranks, quantiles, running totals and neighbours that never need one big task.

A plain window over a hot key (or over no key at all) puts all of its rows in
one task. The helpers below split such work by range or by block and then join
in a small table of offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, stored

BLOCK = 65536            # rows one window task holds per key and block
HOT_KEY_ROWS = 1_000_000  # keys above this are numbered block by block


def _with_slices(df: DataFrame, order: list) -> DataFrame:
    """``df`` range-sorted, with ``_slice`` (sorted slice number) and ``_pos`` in it."""
    placed = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    placed = cut_lineage(placed)
    return (placed
            .withColumn("_slice", F.shiftright("_mid", 33))
            .withColumn("_pos", F.col("_mid").bitwiseAND((1 << 33) - 1))
            .drop("_mid"))


def _slice_offsets(slices: DataFrame, amount: Column) -> DataFrame:
    # One row per sort slice: as many rows as the sort had partitions.
    totals = slices.groupBy("_slice").agg(F.sum(amount).alias("_amount"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_slice", F.coalesce(F.sum("_amount").over(before), F.lit(0))
                         .alias("_offset"))


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1-based position in a total order, by one range sort and slice offsets."""
    slices = _with_slices(df, order)
    offsets = F.broadcast(_slice_offsets(slices, F.lit(1)))
    return (slices.join(offsets, "_slice")
            .withColumn(name, F.col("_offset") + F.col("_pos") + 1)
            .drop("_slice", "_pos", "_offset"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str,
                    points: dict[str, tuple[float, str]]) -> DataFrame:
    """Exact quantiles per key; ``points`` maps name -> (q, "linear"|"nearest").

    Equal values are counted together first, then the distinct values are range
    sorted, so neither a hot group nor a hot value lands in one task.
    """
    if not keys:
        one = exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, points)
        return one.drop("_all")
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*keys, F.col(value).alias("_v"))
               .agg(F.count(F.lit(1)).alias("_n")))
    slices = _with_slices(counted, [*keys, "_v"])
    offsets = F.broadcast(_slice_offsets(slices, F.col("_n")))
    in_slice = Window.partitionBy("_slice").orderBy("_pos")
    running = (slices.withColumn("_hi", F.sum("_n").over(in_slice))
               .join(offsets, "_slice")
               .withColumn("_hi", F.col("_hi") + F.col("_offset"))
               .withColumn("_lo", F.col("_hi") - F.col("_n")))
    groups = running.groupBy(*keys).agg(F.min("_lo").alias("_start"),
                                        F.sum("_n").alias("_total"))
    totals = groups.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_start", "_total")
    spans = running.join(totals, _null_safe(keys))
    def at(index: Column) -> Column:
        inside = ((F.col("_lo") - F.col("_start") <= index)
                  & (index < F.col("_hi") - F.col("_start")))
        return F.max(F.when(inside, F.col("_v")))
    aggs = []
    for name, (q, mode) in points.items():
        if mode == "nearest":
            k = F.greatest(F.ceil(F.lit(q) * F.col("_total")) - 1, F.lit(0))
            aggs.append(at(k).alias(name))
        else:
            where = F.lit(q) * (F.col("_total") - 1)
            low = F.floor(where)
            high = F.least(low + 1, F.col("_total") - 1)
            aggs += [at(low).alias(f"_{name}_a"), at(high).alias(f"_{name}_b"),
                     F.max(where - low).alias(f"_{name}_f")]
    out = spans.groupBy(*keys).agg(F.max("_total").alias("_n"), *aggs)
    cols = []
    for name, (_, mode) in points.items():
        if mode == "nearest":
            cols.append(F.col(name))
        else:
            f = F.col(f"_{name}_f")
            cols.append((F.col(f"_{name}_a") * (1 - f) + F.col(f"_{name}_b") * f).alias(name))
    return out.select(*keys, *cols)


def _null_safe(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return cond


def dense_sequence(df: DataFrame, keys: list[str], order: list[str], split: Column,
                   name: str = "seq", hot_rows: int = HOT_KEY_ROWS, longest: int | None = None) -> DataFrame:
    """0-based row number inside each key, following ``order``.

    Keys above ``hot_rows`` are numbered per ``split`` block first; ``split``
    must not decrease along ``order``. ``longest``, if known, is the most rows
    of a key, which then are not counted again.
    """
    if longest is not None and longest <= hot_rows:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))
    hot = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
           .where(F.col("_rows") > hot_rows).drop("_rows").withColumn("_hot", F.lit(True)))
    if hot.isEmpty():
        # rows then lie together by key, as later steps on the same key need them
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))
    marked = (df.join(hot, keys, "left")
              .withColumn("_blk", F.when(F.col("_hot"), split).otherwise(F.lit(0)).cast("long")))
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order)
    numbered = marked.withColumn("_rn", F.row_number().over(inside) - 1)
    before = (Window.partitionBy(*keys).orderBy("_blk")
              .rowsBetween(Window.unboundedPreceding, -1))
    sizes = (marked.where("_hot").groupBy(*keys, "_blk")
             .agg(F.count(F.lit(1)).alias("_size"))
             .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
             .drop("_size"))
    return (numbered.join(sizes, [*keys, "_blk"], "left")
            .withColumn(name, (F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("int"))
            .drop("_blk", "_hot", "_rn", "_before"))


def with_following(df: DataFrame, keys: list[str], seq: str, fields: list[str],
                   prefix: str = "next_", block: int = BLOCK, longest: int | None = None) -> DataFrame:
    """Each row with ``fields`` of the row at ``seq + 1`` of the same key.

    The first row of a block is also sent to the block before it, so one
    shuffle on (key, block) is enough and no task holds a whole hot key.
    If the ``longest`` key is known to fit a block, rows lie by key alone,
    and reductions by key need no further shuffle.
    """
    if longest is not None and longest <= block:
        w = Window.partitionBy(*keys).orderBy(seq)
        return df.select("*", *[F.lead(f).over(w).alias(f"{prefix}{f}") for f in fields])
    at = F.col(seq)
    blocks = F.when((at > 0) & (at % block == 0),
                    F.array(F.floor(at / block), F.floor(at / block) - 1)
                    ).otherwise(F.array(F.floor(at / block)))
    spread = df.withColumn("_blk", F.explode(blocks))
    w = Window.partitionBy(*keys, "_blk").orderBy(seq)
    spread = spread.select("*", *[F.lead(f).over(w).alias(f"{prefix}{f}") for f in fields])
    return spread.where(F.floor(at / block) == F.col("_blk")).drop("_blk")


def with_next_and_running(df: DataFrame, keys: list[str], seq: str, fields: list[str], measure, name: str,
                          block: int = BLOCK, longest: int | None = None) -> DataFrame:
    """Rows with ``next_*`` fields, a measure of the step to the next row, and its running sum.

    ``measure`` maps nothing to a Column over the row and its ``next_*`` fields;
    ``name`` is the measure and ``<name>_before`` the sum over all earlier rows
    of the key. One shuffle on (key, block); only keys longer than one block
    contribute rows to the small table of block totals. If the ``longest`` key
    is known to fit a block, there is no such table to compute and join.
    """
    if longest is not None and longest <= block:
        w = Window.partitionBy(*keys).orderBy(seq)
        led = df.select("*", *[F.lead(f).over(w).alias(f"next_{f}") for f in fields]).withColumn(name, measure())
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        return led.withColumn(f"{name}_before", F.coalesce(F.sum(name).over(earlier), F.lit(0.0)))
    at = F.col(seq)
    blocks = F.when((at > 0) & (at % block == 0),
                    F.array(F.floor(at / block), F.floor(at / block) - 1)
                    ).otherwise(F.array(F.floor(at / block)))
    spread_out = df.withColumn("_blk", F.explode(blocks))
    w = Window.partitionBy(*keys, "_blk").orderBy(seq)
    led = spread_out.select("*", *[F.lead(f).over(w).alias(f"next_{f}") for f in fields])
    led = led.withColumn(name, measure())
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    led = (led.withColumn("_cum", F.coalesce(F.sum(name).over(earlier), F.lit(0.0)))
           .where(F.floor(at / block) == F.col("_blk")))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
    heads = (led.where((at + 1) % block == 0)
             .select(*keys, (F.col("_blk") + 1).alias("_blk"), (F.col("_cum") + F.col(name)).alias("_part"))
             .select(*keys, "_blk", F.sum("_part").over(before).alias("_base")))
    return (led.join(heads, [*keys, "_blk"], "left")
            .withColumn(f"{name}_before", F.col("_cum") + F.coalesce("_base", F.lit(0.0)))
            .drop("_blk", "_cum", "_base"))


def first_by_hash(df: DataFrame, group: str, hash_col: str, tie: list[str],
                  quotas: dict[str, int], buckets: int = 1 << 16, strict: bool = True) -> DataFrame:
    """The ``quota`` rows with the smallest hash in each group, exactly.

    A histogram of the hash finds the bucket in which the quota falls; whole
    buckets below it pass whole and that bucket is ranked. With ``strict`` a
    group that cannot fill its quota fails the job.
    ``hash_col`` must be an evenly spread integer in [0, 2**31).
    """
    width = (1 << 31) // buckets
    wanted = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    df = stored(df.where(F.col(group).isin(*quotas)).withColumn("_b", F.floor(F.col(hash_col) / width)))
    # At most groups x buckets rows, whatever the size of the table.
    hist = df.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cut = (hist.withColumn("_cum", F.sum("_c").over(upto))
           .withColumn("_want", wanted[F.col(group)])
           .where((F.col("_cum") - F.col("_c")) < F.col("_want"))
           .groupBy(group).agg(F.max("_b").alias("_edge"),
                               F.max_by(F.col("_want") - (F.col("_cum") - F.col("_c")), "_b")
                               .alias("_left")))
    if strict:
        have = {r[group]: r["_rows"] for r in hist.groupBy(group).agg(F.sum("_c").alias("_rows")).collect()}
        short = {k: have.get(k, 0) for k, want in quotas.items() if have.get(k, 0) < want}
        if short:
            raise ValueError(f"not enough rows for the quotas: {short}")
    kept = df.join(F.broadcast(cut), group).where(F.col("_b") <= F.col("_edge"))
    # only rows up to the edge bucket are shuffled, and by bucket, so no task is large
    w = Window.partitionBy(group, "_b").orderBy(hash_col, *tie)
    return (kept.withColumn("_rn", F.row_number().over(w))
            .where((F.col("_b") < F.col("_edge")) | (F.col("_rn") <= F.col("_left")))
            .drop("_b", "_edge", "_left", "_rn"))
