"""Chart interpretation, risk sums as points and intervals, dominant polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import classify_rio
from ..sources import policy as p

INDETERMINATE, UNKNOWN = "indeterminate", "unknown"
SLOTS = (("SA", "CA"), ("SB", "CB"), ("SC", "CC"))


def required(value: Column, message: str, dtype: str) -> Column:
    """The value, or a job failure when it is missing."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(message)).cast(dtype))


def interpret(polygons: DataFrame) -> DataFrame:
    """Roles, decoded concentrations and the state of each polygon.

    SA = 98 makes CA the iceberg fraction and moves the stages to SB and SC.
    Codes are decoded by fixed lookup tables inside the row, so polygons are
    never shuffled; an unlisted code decodes to NULL, never to a near one.
    """
    ice = F.col("POLY_TYPE") == "I"
    out = _once(polygons, convention=ice & (F.col("SA") == p.ICEBERG), is_water=F.col("POLY_TYPE") == "W")
    stages = {}
    for i, (s, _) in enumerate(SLOTS, 1):
        named = (F.col(s) != p.UNUSED) & ice
        stages[f"stage{i}"] = F.when(named & ~F.col("convention") if i == 1 else named, F.col(s))
    out = _once(out, **stages)
    decoded = {"ct_low": p.lookup(F.col("CT"), {k: v[0] for k, v in p.CT_CODES.items()}),
               "ct_high": p.lookup(F.col("CT"), {k: v[1] for k, v in p.CT_CODES.items()}),
               "iceberg_tenths": F.when(F.col("convention"), p.lookup(F.col("CA"), p.PARTIALS)),
               "n_sea": sum((F.col(f"stage{i}").isNotNull().cast("int") for i in (1, 2, 3)), F.lit(0))}
    for i, (_, c) in enumerate(SLOTS, 1):
        decoded[f"cons{i}"] = p.lookup(F.col(f"stage{i}"), {k: v[0] for k, v in p.STAGES.items()})
        decoded[f"opt{i}"] = p.lookup(F.col(f"stage{i}"), {k: v[1] for k, v in p.STAGES.items()})
        decoded[f"tenths{i}"] = F.when(F.col(f"stage{i}").isNotNull(), p.lookup(F.col(c), p.PARTIALS))
    out = _once(out, **decoded)
    unlisted = _any([F.col(f"stage{i}").isNotNull() & F.col(f"cons{i}").isNull() for i in (1, 2, 3)])
    bare = (F.col("CA") == p.UNUSED) & (F.col("CB") == p.UNUSED) & (F.col("CC") == p.UNUSED)
    state = (F.when(F.col("is_water"), "resolved").when(~ice, UNKNOWN)
             .when(F.col("ct_low").isNull() | unlisted | (F.col("n_sea") == 0), UNKNOWN)
             .when(bare, F.when(F.col("n_sea") == 1, "partials_absent").otherwise(UNKNOWN))
             .when(F.col("ct_low") == F.col("ct_high"), "resolved").otherwise("interval"))
    sensitive = _any([(F.col(f"stage{i}") != "00") & F.col(f"cons{i}").isNotNull() for i in (1, 2, 3)])
    return _once(out, state=state, iceberg_trace=F.col("SO") == p.ICEBERG, mapping_sensitive=sensitive)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions use many times, evaluated once per row.

    A one-row generator is a boundary for projection merging; without it every
    use would carry its own copy of the expression into the generated code.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*[c for c in df.columns if c not in columns], F.inline(packed))


def _any(conds: list[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | F.coalesce(c, F.lit(False))
    return out


def components(interpreted: DataFrame) -> DataFrame:
    """Long form: one row per named slot with its role."""
    slots = [F.struct(F.lit(s).alias("slot"), F.when(F.col("convention") & F.lit(i == 1), "iceberg").otherwise("sea_ice").alias("role"),
                      F.col(s).alias("stage"), F.when(F.col("convention") & F.lit(i == 1), F.col("iceberg_tenths"))
                      .otherwise(F.col(f"tenths{i}")).alias("tenths"),
                      F.col(f"cons{i}").alias("conservative"), F.col(f"opt{i}").alias("optimistic"))
             for i, (s, _) in enumerate(SLOTS, 1)]
    return (interpreted.where("POLY_TYPE = 'I'").select("polygon_id", F.explode(F.array(*slots)).alias("s"))
            .select("polygon_id", "s.*").where(F.col("stage") != p.UNUSED))


def _with_endpoints(df: DataFrame, free: float) -> DataFrame:
    """Lowest and highest feasible endpoint sum of both mapping branches (NULL if none).

    Partial codes are exact, so an endpoint is a choice of the total (low or
    high) and of the bound for the iceberg fraction (severest type present or
    ice-free). Without partials the single named stage holds the whole total.
    The regime is closed with ice-free to ten tenths; feasibility is measured
    against the total. Row-local and in small steps: no shuffle, and generated
    methods stay short enough for the JIT.
    """
    ends = {"lo": "ct_low", "hi": "ct_high"}
    out = _once(df, _absent=F.col("state") == "partials_absent", _berg=F.coalesce("iceberg_tenths", F.lit(0)))
    out = _once(out, **{f"_{e}{i}": F.expr(f"IF(stage{i} IS NULL, 0, IF(_absent, {total}, coalesce(tenths{i}, 0)))")
                        for e, total in ends.items() for i in (1, 2, 3)},
                **{f"_{k}{i}": F.expr(f"IF(tenths{i} IS NOT NULL OR _absent, {k}_riv{i}, NULL)")
                   for k in ("cons", "opt") for i in (1, 2, 3)})
    out = _once(out, **{f"_{e}_used": F.expr(f"_{e}1 + _{e}2 + _{e}3 + _berg") for e in ends},
                **{f"_{k}_worst": F.expr(f"coalesce(least(_{k}1, _{k}2, _{k}3), {free}D)") for k in ("cons", "opt")},
                **{f"_{k}_{e}": F.expr(" + ".join(f"coalesce(_{e}{i} * _{k}{i}, 0D)" for i in (1, 2, 3)))
                   for k in ("cons", "opt") for e in ends})
    branches = {"conservative": "cons", "optimistic": "opt"}
    fits = {e: f"state <> 'unknown' AND _{e}_used <= {total} AND _{e}_used <= 10" for e, total in ends.items()}
    total = lambda k, e, bound: f"IF({fits[e]}, _{k}_{e} + _berg * {bound} + (10 - _{e}_used) * {free}D, NULL)"
    out = _once(out, **{f"{n}_low": F.expr(f"least({total(k, 'lo', f'_{k}_worst')}, {total(k, 'hi', f'_{k}_worst')})") for n, k in branches.items()},
                **{f"{n}_high": F.expr(f"greatest({total(k, 'lo', f'{free}D')}, {total(k, 'hi', f'{free}D')})") for n, k in branches.items()})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def rio_interval(interpreted: DataFrame, ice_class: str, table: dict = p.RIV_STANDARD) -> DataFrame:
    """Low and high risk sum with their classes for both mapping branches."""
    riv, category = p.riv_map(ice_class, table), p.CATEGORY[ice_class]
    out = _once(interpreted, **{f"{kind}_riv{i}": p.lookup(F.col(f"stage{i}"), {k: riv[v[j]] for k, v in p.STAGES.items()})
                                for i in (1, 2, 3) for j, kind in enumerate(("cons", "opt"))})
    out = _with_endpoints(out, riv["Ice-Free"])
    ends = ("conservative", "optimistic")
    out = _once(out, **{f"{n}_{side}_class": classify_rio(F.col(f"{n}_{side}"), category) for n in ends for side in ("low", "high")})
    verdict = {}
    for name in ends:
        lo, hi = F.col(f"{name}_low_class"), F.col(f"{name}_high_class")
        verdict[f"{name}_class"] = F.when(lo.isNull(), UNKNOWN).when(lo == hi, lo).otherwise(INDETERMINATE)
    out = _once(out, **verdict)
    has = F.col("conservative_low").isNotNull()
    return (out.withColumn("has_rio", has)
            .withColumn("class_differs", has & F.col("optimistic_low").isNotNull()
                        & (F.col("conservative_class") != F.col("optimistic_class")))
            .withColumn("straddles", (F.col("conservative_class") == INDETERMINATE)
                        | (F.col("optimistic_class") == INDETERMINATE)))


def penalties(scored: DataFrame, table: dict[str, float] = p.PENALTIES) -> DataFrame:
    """Configured penalty of the branch verdict and of both endpoints; an unlisted class fails the job."""
    cost = lambda c: required(p.lookup(F.coalesce(F.col(c), F.lit(UNKNOWN)), table), "class without a configured penalty", "double")
    out = scored
    for b in ("conservative", "optimistic"):
        out = (out.withColumn(f"{b}_penalty", cost(f"{b}_class")).withColumn(f"{b}_penalty_worst", cost(f"{b}_low_class"))
               .withColumn(f"{b}_penalty_best", cost(f"{b}_high_class")))
    return out


def rio_points(regimes: DataFrame, riv: DataFrame) -> DataFrame:
    """Sum of tenths times risk value per regime and class; a regime must total ten.

    ``riv`` has one row per class and ice type, a dimension of fixed size.
    """
    # a regime is a short list of types, gathered once; the classes are then scored inside the row, not grouped
    whole = regimes.groupBy("polygon_id").agg(F.collect_list(F.struct("ice_type", "tenths")).alias("_parts"))
    classes = riv.groupBy("ice_class", "category").agg(F.map_from_entries(F.collect_list(F.struct("ice_type", "riv"))).alias("_riv"))
    value = lambda x: required(F.col("_riv")[x["ice_type"]], "ice type without a risk value", "double")
    tenths = F.aggregate("_parts", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["tenths"], F.lit(0)))
    rio = F.aggregate("_parts", F.lit(0.0), lambda a, x: a + F.coalesce(x["tenths"], F.lit(0)) * value(x))
    return (whole.join(F.broadcast(classes), F.lit(True)).withColumn("tenths", tenths).withColumn("_rio", rio)
            .select("polygon_id", "ice_class", "category", "tenths", F.when(F.col("tenths") == 10, F.col("_rio")).alias("rio")))


def dominant_polygons(areas: DataFrame, keys=("zone", "r", "c")) -> DataFrame:
    """Polygon with the largest share; an exact tie goes to the lowest id."""
    best = F.max_by(F.struct("polygon_id", "area_share"), F.struct(F.col("area_share"), -F.col("polygon_id")))
    out = (areas.where(F.col("area_share") > 0).groupBy(*keys)
           .agg(best.alias("b"), F.sum("area_share").alias("total_share"), F.count(F.lit(1)).alias("contributors")))
    kind = (F.when(F.col("total_share") > 1 + 1e-9, "source_overlap").when(F.col("contributors") >= 2, "adjacent")
            .otherwise("single"))
    return (out.withColumn("kind", kind)
            .select(*keys, F.col("b.polygon_id").alias("polygon_id"), F.col("b.area_share").alias("dominant_fraction"),
                    "total_share", "contributors", "kind"))


def polygon_quality(cells: DataFrame) -> DataFrame:
    """Full, partial and mixed cells of each polygon."""
    full = F.col("dominant_fraction") >= 1.0
    return cells.groupBy("polygon_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(full).alias("full"), F.count_if(~full).alias("partial"),
        F.count_if(~full & (F.col("contributors") >= 2)).alias("mixed"))
